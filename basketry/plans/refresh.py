"""Rebuild the models over all stored transactions."""

from pyspark.sql import SparkSession

from basketry.operators import features, rules, segments
from basketry.plans.ingest import Store
from basketry.sources import readers, writers


def refresh_segments(spark: SparkSession, store: Store) -> segments.Segmentation:
    """Train on all customers, then store the model and every customer's cluster."""
    baskets = readers.read_baskets(spark, store.baskets)
    result = segments.train_segments(features.customer_features(baskets))
    result.model.write().overwrite().save(store.kmeans)
    writers.write_table(result.clusters, store.clusters)
    return result


def refresh_rules(
    spark: SparkSession,
    store: Store,
    min_support: float = rules.MIN_SUPPORT,
    min_confidence: float = rules.MIN_CONFIDENCE,
) -> None:
    """Mine all baskets and store the rules."""
    model = rules.mine_rules(readers.read_baskets(spark, store.baskets), min_support, min_confidence)
    writers.write_table(rules.association_rules(model), store.rules)


def refresh_models(
    spark: SparkSession,
    store: Store,
    force: bool = False,
    min_support: float = rules.MIN_SUPPORT,
    min_confidence: float = rules.MIN_CONFIDENCE,
) -> dict[str, bool]:
    """Segments first, then rules; what is already stored is kept unless ``force``.

    Returns which of the two were rebuilt.
    """
    rebuilt = {
        "segments": force or not readers.table_exists(spark, store.clusters),
        "rules": force or not readers.table_exists(spark, store.rules),
    }
    if rebuilt["segments"]:
        refresh_segments(spark, store)
    if rebuilt["rules"]:
        refresh_rules(spark, store, min_support, min_confidence)
    return rebuilt
