"""K-Means segments: choice of k, assignment, profiles, labels and projection."""

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.stats import min_max_scaled, rounded
from basketry.operators import silhouette
from basketry.operators.features import scaled_features
from basketry.schemas import FEATURE_COLUMNS
from basketry.session import staged

# Seed, range of k, projection features and size, segment names.
SEED = 42
K_RANGE = range(2, 7)
PCA_COLUMNS = ["frequency", "unique_categories", "avg_basket_size", "recency_days"]
MAX_POINTS = 5000
SEGMENT_LABELS = [
    "Frecuente y activo",
    "Comprador regular",
    "Ocasional activo",
    "Fiel pero distante",
    "Inactivo",
    "Nuevo / Esporádico",
    "Explorador",
    "Bajo valor",
]
UNKNOWN_LABEL = "Desconocido"


@dataclass(frozen=True)
class Segmentation:
    """A trained segmentation: the model, its clusters and the k comparison."""

    model: KMeansModel
    clusters: DataFrame
    selection: DataFrame


def train_segments(features: DataFrame, ks: Iterable[int] = K_RANGE, seed: int = SEED) -> Segmentation:
    """Try every k, keep the highest silhouette and assign all customers.

    The features are written to the shared folder first, ordered by customer:
    training reads them a hundred times, from partitions sized by their volume.
    The seeded start follows the partitions' order, so it repeats where the same
    features are partitioned alike.  A k above the number of different customers
    cannot be tried; it has a row without scores that says so.
    """
    table = staged(features.sortWithinPartitions("customer_id"), "features")
    ks = list(ks)
    # Spark's K-Means needs as many different rows as clusters.
    different = table.select(*FEATURE_COLUMNS).distinct().limit(max(ks)).count()
    if different < min(ks):
        raise ValueError(f"only {different} different customers for {min(ks)} segments")
    scaled = scaled_features(table).persist()
    try:
        models = {
            k: KMeans(k=k, seed=seed, featuresCol="scaled_features", predictionCol="cluster").fit(scaled)
            for k in ks
            if k <= different
        }
        found = silhouettes(models, scaled)
        best, tried = None, []
        for k, model in models.items():
            score = found[k]
            tried.append((k, score, model.summary.trainingCost))
            # A strict comparison keeps the first k among equals.
            if best is None or score > best[0]:
                best = (score, k, model)
    finally:
        scaled.unpersist()
    _, best_k, model = best
    selection = features.sparkSession.createDataFrame(
        [(k, score, cost, k == best_k, None) for k, score, cost in tried]
        + [(k, None, None, False, f"only {different} different customers") for k in ks if k > different],
        "k bigint, silhouette double, wssse double, selected boolean, skipped string",
    )
    return Segmentation(model, assign_segments(model, scaled), selection)


def silhouettes(models: dict[int, KMeansModel], scaled: DataFrame) -> dict[int, float]:
    """Silhouette of every model's clusters, all of them in one pass over the customers."""
    points = scaled
    for k, model in models.items():
        points = model.copy({model.predictionCol: f"k{k}"}).transform(points)
    names = [f"k{k}" for k in models]
    points = points.select(vector_to_array("scaled_features").alias("at"), *names)
    rows = silhouette.scores(points, names, len(FEATURE_COLUMNS)).collect()  # a row for each k
    return {int(row["clustering"][1:]): row["silhouette"] for row in rows}


def assign_segments(model: KMeansModel, scaled: DataFrame) -> DataFrame:
    return model.transform(scaled).select("customer_id", "cluster", *FEATURE_COLUMNS)


def cluster_profiles(clusters: DataFrame) -> DataFrame:
    """Size and mean behaviour of every cluster, unrounded."""
    return clusters.groupBy(F.col("cluster").alias("cluster_id")).agg(
        F.count("customer_id").alias("customer_count"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("unique_categories").alias("avg_unique_categories"),
        F.avg("avg_basket_size").alias("avg_basket_size"),
        F.avg("recency_days").alias("avg_recency_days"),
    )


def cluster_labels(profiles: DataFrame) -> DataFrame:
    """Rank clusters by high frequency and low recency, best first, and name them.

    Works on one row per cluster, so the windows over all rows stay tiny.
    """
    everything = Window.partitionBy()

    def scaled(column: str):
        return min_max_scaled(
            F.col(column), F.min(column).over(everything), F.max(column).over(everything)
        )

    names = F.array(*[F.lit(label) for label in SEGMENT_LABELS])
    best_first = Window.orderBy(F.desc("score"), F.desc("cluster_id"))
    return (
        profiles.withColumn("score", scaled("avg_frequency") - scaled("avg_recency_days"))
        .withColumn("rank", F.row_number().over(best_first).cast("bigint"))
        .select(
            "cluster_id",
            "score",
            "rank",
            F.element_at(names, F.least("rank", F.lit(len(SEGMENT_LABELS))).cast("int")).alias("label"),
        )
    )


def labelled_profiles(clusters: DataFrame) -> DataFrame:
    """Profiles rounded for display, with their labels, by cluster."""
    profiles = cluster_profiles(clusters)
    labels = cluster_labels(profiles).select("cluster_id", "label")
    return (
        profiles.join(labels, "cluster_id")
        .select(
            "cluster_id",
            "customer_count",
            rounded(F.col("avg_frequency"), 2).alias("avg_frequency"),
            rounded(F.col("avg_unique_categories"), 2).alias("avg_unique_categories"),
            rounded(F.col("avg_basket_size"), 2).alias("avg_basket_size"),
            rounded(F.col("avg_recency_days"), 1).alias("avg_recency_days"),
            "label",
        )
        .orderBy("cluster_id")
    )


def customer_segments(clusters: DataFrame, customer_id: int | None = None) -> DataFrame:
    """Cluster, label and behaviour of one customer, or of all of them."""
    labels = cluster_labels(cluster_profiles(clusters)).select(
        F.col("cluster_id").alias("cluster"), "label"
    )
    chosen = clusters if customer_id is None else clusters.filter(F.col("customer_id") == customer_id)
    return chosen.join(labels, "cluster", "left").select(
        "customer_id",
        "cluster",
        F.col("frequency").cast("double").alias("frequency"),
        F.col("unique_categories").cast("double").alias("unique_categories"),
        rounded(F.col("avg_basket_size"), 2).alias("avg_basket_size"),
        F.col("recency_days").cast("double").alias("recency_days"),
        F.coalesce("label", F.lit(UNKNOWN_LABEL)).alias("label"),
    )


def pca_projection(features: DataFrame) -> DataFrame:
    """First two principal components of every customer's standardised behaviour.

    Each axis points to the side of its largest loading.  Scaling is by
    population deviation: one constant factor away from the sample deviation
    Spark divides by.
    """
    customers = features.count()
    if customers < 2:
        raise ValueError(f"a projection needs two customers or more, not {customers}")
    vectors = VectorAssembler(inputCols=PCA_COLUMNS, outputCol="raw").transform(
        features.fillna(0, PCA_COLUMNS)
    )
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
    scaled = scaler.fit(vectors).transform(vectors)
    model = PCA(k=2, inputCol="scaled", outputCol="components").fit(scaled)
    signs = [1.0 if axis[abs(axis).argmax()] >= 0 else -1.0 for axis in model.pc.toArray().T]
    population = (customers / (customers - 1)) ** 0.5
    components = vector_to_array("components")
    kept = [c for c in ("customer_id", "cluster") if c in features.columns]
    return model.transform(scaled).select(
        *kept,
        F.round(components[0] * F.lit(signs[0] * population), 4).alias("pca_x"),
        F.round(components[1] * F.lit(signs[1] * population), 4).alias("pca_y"),
    )


def pca_scatter(clusters: DataFrame, max_points: int = MAX_POINTS, seed: int = SEED) -> DataFrame:
    """Projected customers with their cluster, at most ``max_points`` of them.

    Axes are fitted on all customers; the sample, drawn in the order of a seeded
    sha-256 so that any engine can repeat it, only limits the points returned.
    """
    drawn = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("customer_id").cast("string")), 256)
    return (
        pca_projection(clusters)
        .orderBy(drawn, "customer_id")
        .limit(max_points)
        .select("customer_id", "pca_x", "pca_y", "cluster")
    )
