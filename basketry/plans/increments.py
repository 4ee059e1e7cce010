"""Models and aggregates that follow a load instead of being rebuilt.

A load is named by its caller.  What it replaced is written down before the tables are
touched, and every result says which load it includes, so a load that broke off is
finished by running it again under its name, and one that was finished does nothing.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import customer_state, distinct_cube, itemsets, rules
from basketry.plans.ingest import Store
from basketry.schemas import BASKETS, PARTITION_COLUMNS, RECEIPT_KEY
from basketry.session import staged
from basketry.sources import readers, writers
from basketry.streaming import incremental

ITEMSETS = "items array<bigint>, freq bigint, transactions bigint, min_support double, loads bigint, load string"


def read_itemsets(spark: SparkSession, store: Store) -> tuple[itemsets.Itemsets, int, str] | None:
    """The newest stored counts, the number of loads in them and the last one's name."""
    if not readers.table_exists(spark, store.itemsets):
        return None
    stored = spark.read.schema(ITEMSETS).parquet(store.itemsets)
    last = stored.agg(F.max(F.struct("loads", "load", "transactions", "min_support")).alias("last")).first()["last"]
    counts = stored.filter(F.col("loads") == last["loads"]).select("items", "freq")
    return itemsets.Itemsets(counts, last["transactions"], last["min_support"]), last["loads"], last["load"]


def write_itemsets(spark: SparkSession, store: Store, state: itemsets.Itemsets, loads: int, load: str) -> None:
    """Counts of one more load, beside the earlier ones until readers have moved on."""
    said = [F.lit(state.transactions).alias("transactions"), F.lit(state.min_support).alias("min_support"), F.lit(load).alias("load")]
    state.counts.select("items", "freq", *said).write.mode("overwrite").parquet(f"{store.itemsets}/loads={loads}")


def mine_from_stored(spark: SparkSession, store: Store, min_support: float = rules.MIN_SUPPORT, load: str = "") -> None:
    """The first counts, from all stored baskets."""
    state = itemsets.mined(readers.read_baskets(spark, store.baskets), min_support)
    write_itemsets(spark, store, state, 0, load)


def refresh_customer_months(spark: SparkSession, store: Store, months: list[str] | None = None) -> None:
    """Partial rows of the given months, or of all; no other month is read."""
    _by_month(customer_state.monthly_state(_of_months(spark, store, months)), store.customer_months)


def refresh_customer_cube(spark: SparkSession, store: Store, months: list[str] | None = None) -> None:
    _by_month(distinct_cube.customer_cube(_of_months(spark, store, months)), store.customer_cube)


def _of_months(spark: SparkSession, store: Store, months: list[str] | None) -> DataFrame:
    baskets = readers.read_baskets(spark, store.baskets)
    return baskets if months is None else baskets.filter(F.col("year_month").isin(months))


def _by_month(df: DataFrame, path: str) -> None:
    balanced = df.hint("rebalance", "year_month")
    balanced.write.partitionBy("year_month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_and_follow(
    spark: SparkSession, incoming: DataFrame, categories: DataFrame, store: Store, load: str,
    min_confidence: float = rules.MIN_CONFIDENCE,
) -> list[str]:
    """Merge a batch, then bring item sets, rules, customer months and the cube up to date; returns the touched months."""
    incremental.ensure_tables(spark, store)
    known = read_itemsets(spark, store)
    if known and known[2] == load:
        return []
    keys = readers.valid_incoming(incoming).select(*RECEIPT_KEY).distinct()
    touched = keys.select("store_id", F.date_format("date", "yyyy-MM").alias("year_month")).distinct()
    # At most as many rows as the table has partitions.
    named = sorted(tuple(row) for row in touched.select(*PARTITION_COLUMNS).collect())

    def baskets() -> DataFrame:
        stored = readers.read_partitions(spark, store.baskets, BASKETS, named)
        return stored.join(keys, RECEIPT_KEY, "left_semi")

    replaced = f"{store.base}/replaced/{load}"
    if not readers.table_exists(spark, replaced):
        writers.write_table(baskets(), replaced)
    incremental.merge_batch(spark, incoming, categories, store)
    months = sorted({month for _, month in named})
    refresh_customer_months(spark, store, months)
    refresh_customer_cube(spark, store, months)
    if known:
        state, loads, _ = known
        removed = spark.read.schema(BASKETS).parquet(replaced)
        everything = readers.read_baskets(spark, store.baskets)
        # Read several times over.
        added = staged(baskets().select("categories"), "added")
        state = itemsets.updated(state, added, everything, removed)
        writers.write_table(itemsets.rules_of(state, min_confidence), store.rules)
        write_itemsets(spark, store, state, loads + 1, load)
    return months
