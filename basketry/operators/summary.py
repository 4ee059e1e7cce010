"""Executive-summary reports.

``lines`` hold one row per (transaction, category): the loaders and the
incremental merge both keep it so.  Reports lean on that: the number of
transactions that contain a category is the number of its lines, and
everything counted per transaction reads the far smaller ``baskets``.  None of
the big tables is then shuffled by transaction.
"""

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.labels import display_label
from basketry.functions.stats import rounded
from basketry.operators.filters import between, check_limit

Date = datetime.date | str | None

OTHERS = "Otros"  # Fixed value: name of the rolled-up remainder.


def total_lines(
    lines: DataFrame, start_date: Date = None, end_date: Date = None, store_id: int | None = None
) -> DataFrame:
    return between(lines, start_date, end_date, store_id).agg(F.count(F.lit(1)).alias("value"))


def transaction_count(
    baskets: DataFrame, start_date: Date = None, end_date: Date = None, store_id: int | None = None
) -> DataFrame:
    return between(baskets, start_date, end_date, store_id).agg(F.count(F.lit(1)).alias("value"))


def unique_customers(
    baskets: DataFrame, start_date: Date = None, end_date: Date = None, store_id: int | None = None
) -> DataFrame:
    return between(baskets, start_date, end_date, store_id).agg(
        F.count_distinct("customer_id").alias("value")
    )


def category_volumes(lines: DataFrame) -> DataFrame:
    """Lines per category; as many rows as there are categories."""
    return lines.groupBy("category_id", "category_name").agg(F.count(F.lit(1)).alias("volume"))


def top_categories(
    lines: DataFrame,
    limit: int = 10,
    start_date: Date = None,
    end_date: Date = None,
    store_id: int | None = None,
) -> DataFrame:
    """The ``limit`` categories with most lines, ranked by volume and by frequency.

    Both rankings order the same rows.
    """
    best = (
        category_volumes(between(lines, start_date, end_date, store_id))
        .withColumn("frequency", F.col("volume"))
        .orderBy(F.desc("volume"), "category_id")
        .limit(check_limit(limit))
    )
    by_volume = Window.orderBy(F.desc("volume"), "category_id")
    by_frequency = Window.orderBy(F.desc("frequency"), F.desc("volume"), "category_id")
    return best.withColumns({
        "rank_by_volume": F.row_number().over(by_volume).cast("bigint"),
        "rank_by_frequency": F.row_number().over(by_frequency).cast("bigint"),
    })


def top_customers(
    baskets: DataFrame,
    limit: int = 10,
    start_date: Date = None,
    end_date: Date = None,
    store_id: int | None = None,
) -> DataFrame:
    """The ``limit`` customers with most transactions, ranked also by diversity.

    Only the winners' baskets are opened for their distinct categories; the
    winners are at most 50 rows, so broadcasting them is safe at any scale.
    """
    chosen = between(baskets, start_date, end_date, store_id)
    best = (
        chosen.groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("transaction_count"))
        .orderBy(F.desc("transaction_count"), "customer_id")
        .limit(check_limit(limit))
    )
    diversity = unique_categories(chosen.join(F.broadcast(best), "customer_id", "left_semi"))
    ranked = best.join(diversity, "customer_id")
    by_transactions = Window.orderBy(F.desc("transaction_count"), "customer_id")
    by_diversity = Window.orderBy(
        F.desc("unique_categories"), F.desc("transaction_count"), "customer_id"
    )
    return ranked.withColumns({
        "rank_by_transactions": F.row_number().over(by_transactions).cast("bigint"),
        "rank_by_diversity": F.row_number().over(by_diversity).cast("bigint"),
    })


def unique_categories(baskets: DataFrame) -> DataFrame:
    """Distinct categories per customer, combined on the map side before the shuffle."""
    return (
        baskets.select("customer_id", F.explode("categories").alias("category_id"))
        .distinct()
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("unique_categories"))
    )


def peak_days(
    baskets: DataFrame, start_date: Date = None, end_date: Date = None, store_id: int | None = None
) -> DataFrame:
    """Transactions by day of week (0 = Sunday) and day of month."""
    return (
        between(baskets, start_date, end_date, store_id)
        .groupBy(
            (F.dayofweek("date") - 1).cast("bigint").alias("day_of_week"),
            F.dayofmonth("date").cast("bigint").alias("day_of_month"),
        )
        .agg(F.count(F.lit(1)).alias("transaction_count"))
        .orderBy("day_of_week", "day_of_month")
    )


def peak_days_grid(
    baskets: DataFrame, start_date: Date = None, end_date: Date = None, store_id: int | None = None
) -> DataFrame:
    """Every cell of the 7 x 31 calendar with its share of the busiest cell."""
    cell = F.col("id")
    grid = baskets.sparkSession.range(7 * 31).select(
        (cell % 7).alias("day_of_week"), (F.floor(cell / 7) + 1).alias("day_of_month")
    )
    counts = peak_days(baskets, start_date, end_date, store_id)
    busiest = F.max("transaction_count").over(Window.partitionBy())
    return (
        grid.join(counts, ["day_of_week", "day_of_month"], "left")
        .fillna(0, ["transaction_count"])
        .withColumn(
            "intensity",
            F.when(busiest > 0, F.col("transaction_count") / busiest).otherwise(F.lit(0.0)),
        )
        .orderBy("day_of_week", "day_of_month")
    )


def category_share(
    lines: DataFrame, start_date: Date = None, end_date: Date = None, store_id: int | None = None
) -> DataFrame:
    """Volume of each category and its percentage of all lines."""
    everything = F.sum("volume").over(Window.partitionBy())
    return (
        category_volumes(between(lines, start_date, end_date, store_id))
        .withColumn("share_pct", rounded(F.col("volume") * F.lit(100.0) / everything, 2))
        .orderBy(F.desc("volume"), "category_id")
    )


def category_share_rollup(
    lines: DataFrame,
    top: int = 10,
    start_date: Date = None,
    end_date: Date = None,
    store_id: int | None = None,
) -> DataFrame:
    """The ``top`` categories' shares and one row for all others, left out when it is 0."""
    ordering = Window.orderBy(F.desc("volume"), "category_id")
    rest = F.col("position") > top
    return (
        category_share(lines, start_date, end_date, store_id)
        .withColumn("position", F.least(F.row_number().over(ordering), F.lit(top + 1)).cast("bigint"))
        .groupBy("position", F.when(rest, OTHERS).otherwise(F.col("category_name")).alias("label"))
        .agg(rounded(F.sum("share_pct"), 2).alias("share_pct"))
        .filter(~rest | (F.col("share_pct") > 0))
        .orderBy("position")
    )


def category_map(lines: DataFrame) -> DataFrame:
    """Categories that occur, with the label shown for each."""
    return (
        lines.select("category_id", "category_name")
        .distinct()
        .withColumn("display_label", display_label(F.col("category_name"), F.col("category_id")))
        .orderBy("category_id")
    )


def category_names(lines: DataFrame) -> DataFrame:
    """One name per category that occurs: any it has in the lines rather than none."""
    return lines.groupBy("category_id").agg(F.max("category_name").alias("category_name"))
