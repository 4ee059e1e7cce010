"""Customer behaviour from partial rows that can be added up.

A partial row holds what one customer did in one month: sums, the last day, and two
bitmaps, the days of the month and the categories bought.  Rows of different months add
up to the customer's whole behaviour, so a load computes the months it touched and no
others.  Bitmaps are 64-bit words; a category's word is its number divided by 64, so
only words that hold something are stored.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.analytics import METRICS
from basketry.operators.filters import check_limit
from basketry.schemas import FEATURE_COLUMNS

KEY = ["customer_id", "year_month"]
WORD = 64


def monthly_state(baskets: DataFrame) -> DataFrame:
    """One row per customer and month."""
    size = F.col("basket_size")
    day = F.expr("shiftleft(1L, dayofmonth(date))")
    sums = baskets.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum(size).alias("lines"),
        F.sum(size * size).alias("squared_sizes"),
        F.max("date").alias("last_date"),
        F.bit_or(day).alias("days"),
    )
    category = F.col("category_id")
    bit = F.expr("shiftleft(1L, cast(pmod(category_id, 64) as int))")
    words = (
        baskets.select(*KEY, F.explode("categories").alias("category_id"))
        .groupBy(*KEY, F.floor(category / WORD).cast("bigint").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("categories"))
    )
    return sums.join(words, KEY, "left").select(
        "customer_id", "transactions", "lines", "squared_sizes", "last_date", "days", "categories", "year_month"
    )


def _unique_categories(state: DataFrame) -> DataFrame:
    words = state.select("customer_id", F.inline("categories")).groupBy("customer_id", "word")
    bits = F.bit_count("bits").cast("bigint")
    return words.agg(F.bit_or("bits").alias("bits")).groupBy("customer_id").agg(F.sum(bits).alias("unique_categories"))


def _added_up(state: DataFrame) -> DataFrame:
    sums = state.groupBy("customer_id").agg(
        F.sum("transactions").alias("frequency"),
        F.sum("lines").alias("total_categories_bought"),
        F.sum("squared_sizes").alias("squared_sizes"),
        F.max("last_date").alias("last_date"),
        # Months have no day in common.
        F.sum(F.bit_count("days").cast("bigint")).alias("active_days"),
    )
    return sums.join(_unique_categories(state), "customer_id", "left").fillna(0, ["unique_categories"])


def features_of(state: DataFrame) -> DataFrame:
    """The features of all customers; recency counts from the newest date of the state."""
    reference_date = state.agg(F.max("last_date")).scalar()
    return _added_up(state).withColumns({
        "avg_basket_size": F.col("total_categories_bought") / F.col("frequency"),
        "recency_days": F.datediff(reference_date, F.col("last_date")).cast("bigint"),
    }).select("customer_id", *FEATURE_COLUMNS)


def metrics_of(state: DataFrame) -> DataFrame:
    """The customer metrics that are correlated."""
    weighted = F.col("squared_sizes") / F.col("total_categories_bought")
    return _added_up(state).withColumn("avg_basket_size_line_weighted", weighted).select("customer_id", *METRICS)


def top_customers_of(state: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` customers with most transactions, ranked also by diversity; whole months can be chosen before."""
    busiest = (
        state.groupBy("customer_id")
        .agg(F.sum("transactions").alias("transaction_count"))
        .orderBy(F.desc("transaction_count"), "customer_id")
        .limit(check_limit(limit))
    )
    theirs = state.join(F.broadcast(busiest), "customer_id", "left_semi")
    by_count = Window.orderBy(F.desc("transaction_count"), "customer_id")
    by_diversity = Window.orderBy(F.desc("unique_categories"), F.desc("transaction_count"), "customer_id")
    return busiest.join(_unique_categories(theirs), "customer_id").withColumns({
        "rank_by_transactions": F.row_number().over(by_count).cast("bigint"),
        "rank_by_diversity": F.row_number().over(by_diversity).cast("bigint"),
    })
