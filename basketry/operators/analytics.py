"""Time series, box plots and customer correlations."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.stats import correlation, weighted_quartiles
from basketry.operators.filters import (
    DIMENSIONS,
    GRANULARITIES,
    between,
    check_choice,
    check_limit,
)
from basketry.operators.summary import unique_categories

Date = datetime.date | str | None

LABELS_CONSIDERED = 50  # Fixed value: busiest labels a box plot chooses from.
METRICS = ["frequency", "unique_categories", "avg_basket_size_line_weighted"]


def time_series(
    baskets: DataFrame,
    granularity: str = "day",
    start_date: Date = None,
    end_date: Date = None,
    store_id: int | None = None,
) -> DataFrame:
    """Transactions and category lines per day, ISO week or month."""
    check_choice("granularity", granularity, GRANULARITIES)
    period = F.col("date") if granularity == "day" else F.trunc("date", granularity)
    return (
        between(baskets, start_date, end_date, store_id)
        .groupBy(period.alias("period"))
        .agg(F.count(F.lit(1)).alias("transactions"), F.sum("basket_size").alias("category_lines"))
        .orderBy("period")
    )


def basket_sizes(
    baskets: DataFrame, start_date: Date = None, end_date: Date = None, store_id: int | None = None
) -> DataFrame:
    return between(baskets, start_date, end_date, store_id).select("transaction_id", "basket_size")


def boxplot(
    baskets: DataFrame,
    categories: DataFrame,
    dimension: str = "category",
    limit: int = 15,
    start_date: Date = None,
    end_date: Date = None,
    store_id: int | None = None,
) -> DataFrame:
    """Five-number summary of basket size per category name or per customer."""
    if check_choice("dimension", dimension, DIMENSIONS) == "category":
        return boxplot_category(baskets, categories, limit, start_date, end_date, store_id)
    return boxplot_customer(baskets, limit, start_date, end_date, store_id)


def boxplot_category(
    baskets: DataFrame,
    categories: DataFrame,
    limit: int = 15,
    start_date: Date = None,
    end_date: Date = None,
    store_id: int | None = None,
) -> DataFrame:
    """Box plot by category name; categories without a name have no box.

    Categories may share a name, and a basket that holds several of them counts
    once under it: at the first of them it holds.  That is decided inside the
    basket's own row, before its categories become rows of their own, so the
    baskets are never shuffled and a row holds numbers only.
    """
    names = categories.filter(F.col("category_name").isNotNull())
    names = names.select("category_id", F.col("category_name").alias("label"))
    same_name = names.groupBy("label").agg(F.sort_array(F.collect_set("category_id")).alias("ids"))
    # Few names are shared by categories; their lists are one value.
    shared = same_name.filter(F.size("ids") > 1).agg(F.collect_list("ids")).scalar()

    def after_the_first(ids):
        held = F.array_intersect(ids, F.col("categories"))
        return F.slice(held, F.lit(2), F.size(held))

    chosen = between(baskets, start_date, end_date, store_id)
    sizes = chosen.select("basket_size", "categories", shared.alias("shared")).select(
        "basket_size", "categories", F.flatten(F.transform("shared", after_the_first)).alias("again")
    )
    line = F.transform(
        "categories",
        lambda c: F.struct(c.alias("category_id"), (~F.array_contains("again", c)).cast("bigint").alias("first")),
    )
    counts = (
        sizes.select("basket_size", F.inline(line))
        .groupBy("category_id", "basket_size")
        .agg(F.sum("first").alias("transactions"), F.count(F.lit(1)).alias("weight"))
        .join(names, "category_id")
        .groupBy("label", "basket_size")
        .agg(F.sum("transactions").alias("transactions"), F.sum("weight").alias("weight"))
    )
    # There are no more labels than categories, so all of them are summarised.
    busiest = _five_numbers(counts).orderBy(F.desc("weight"), "label").limit(LABELS_CONSIDERED)
    return _highest_medians(busiest, limit)


def boxplot_customer(
    baskets: DataFrame,
    limit: int = 15,
    start_date: Date = None,
    end_date: Date = None,
    store_id: int | None = None,
) -> DataFrame:
    """Box plot by customer.

    The busiest customers are found by counting alone and only their baskets
    are summarised: a list of 50, so it is broadcast.  Sizes are counted before
    quartiles are taken, so no customer's baskets are gathered.
    """
    chosen = between(baskets, start_date, end_date, store_id).withColumn(
        "label", F.col("customer_id").cast("string")
    )
    busiest = (
        chosen.groupBy("label")
        .agg(F.count(F.lit(1)).alias("weight"))
        .orderBy(F.desc("weight"), "label")
        .limit(LABELS_CONSIDERED)
    )
    counts = (
        chosen.join(F.broadcast(busiest), "label", "left_semi")
        .groupBy("label", "basket_size")
        .agg(F.count(F.lit(1)).alias("transactions"))
        .withColumn("weight", F.col("transactions"))
    )
    return _highest_medians(_five_numbers(counts), limit)


def _five_numbers(counts: DataFrame) -> DataFrame:
    """Five-number summary and total weight per label.

    ``counts`` holds (label, basket_size, transactions, weight).
    """
    return counts.groupBy("label").agg(
        F.min("basket_size").alias("min_val"),
        weighted_quartiles("basket_size", "transactions").alias("quartiles"),
        F.max("basket_size").alias("max_val"),
        F.sum("weight").alias("weight"),
    )


def _highest_medians(summaries: DataFrame, limit: int) -> DataFrame:
    return (
        summaries.select(
            "label",
            "min_val",
            F.col("quartiles")[0].alias("q1"),
            F.col("quartiles")[1].alias("median"),
            F.col("quartiles")[2].alias("q3"),
            "max_val",
        )
        .orderBy(F.desc("median"), "label")
        .limit(check_limit(limit))
    )


def customer_metrics(baskets: DataFrame) -> DataFrame:
    """Frequency, diversity and the basket size met by an average *line* of each customer."""
    size = F.col("basket_size")
    per_customer = baskets.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("frequency"),
        (F.sum(size * size) / F.sum(size)).alias("avg_basket_size_line_weighted"),
    )
    return per_customer.join(unique_categories(baskets), "customer_id").select(
        "customer_id", *METRICS
    )


def correlation_matrix(metrics: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of customer metrics, in long form.

    One pass computes the three distinct pairs; a constant metric gives NULL.
    """
    pairs = [(x, y) for i, x in enumerate(METRICS) for y in METRICS[i:]]
    one_row = metrics.agg(
        *[F.round(correlation(x, y), 3).alias(f"{x}:{y}") for x, y in pairs]
    )
    cells = F.array(*[
        F.struct(
            F.lit(x).alias("feature_x"),
            F.lit(y).alias("feature_y"),
            F.col(f"`{x}:{y}`" if (x, y) in pairs else f"`{y}:{x}`").alias("correlation"),
        )
        for x in METRICS
        for y in METRICS
    ])
    return one_row.select(F.inline(cells))
