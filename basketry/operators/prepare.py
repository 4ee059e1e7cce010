"""Raw receipts to baskets and lines.

One shuffle is enough for both tables: baskets group the categorised items by
transaction, and lines are the baskets exploded again.  The grouping combines
on the map side, so a receipt key that fills a third of the input still reaches
its reducer as a few short category sets.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.labels import id_list
from basketry.functions.receipts import (
    iso_date,
    product_codes,
    tokens,
    transaction_id,
    whole_number,
    year_month,
)
from basketry.functions.stats import rounded
from basketry.schemas import RECEIPT_KEY, TRANSACTION_COLUMNS


def with_transaction(df: DataFrame) -> DataFrame:
    """Add the transaction id and the month that follow from the receipt key."""
    date, store_id, customer_id = (F.col(c) for c in RECEIPT_KEY)
    return df.withColumns({
        "transaction_id": transaction_id(date, store_id, customer_id),
        "year_month": year_month(date),
    })


def receipt_key() -> list[Column]:
    return [
        iso_date(F.col("date").cast("string")).alias("date"),
        F.col("store_id").cast("bigint").alias("store_id"),
        F.col("customer_id").cast("bigint").alias("customer_id"),
    ]


def parse_receipts(raw: DataFrame) -> DataFrame:
    """Raw receipts with a DATE, a transaction id and their product codes.

    Receipts without a readable date or without a single numeric token go.
    """
    parsed = raw.select(
        *receipt_key(), product_codes(F.col("products_raw")).alias("products")
    ).filter(F.col("date").isNotNull() & (F.size("products") > 0))
    return with_transaction(parsed).select(*TRANSACTION_COLUMNS, "products")


def receipt_items(raw: DataFrame) -> DataFrame:
    """One row per product code on a raw receipt.

    Tokens are exploded first and then read one per row, which stays inside
    generated code; the same codes as ``parse_receipts`` finds.
    """
    return (
        raw.select(*receipt_key(), F.explode(tokens(F.col("products_raw"))).alias("token"))
        .withColumn("product_code", whole_number(F.col("token")))
        .filter(F.col("date").isNotNull() & F.col("product_code").isNotNull())
        .select(*RECEIPT_KEY, "product_code")
    )


def categorise(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Category of each item; unknown products drop out, several categories fan out.

    No broadcast hint: Catalyst broadcasts the catalog when its size allows, and
    otherwise sort-merges, where adaptive execution splits a best-selling code.
    """
    return items.join(catalog, "product_code").select(*RECEIPT_KEY, "category_id")


def build_baskets(categorised: DataFrame) -> DataFrame:
    """One row per transaction with its sorted distinct categories.

    Takes categorised items or lines; repeated categories collapse.
    """
    grouped = (
        categorised.groupBy(*RECEIPT_KEY)
        .agg(F.sort_array(F.collect_set("category_id")).alias("categories"))
        .withColumn("basket_size", F.size("categories").cast("bigint"))
        .filter(F.col("basket_size") > 0)
    )
    return with_transaction(grouped).select(*TRANSACTION_COLUMNS, "categories", "basket_size")


def build_lines(categorised: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per transaction and category, named where the dimension has a name."""
    distinct = categorised.select(*RECEIPT_KEY, "category_id").distinct()
    return name_lines(with_transaction(distinct), categories)


def lines_of(baskets: DataFrame, categories: DataFrame) -> DataFrame:
    """Lines from finished baskets; needs no shuffle of the baskets."""
    exploded = baskets.select(*TRANSACTION_COLUMNS, F.explode("categories").alias("category_id"))
    return name_lines(exploded, categories)


def name_lines(lines: DataFrame, categories: DataFrame) -> DataFrame:
    """Lines with their category's name.

    Catalyst broadcasts a dimension that is read from a file of small size.  A
    caller whose dimension is derived, so that its size is only estimated, and
    who knows it to be small, says so with ``F.broadcast``: else all lines may
    be shuffled over a few dozen categories.
    """
    return lines.join(categories, "category_id", "left").select(
        *TRANSACTION_COLUMNS, "category_id", "category_name"
    )


def ingest_report(baskets: DataFrame) -> DataFrame:
    """One row: what a bulk load produced."""
    return baskets.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("basket_size").alias("category_lines"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        id_list(F.collect_set("store_id")).alias("stores"),
        rounded(F.try_divide(F.sum("basket_size"), F.count(F.lit(1))), 2).alias("avg_basket_size"),
    )
