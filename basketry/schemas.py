"""Table schemas.

Dates are DATE and every identifier is BIGINT, so files written by the bulk
load and by the incremental load always agree.
"""

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

PARTITION_COLUMNS = ["store_id", "year_month"]

# What makes a transaction.  Big tables are grouped and joined on these three
# fixed-width columns; the text id and the month follow from them and are worked
# out once per row that is kept, or not at all when a report does not show them.
RECEIPT_KEY = ["date", "store_id", "customer_id"]

# Columns shared by all rows of one transaction.
TRANSACTION_COLUMNS = ["transaction_id", *RECEIPT_KEY, "year_month"]

RAW_RECEIPTS = StructType([
    StructField("date", StringType()),
    StructField("store_id", LongType()),
    StructField("customer_id", LongType()),
    StructField("products_raw", StringType()),
])

CATEGORIES = StructType([
    StructField("category_id", LongType()),
    StructField("category_name", StringType()),
])

CATALOG = StructType([
    StructField("product_code", LongType()),
    StructField("category_id", LongType()),
])

LINES = StructType([
    StructField("transaction_id", StringType()),
    StructField("date", DateType()),
    StructField("customer_id", LongType()),
    StructField("category_id", LongType()),
    StructField("category_name", StringType()),
    StructField("store_id", LongType()),
    StructField("year_month", StringType()),
])

BASKETS = StructType([
    StructField("transaction_id", StringType()),
    StructField("date", DateType()),
    StructField("customer_id", LongType()),
    StructField("categories", ArrayType(LongType())),
    StructField("basket_size", LongType()),
    StructField("store_id", LongType()),
    StructField("year_month", StringType()),
])

INCOMING = StructType([
    StructField("date", DateType()),
    StructField("store_id", LongType()),
    StructField("customer_id", LongType()),
    StructField("categories", ArrayType(LongType())),
])

RULES = StructType([
    StructField("antecedent", ArrayType(LongType())),
    StructField("consequent", ArrayType(LongType())),
    StructField("confidence", DoubleType()),
    StructField("lift", DoubleType()),
    StructField("support", DoubleType()),
])

FEATURE_COLUMNS = [
    "frequency",
    "total_categories_bought",
    "unique_categories",
    "avg_basket_size",
    "recency_days",
    "active_days",
]

CLUSTERS = StructType([
    StructField("customer_id", LongType()),
    StructField("cluster", IntegerType()),
    StructField("frequency", LongType()),
    StructField("total_categories_bought", LongType()),
    StructField("unique_categories", LongType()),
    StructField("avg_basket_size", DoubleType()),
    StructField("recency_days", LongType()),
    StructField("active_days", LongType()),
])
