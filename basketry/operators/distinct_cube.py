"""Exact numbers of customers and transactions for any dates and stores, without reading baskets.

The cube has a cell for every day and store with the bitmap of its customers, cut into
words of 64 numbers, so that few customers among many take a row of some dozen bytes.
Words of any cells can be or-ed, so a customer who comes on many days or to many stores
counts once.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.schemas import PARTITION_COLUMNS


def customer_cube(baskets: DataFrame) -> DataFrame:
    """One row per day, store and word of customers; a transaction counts in its customer's word."""
    bucket = F.shiftright("customer_id", 6).alias("bucket")
    bit = F.expr("shiftleft(1L, cast(customer_id & 63 AS int))")
    return baskets.groupBy("date", *PARTITION_COLUMNS, bucket).agg(
        F.bit_or(bit).alias("customers"),
        F.count(F.lit(1)).alias("transactions"),
        F.sum("basket_size").alias("category_lines"),
    )


def counted(cells: DataFrame) -> DataFrame:
    """One row: customers, transactions and lines of the cells that a filter has left."""
    buckets = cells.groupBy("bucket").agg(
        F.bit_or("customers").alias("customers"),
        F.sum("transactions").alias("transactions"),
        F.sum("category_lines").alias("category_lines"),
    )
    return buckets.agg(
        F.coalesce(F.sum(F.bit_count("customers")), F.lit(0)).alias("unique_customers"),
        F.coalesce(F.sum("transactions"), F.lit(0)).alias("transactions"),
        F.coalesce(F.sum("category_lines"), F.lit(0)).alias("category_lines"),
    )


def counted_ranges(cube: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same for many filters at once.

    ``ranges`` holds (range_id, start_date, end_date, store_id); a null store stands for all.  Each range is spelled
    out as months, and cells meet the ranges of their month.
    """
    months = F.sequence(F.trunc("start_date", "month"), F.trunc("end_date", "month"), F.expr("interval 1 month"))
    wanted = ranges.withColumn("year_month", F.explode(F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))))
    wanted = wanted.withColumnRenamed("store_id", "wanted_store")
    inside = F.col("date").between(F.col("start_date"), F.col("end_date"))
    inside &= F.col("wanted_store").isNull() | (F.col("wanted_store") == F.col("store_id"))
    buckets = cube.join(wanted, "year_month").filter(inside).groupBy("range_id", "bucket").agg(
        F.bit_or("customers").alias("customers"),
        F.sum("transactions").alias("transactions"),
        F.sum("category_lines").alias("category_lines"),
    )
    found = buckets.groupBy("range_id").agg(
        F.sum(F.bit_count("customers")).alias("unique_customers"),
        F.sum("transactions").alias("transactions"),
        F.sum("category_lines").alias("category_lines"),
    )
    return ranges.join(found, "range_id", "left").fillna(0, ["unique_customers", "transactions", "category_lines"])
