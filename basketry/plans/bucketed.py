"""Baskets laid out by customer.

A catalog table bucketed and sorted by customer holds all of a customer's baskets in one
bucket.  What is computed per customer then needs no shuffle of the baskets: not for
features and metrics, and not for a join with anything else bucketed alike.
"""

from pyspark.sql import DataFrame, SparkSession

from basketry.session import fresh_path


# The rows that one task should read, and the buckets of a small table.
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 8


def buckets_for(rows: int) -> int:
    """Buckets for a table of so many rows: a power of two, so that tables of other sizes can be joined with it."""
    return max(LEAST_BUCKETS, 1 << (max(rows - 1, 0) // BUCKET_ROWS).bit_length())


def write_by_customer(df: DataFrame, table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write a table with one file a bucket and return it as read from the catalog.

    ``buckets`` is the number of tasks that will ever share the table's work: ``buckets_for`` its rows, and the same
    number for every table that is to be joined with it.
    """
    spark = df.sparkSession
    (
        # Dealt out as buckets are, so that a task writes one file for the one bucket it holds.
        df.repartition(buckets, "customer_id")
        .write.bucketBy(buckets, "customer_id")
        .sortBy("customer_id")
        .option("path", path or fresh_path(spark, table))
        .mode("overwrite")
        .saveAsTable(table)
    )
    return read_by_customer(spark, table)


def read_by_customer(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
