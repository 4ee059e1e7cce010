"""Compaction of stored partitions.

Every batch appends files of its own, so partitions that many batches named end up with
many small ones.  Partitions are picked by the sizes of their files alone; their rows
are dealt into files of the wanted size, written aside, and each partition is then
replaced as a whole.  A reader meets a partition's old files or its new ones, never
both; after a crash the rows lie in the table or aside.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketry.schemas import PARTITION_COLUMNS
from basketry.session import staged
from basketry.sources import readers

FILE_BYTES = 128 * 1024 * 1024


def partition_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(store_id, year_month, files, bytes, rows) of every partition; no column is read."""
    rows = readers.read_stored(spark, path, schema)
    of_file = rows.groupBy(*PARTITION_COLUMNS, "_metadata.file_path").agg(
        F.first("_metadata.file_size").alias("size"), F.count(F.lit(1)).alias("rows")
    )
    return of_file.groupBy(*PARTITION_COLUMNS).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum("rows").alias("rows")
    )


def compact(spark: SparkSession, path: str, schema: StructType, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rewrite the partitions that have more files than their bytes need.

    Returns them as they were, with the number of files ``wanted``.  One writer at a time, as for every other write.
    """
    wanted = F.greatest(F.ceil(F.col("bytes") / file_bytes), F.lit(1)).cast("int")
    found = partition_files(spark, path, schema).withColumn("wanted", wanted)
    picked = staged(found.filter(F.col("files") > F.col("wanted")), "picked")
    # At most as many rows as the table has partitions.
    named = [tuple(row) for row in picked.select(*PARTITION_COLUMNS).collect()]
    if named:
        rows = readers.read_partitions(spark, path, schema, sorted(named))
        columns = rows.columns
        # The number of a partition's files grows with its bytes, and so do the tasks that deal them out.
        share = F.pmod(F.xxhash64("transaction_id"), F.col("wanted")).alias("share")
        dealt = rows.join(picked.select(*PARTITION_COLUMNS, "wanted"), PARTITION_COLUMNS)
        dealt = dealt.select(*columns, share).repartition(*PARTITION_COLUMNS, "share")
        aside = staged(dealt.drop("share"), "compacted")
        (
            aside.write.partitionBy(*PARTITION_COLUMNS)
            .mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .parquet(path)
        )
    return picked
