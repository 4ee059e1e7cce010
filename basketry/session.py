"""Where intermediate tables go, and the writes that cut lineage."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Whether a query's shuffle files go when it ends, and not only when the driver collects its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Texts that a Python task gets at a time.
BATCH_TEXTS = 1_000


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster
    without it is refused, because a machine-local folder would lose data
    together with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="basketry-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Iterative training reads its input a hundred times; from a written table a
    lost executor costs one re-read, not the whole job that made the table.  What
    was shuffled for it is of no more use then and goes from the disks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with setting(spark, CLEANUP_KEY, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting has this value meanwhile, and then its own again."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile gets its rows in small Arrow batches, or in smaller ones if the session says so.

    Ten thousand texts, as Spark deals them out, are held several times over: in the executor outside its heap, in
    the Python task as they came, and there again as the strings and words made from them.
    """
    before = int(spark.conf.get(BATCH_KEY))
    with setting(spark, BATCH_KEY, str(before if 0 < before <= BATCH_TEXTS else BATCH_TEXTS)):
        yield


def staged_texts(df: DataFrame, name: str) -> DataFrame:
    """As ``staged``, of what Python tasks make from texts or from lists as long as texts."""
    with small_batches(df.sparkSession):
        return staged(df, name)
