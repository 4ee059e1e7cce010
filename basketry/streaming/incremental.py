"""Idempotent incremental load of transactions.

Stored lines are the only source of truth.  A batch adds the (transaction,
category) pairs that are not stored yet and then rebuilds the baskets of every
partition it names, whether or not it added anything there.  So a batch that is
sent again, or repeated after a crash between the two writes, adds no line and
still leaves the baskets right.  One writer at a time.
"""

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from basketry.functions.labels import name_or_id
from basketry.operators import prepare
from basketry.plans.ingest import Store
from basketry.schemas import BASKETS, LINES, PARTITION_COLUMNS, RECEIPT_KEY
from basketry.session import fresh_path
from basketry.sources import readers, writers


def incoming_lines(incoming: DataFrame, categories: DataFrame) -> DataFrame:
    """Distinct named lines of incoming transactions.

    Records of one customer, store and day are one transaction.  A category
    outside the dimension is called ``Cat <id>``.
    """
    exploded = readers.valid_incoming(incoming).select(
        *RECEIPT_KEY, F.explode("categories").alias("category_id")
    )
    distinct = exploded.filter(F.col("category_id").isNotNull()).distinct()
    return named_lines(distinct, categories)


def named_lines(distinct: DataFrame, categories: DataFrame) -> DataFrame:
    named = prepare.name_lines(prepare.with_transaction(distinct), categories)
    return named.withColumn(
        "category_name", name_or_id(F.col("category_name"), F.col("category_id"))
    )


def ensure_tables(spark: SparkSession, store: Store) -> None:
    """Create empty tables where there are none yet."""
    for path, schema in ((store.lines, LINES), (store.baskets, BASKETS)):
        empty = spark.createDataFrame([], schema)
        empty.write.partitionBy(*PARTITION_COLUMNS).mode("append").parquet(path)


def merge_batch(
    spark: SparkSession, incoming: DataFrame, categories: DataFrame, store: Store
) -> int:
    """Merge one batch into the stored tables; returns the number of lines added.

    Only the partitions the batch names are read, in both steps.
    """
    new = incoming_lines(incoming, categories).persist()
    try:
        # At most as many rows as the tables have partitions.
        named = [tuple(row) for row in new.select(*PARTITION_COLUMNS).distinct().collect()]
        if not named:
            return 0

        def stored_lines() -> DataFrame:
            return readers.read_partitions(spark, store.lines, LINES, sorted(named))

        key = [*RECEIPT_KEY, "category_id"]
        added = writers.write_partitioned(
            new.join(stored_lines().select(*key), key, "left_anti"),
            store.lines,
            mode="append",
            measures={"lines": F.count(F.lit(1))},
        )
        # Just the named partitions are read, so nothing is left to be filtered.
        writers.write_partitioned(prepare.build_baskets(stored_lines()), store.baskets)
        return added["lines"]
    finally:
        new.unpersist()


def start_incremental_load(
    incoming: DataFrame,
    categories: DataFrame,
    store: Store,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run ``merge_batch`` on every micro-batch of an incoming stream.

    By default everything that has arrived is loaded and the query ends.  Keep
    ``checkpoint`` the same from run to run, so that files are looked at once.
    Records that are not valid are appended to ``store.rejected``.
    """
    spark = incoming.sparkSession
    ensure_tables(spark, store)

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch.sparkSession, batch, categories, store)
        # A folder for each micro-batch: one that is repeated replaces its own.
        rejected = readers.rejected_incoming(batch)
        rejected.write.mode("overwrite").json(f"{store.rejected}/batch={batch_id}")

    return (
        incoming.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def landed(spark: SparkSession, batch: DataFrame) -> DataFrame:
    """A micro-batch written once and read by the session that started its stream.

    A stream with state has no adaptive execution and drops the hint to rebalance, so
    every task would write a file for each partition of the table that it meets.
    """
    path = fresh_path(spark, "micro-batch")
    batch.write.parquet(path)
    return spark.read.schema(batch.schema).parquet(path)


def start_deduplicated_lines(
    incoming: DataFrame,
    categories: DataFrame,
    lines_path: str,
    checkpoint: str,
    delay: datetime.timedelta = datetime.timedelta(days=7),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append-only variant: resent lines are dropped by bounded streaming state.

    State is kept for ``delay`` after a line's date.  Lines that come later than
    that are not loaded; use ``start_incremental_load`` where they must be, or
    ``start_parted_lines`` to keep them apart.  Every micro-batch has a folder of
    its own, which a repeated one replaces; within it, files are split and put
    together by their volume.
    """
    spark = incoming.sparkSession
    watermark = f"{int(delay.total_seconds())} seconds"
    exploded = readers.valid_incoming(incoming).select(
        *RECEIPT_KEY,
        F.explode("categories").alias("category_id"),
        F.col("date").cast("timestamp").alias("event_ts"),
    )
    distinct = (
        exploded.filter(F.col("category_id").isNotNull())
        .withWatermark("event_ts", watermark)
        .dropDuplicatesWithinWatermark([*RECEIPT_KEY, "category_id"])
        .drop("event_ts")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        writers.write_partitioned(landed(spark, batch), f"{lines_path}/batch={batch_id}")

    return (
        named_lines(distinct, categories)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_parted_lines(
    incoming: DataFrame,
    categories: DataFrame,
    lines_path: str,
    late_path: str,
    checkpoint: str,
    delay: datetime.timedelta = datetime.timedelta(days=7),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append-only variant that keeps late lines apart instead of dropping them.

    A line is late if its date is more than ``delay`` before the newest date of
    all earlier micro-batches.  That high-water mark is stored with the
    checkpoint, one for each micro-batch.  Lines that an earlier micro-batch has
    written to either table are not written again, whenever they come.  A
    micro-batch writes folders of its own and its mark last, so one that is
    repeated finds the same mark and replaces what it had written.
    """
    marks = f"{checkpoint}/high_water"
    key = [*RECEIPT_KEY, "category_id"]

    def part(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        lines = incoming_lines(batch, categories).persist()
        try:
            newest = None
            if readers.table_exists(spark, marks):
                before = spark.read.schema("mark date, batch bigint").parquet(marks)
                newest = before.filter(F.col("batch") < batch_id).agg(F.max("mark")).first()[0]
            # At most as many rows as the tables have months.
            months = [row[0] for row in lines.select("year_month").distinct().collect()]
            new = lines
            for path in (lines_path, late_path):
                if readers.table_exists(spark, path):
                    stored = readers.read_batches(spark, path, batch_id)
                    stored = stored.filter(F.col("year_month").isin(months))
                    new = new.join(stored.select(*key), key, "left_anti")
            late = F.lit(False) if newest is None else F.col("date") < F.lit(newest - delay)
            for path, chosen in ((lines_path, ~late), (late_path, late)):
                writers.write_partitioned(new.filter(chosen), f"{path}/batch={batch_id}")
            mark = F.greatest(F.max("date"), F.lit(newest).cast("date")).alias("mark")
            lines.agg(mark).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
        finally:
            lines.unpersist()

    return (
        incoming.writeStream.foreachBatch(part)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
