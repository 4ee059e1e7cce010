"""Sharding into shards of nearly equal bytes by sampled splitters.

Records are ordered by a hash of their text, then of their id, so equal texts
stand together and even a text copied over a third of the table can be cut.
Each round draws key samples weighted by size from every overfull range, takes
quantiles of the samples as boundaries and range-partitions the records by
them, until no range is overfull.  Exact byte counts of the ranges then give
every record its place in the whole order, and the shard follows from it.

Only DataFrame operations; what is looked up per record is at most ``fan_out``
boundaries a round, and no window is larger than a range.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import staged

KEY = ["text_hash", "id_hash"]


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64(doc_id, F.lit("id")).alias("id_hash"),
    )


def range_sizes(ranged: DataFrame) -> DataFrame:
    key = F.struct(*KEY)
    return ranged.groupBy("range").agg(
        F.sum("size").alias("bytes"),
        F.count("*").alias("rows"),
        (F.min(key) != F.max(key)).alias("divisible"),
    )


def boundaries(ranged: DataFrame, overfull: DataFrame, round_: int, fan_out: int, per_part: int) -> DataFrame:
    """(range, cuts): up to ``fan_out`` - 1 ascending keys for each overfull range, from a size-weighted sample."""
    chance = F.col("size") * F.lit(float(fan_out * per_part)) / F.col("bytes")
    spread = F.lit(2**53)
    drawn = F.pmod(F.xxhash64(*KEY, F.lit(round_)), spread) / spread.cast("double")
    sample = ranged.join(overfull.select("range", "bytes"), "range").filter(drawn < chance)
    in_order = Window.partitionBy("range").orderBy(*KEY)
    ranked = sample.select(
        "range",
        F.struct(*KEY).alias("key"),
        F.row_number().over(in_order).alias("place"),
        F.count("*").over(Window.partitionBy("range")).alias("of"),
    )
    part = F.floor(F.col("place") * fan_out / F.col("of"))
    before = F.floor((F.col("place") - 1) * fan_out / F.col("of"))
    cuts = ranked.filter((part > before) & (F.col("place") < F.col("of")))
    return cuts.groupBy("range").agg(F.sort_array(F.collect_set("key")).alias("cuts"))


def shard(
    docs: DataFrame,
    shards: int = 40,
    fan_out: int = 32,
    per_part: int = 32,
    ranges_per_shard: int = 4,
    max_rows: int = 1_000_000,
) -> DataFrame:
    """Every record with its shard and its slot there, under the law ``bytes``.

    Needs ``doc_id`` and ``text``.  Shards hold equal shares of all bytes, to
    within one record, and equal texts are neighbours.  Slots count from 0 in
    key order; repeated rows take slots side by side.  An empty table gives no
    rows; other columns are not read.
    """
    ranged = staged(records(docs).withColumn("range", F.lit(0).cast("bigint")), "records")
    base, steps = ranged, []
    round_ = 0
    while True:
        sizes = staged(range_sizes(ranged), "ranges")
        total = sizes.agg(F.sum("bytes")).first()[0] or 0
        share = total / (shards * ranges_per_shard)
        overfull = sizes.filter("divisible").filter((F.col("bytes") > share) | (F.col("rows") > max_rows))
        round_ += 1
        if round_ > 12 or overfull.isEmpty():
            break
        steps.append(staged(boundaries(ranged, overfull, round_, fan_out, per_part), "boundaries"))
        ranged = base
        for cuts in steps:
            ranged = subdivided(ranged, cuts, fan_out)
    in_key_order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "range",
        F.coalesce(F.sum("bytes").over(in_key_order), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(in_key_order), F.lit(0)).alias("rows_before"),
    )
    in_range = Window.partitionBy("range").orderBy(*KEY, F.asc_nulls_first("doc_id"))
    upto = F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.select(
        "doc_id", "size", "text_crc32", "range", upto.alias("upto"), (F.row_number().over(in_range) - 1).alias("row")
    ).join(staged(starts, "starts"), "range")
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    placed = placed.withColumns({
        "shard": F.least(F.floor(middle * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int"),
        "row": F.col("rows_before") + F.col("row"),
    })
    placed = staged(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def subdivided(ranged: DataFrame, cuts: DataFrame, fan_out: int) -> DataFrame:
    """Ranges get ``fan_out`` numbers each; those without cuts use the first one, so key order is kept."""
    key = F.struct(*KEY)
    below = F.size(F.filter("cuts", lambda cut: cut <= key))
    part = F.when(F.col("cuts").isNull(), 0).otherwise(below)
    found = ranged.join(cuts, "range", "left")
    return found.withColumn("range", F.col("range") * fan_out + part).drop("cuts")
