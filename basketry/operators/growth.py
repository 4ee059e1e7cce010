"""How many baskets hold which sets, by growing prefixes.

Equal baskets are one row with a weight.  A row is taken apart into the first items of
the wanted sets that it holds, each with the basket's later items; a prefix grows by one
item at a time and goes on only if some wanted set begins with it.  So a basket costs as
many rows as it holds wanted prefixes, and what is shuffled are counts, combined first.

Frequent sets are found level by level: a set is counted if all its parts, one item
shorter, are frequent.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import staged

# Items of all sets together up to which sets are broadcast.
BROADCAST_ITEMS = 1_000_000


def weighted(baskets: DataFrame) -> DataFrame:
    """(held, weight): the sorted sets of categories and how many baskets have them."""
    held = F.array_sort(F.array_distinct("categories")).alias("held")
    whole = baskets.filter(F.col("categories").isNotNull())
    return whole.groupBy(held).agg(F.count(F.lit(1)).alias("weight"))


def counted(held: DataFrame, sets: DataFrame) -> DataFrame:
    """(items, freq) of those ``sets`` that occur; their items are sorted.  ``held`` should be a stored table."""
    lengths = {row[0]: row[1] for row in sets.groupBy(F.size("items")).count().collect()}
    # Where sets are few, the rows of all baskets stay where they are, whatever Spark's own threshold is.
    sent = F.broadcast if sum(n * size for size, n in lengths.items()) <= BROADCAST_ITEMS else lambda table: table
    rows = held.select(F.slice("held", 1, 0).alias("items"), F.col("held").alias("rest"), "weight")
    found = held.sparkSession.createDataFrame([], sets.select("items", F.lit(0).cast("bigint").alias("freq")).schema)
    for length in range(1, max(lengths, default=0) + 1):
        begun = sets.filter(F.size("items") >= length).select(F.slice("items", 1, length).alias("items")).distinct()
        still = min(size for size in lengths if size >= length) - length
        rows = grown(rows, still).join(sent(begun), "items", "left_semi")
        if length not in lengths:
            continue
        whole = rows.join(sent(sets.filter(F.size("items") == length)), "items", "left_semi")
        found = found.unionByName(whole.groupBy("items").agg(F.sum("weight").alias("freq")))
    return found


def grown(rows: DataFrame, still: int) -> DataFrame:
    """(items, rest, weight) with one more item, once for each of the rest that leaves ``still`` items or more."""
    enough = F.slice("rest", F.lit(1), F.greatest(F.size("rest") - still, F.lit(0)))
    each = rows.select("items", "rest", "weight", F.posexplode(enough).alias("place", "item"))
    return each.select(
        F.concat("items", F.array("item")).alias("items"),
        F.slice("rest", F.col("place") + 2, F.size("rest")).alias("rest"),
        "weight",
    )


def generated(frequent: DataFrame) -> DataFrame:
    """(items): the sets of two or more whose parts, one item shorter, are all frequent.

    Two sets that differ in their last item only make up one that is longer by one; it comes into question if its
    other parts are frequent too.
    """
    sides = frequent.select(F.slice("items", 1, F.size("items") - 1).alias("start"), F.element_at("items", -1).alias("end"))
    first, second = sides.alias("first"), sides.alias("second")
    joined = first.join(second, F.col("first.start") == F.col("second.start")).filter(F.col("first.end") < F.col("second.end"))
    longer = joined.select(F.concat("first.start", F.array("first.end", "second.end")).alias("items"))
    place = F.explode(F.sequence(F.lit(1), F.size("items"))).alias("place")
    parts = longer.select("items", place).select(
        "items",
        F.concat(
            F.slice("items", F.lit(1), F.col("place") - 1),
            F.slice("items", F.col("place") + 1, F.size("items")),
        ).alias("part"),
    )
    known = frequent.select(F.col("items").alias("part"))
    whole = parts.join(known, "part", "left_semi").groupBy("items").agg(F.count(F.lit(1)).alias("parts"))
    return whole.filter(F.col("parts") == F.size("items")).select("items")


def mined(baskets: DataFrame, min_support: float) -> tuple[DataFrame, int, int]:
    """Counts (items, freq) of the frequent sets and their border, the number of baskets, and the least frequent count."""
    held = staged(weighted(baskets), "held")
    transactions = held.agg(F.sum("weight")).first()[0] or 0
    least = max(1, math.ceil(min_support * transactions))
    single = held.select(F.explode("held").alias("item"), "weight").select(F.array("item").alias("items"), "weight")
    level = staged(single.groupBy("items").agg(F.sum("weight").alias("freq")), "itemsets")
    counts = level
    while True:
        candidates = staged(generated(level.filter(F.col("freq") >= least)), "candidates")
        if candidates.isEmpty():
            return counts, transactions, least
        level = candidates.join(counted(held, candidates), "items", "left").fillna(0, ["freq"])
        level = staged(level, "itemsets")
        counts = counts.unionByName(level)
