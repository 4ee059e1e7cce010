"""Frequent category sets kept up to date by increments.

Beside every frequent set its negative border is counted: the sets that are not frequent
although all their parts are.  New baskets then change the counts of known sets only by
what the new baskets hold.  Only where a set of the border becomes frequent, sets that
were never counted come into question, and all baskets are read again for those alone.

A border is bounded by the model, not by the baskets: pairs of frequent categories at
most, and for longer sets those that two frequent ones make up.
"""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import growth
from basketry.operators.rules import MIN_CONFIDENCE, MIN_SUPPORT, rules_of_counts
from basketry.session import staged


@dataclass(frozen=True)
class Itemsets:
    """Counts (items, freq) of the frequent sets and of their border, over so many transactions."""

    counts: DataFrame
    transactions: int
    min_support: float

    @property
    def least(self) -> int:
        """The least count of a frequent set."""
        return math.ceil(self.min_support * self.transactions)

    def frequent(self) -> DataFrame:
        return self.counts.filter(F.col("freq") >= self.least)


def mined(baskets: DataFrame, min_support: float = MIN_SUPPORT) -> Itemsets:
    """All counts from the beginning."""
    counts, _, _ = growth.mined(baskets, min_support)
    return _completed(Itemsets(counts, baskets.count(), min_support), baskets)


def updated(
    known: Itemsets, added: DataFrame, everything: DataFrame, removed: DataFrame | None = None
) -> Itemsets:
    """Counts after ``added`` baskets came and ``removed`` ones went.

    A basket that changed is both: removed as it was, added as it is.  ``everything`` holds all baskets as they are
    now; it is read only where new sets come into question.
    """
    transactions = known.transactions + added.count()
    counts = _sum(known.counts, _singles(added), _counted(added, known.counts))
    if removed is not None:
        transactions -= removed.count()
        gone = _sum(_singles(removed), _counted(removed, known.counts))
        counts = _sum(counts, gone.withColumn("freq", -F.col("freq")))
    counts = staged(counts, "itemsets")
    return _completed(Itemsets(counts, transactions, known.min_support), everything)


def _singles(baskets: DataFrame) -> DataFrame:
    """Every category as a set of one."""
    item = F.explode(F.array_distinct("categories")).alias("item")
    counted = baskets.select(item).groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    return counted.select(F.array("item").alias("items"), "freq")


def _sum(*counts: DataFrame) -> DataFrame:
    total = counts[0]
    for more in counts[1:]:
        total = total.unionByName(more)
    return total.groupBy("items").agg(F.sum("freq").alias("freq"))


def _counted(baskets: DataFrame, sets: DataFrame) -> DataFrame:
    """(items, freq) of the sets of two or more that baskets hold whole."""
    held = staged(growth.weighted(baskets), "held")
    return growth.counted(held, sets.filter(F.size("items") > 1).select("items"))


def _completed(state: Itemsets, everything: DataFrame) -> Itemsets:
    """Counts of just the frequent sets and the border, level by level where some are not known yet."""
    counts = state.counts
    while True:
        frequent = counts.filter(F.col("freq") >= state.least)
        border = staged(growth.generated(frequent), "border")
        unknown = staged(border.join(counts, "items", "left_anti"), "unknown")
        if unknown.isEmpty():
            break
        fresh = unknown.join(_counted(everything, unknown), "items", "left").fillna(0, ["freq"])
        counts = staged(counts.unionByName(fresh), "itemsets")
    kept = counts.join(border, "items", "left_semi").unionByName(counts.filter(F.size("items") == 1))
    return Itemsets(staged(kept.filter(F.col("freq").isNotNull()), "itemsets"), state.transactions, state.min_support)


def rules_of(state: Itemsets, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Association rules with one consequent each, as the miner gives them."""
    return rules_of_counts(state.frequent(), state.transactions, min_confidence)
