"""The most frequent values by a sketch first, counted exactly after.

A sketch of bounded size names candidates and bounds how often any other value can
occur.  A second pass counts the candidates alone: nothing else is shuffled.  If the
last of the wanted values is more frequent than the bound, no value was missed; if not,
all values are counted.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED = 100_000  # counters of the sketch, a few MB


@dataclass(frozen=True)
class Candidates:
    """Values that may be among the most frequent; no other value occurs more than ``others_at_most`` times."""

    values: list
    others_at_most: float


def candidates(rows: DataFrame, column: str, wanted: int, tracked: int = TRACKED) -> Candidates:
    """At most ``wanted`` values and the bound of all others.

    A sketch of m counters over n rows is off by 3.5 n / m at most.  What it does not name has either been below twice
    that, or was estimated, never too low, to be no more frequent than the last it names.
    """
    sketch = F.expr(f"approx_top_k({column}, {wanted}, {tracked})").alias("top")
    row = rows.filter(F.col(column).isNotNull()).agg(sketch, F.count(F.lit(1)).alias("n")).first()
    found = [(x["item"], x["count"]) for x in row["top"]]
    error = 3.5 * row["n"] / tracked
    last = found[-1][1] if len(found) == wanted else 0
    return Candidates([item for item, _ in found], max(2 * error, last))


def most_frequent(rows: DataFrame, column: str, limit: int, spare: int = 10, tracked: int = TRACKED) -> DataFrame:
    """(column, count) of the ``limit`` most frequent values, equals in ascending order.

    ``spare`` times as many candidates are named as wanted.
    """
    def ranked(chosen: DataFrame) -> DataFrame:
        counts = chosen.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
        return counts.orderBy(F.desc("count"), column).limit(limit)

    named = candidates(rows, column, limit * spare, tracked)
    counted = ranked(rows.filter(F.col(column).isin(named.values))) if named.values else None
    if counted is not None:
        found = counted.collect()  # limit rows
        if len(found) == limit and found[-1]["count"] > named.others_at_most:
            return rows.sparkSession.createDataFrame(found, counted.schema)
    return ranked(rows.filter(F.col(column).isNotNull()))
