"""The optional date and store filter every report accepts, and argument checks."""

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The report size limits and the accepted dimension names.
MIN_LIMIT, MAX_LIMIT = 1, 50
GRANULARITIES = ("day", "week", "month")
DIMENSIONS = ("category", "customer")


def as_date(value: datetime.date | str) -> datetime.date:
    if isinstance(value, datetime.datetime):
        return value.date()
    return value if isinstance(value, datetime.date) else datetime.date.fromisoformat(value)


def check_limit(limit: int) -> int:
    if not MIN_LIMIT <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between {MIN_LIMIT} and {MAX_LIMIT}, got {limit}")
    return limit


def check_choice(name: str, value: str, choices: tuple[str, ...]) -> str:
    if value not in choices:
        raise ValueError(f"{name} must be one of {', '.join(choices)}, got {value!r}")
    return value


def between(
    df: DataFrame,
    start_date: datetime.date | str | None = None,
    end_date: datetime.date | str | None = None,
    store_id: int | None = None,
) -> DataFrame:
    """Keep rows inside the inclusive date range and of one store.

    Stored tables are partitioned by store and month, so each date bound is
    also stated on ``year_month``: whole months are then skipped unread.
    """
    conditions: list[Column] = []
    if start_date is not None:
        start = as_date(start_date)
        conditions += [
            F.col("year_month") >= start.strftime("%Y-%m"),
            F.col("date") >= F.lit(start),
        ]
    if end_date is not None:
        end = as_date(end_date)
        conditions += [
            F.col("year_month") <= end.strftime("%Y-%m"),
            F.col("date") <= F.lit(end),
        ]
    if store_id is not None:
        conditions.append(F.col("store_id") == store_id)
    for condition in conditions:
        df = df.filter(condition)
    return df
