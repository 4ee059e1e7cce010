"""Statistics that must not fail on constant or empty input."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: str, y: str) -> Column:
    """Pearson correlation, NULL when either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def weighted_quartiles(value: str, weight: str) -> Column:
    """Exact interpolated quartiles of a value that occurs ``weight`` times."""
    return F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col(weight))


def min_max_scaled(value: Column, low: Column, high: Column) -> Column:
    # Fixed value: the small term keeps the divisor above zero.
    return (value - low) / (high - low + F.lit(1e-9))


def rounded(value: Column, digits: int) -> Column:
    """Non-negative number to ``digits`` places, as the SQL engines of reports round it.

    Spark's own ``round`` works on the decimal text of a double and turns 1.005
    into 1.01; here the scaled double itself is rounded, which gives 1.0.
    """
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale
