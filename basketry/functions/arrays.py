"""Set predicates on arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_subset(part: Column, whole: Column) -> Column:
    """True when a non-empty ``part`` holds nothing outside ``whole``."""
    return (F.size(part) > 0) & (F.size(F.array_except(part, whole)) == 0)
