"""Expressions for names and texts shown to people."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_label(name: Column, category_id: Column) -> Column:
    """First letter kept, the rest in lower case; ``Cat. <id>`` when there is no name."""
    spelled = F.concat(F.substring(name, 1, 1), F.lower(name.substr(F.lit(2), F.length(name))))
    return F.when(F.length(name) > 0, spelled).otherwise(
        F.concat(F.lit("Cat. "), category_id.cast("string"))
    )


def name_or_id(name: Column, category_id: Column) -> Column:
    """Stored name of a category, ``Cat <id>`` for one the dimension does not hold."""
    return F.coalesce(name, F.concat(F.lit("Cat "), category_id.cast("string")))


def lift_tier(lift: Column) -> Column:
    # The two lift limits.
    return F.when(lift >= 3.0, "strong").when(lift >= 1.5, "medium").otherwise("weak")


def id_list(ids: Column, separator: str = ",") -> Column:
    """Sorted array as text, for outputs that are compared or shown."""
    return F.array_join(F.sort_array(ids).cast("array<string>"), separator)
