"""Which sets lie whole inside which others.

A set can only lie inside what holds its rarest item, so each set is entered under
that one item alone.  Holders meet few sets that way, and those they meet are then
compared with all they hold.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.arrays import is_subset


def holders_of_items(holders: DataFrame) -> DataFrame:
    """(item, holders): how many holders have each item; ``holders`` holds (holder, held) with distinct items."""
    return holders.select(F.explode("held").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("holders"))


def by_rarest_item(sets: DataFrame, popularity: DataFrame) -> DataFrame:
    """``sets`` (number, items) with the item that fewest holders have; equals are settled by the item."""
    entries = sets.select("number", F.explode("items").alias("item")).join(popularity, "item", "left")
    rarity = F.struct(F.coalesce("holders", F.lit(0)).alias("holders"), "item")
    rarest = entries.groupBy("number").agg(F.min(rarity).alias("rarest"))
    return sets.join(rarest, "number").select("number", "items", F.col("rarest.item").alias("item"))


def met_sets(holders: DataFrame, sets: DataFrame, popularity: DataFrame | None = None) -> DataFrame:
    """(holder, number, items): the sets whose rarest item a holder has."""
    popularity = holders_of_items(holders) if popularity is None else popularity
    items = holders.select("holder", F.explode("held").alias("item"))
    return items.join(by_rarest_item(sets, popularity), "item").select("holder", "number", "items")


def held_sets(holders: DataFrame, sets: DataFrame, popularity: DataFrame | None = None, few: bool = False) -> DataFrame:
    """(holder, number) for every set that lies whole inside what a holder has.

    A set of one item is held where it is met; all others are compared.  ``few`` sets are broadcast, and then
    holders stay where they are.
    """
    if few:
        popularity = holders_of_items(holders) if popularity is None else popularity
        items = holders.select("holder", "held", F.explode("held").alias("item"))
        met = items.join(F.broadcast(by_rarest_item(sets, popularity)), "item")
        return met.filter(whole("items", "held")).select("holder", "number")
    met = met_sets(holders, sets, popularity)
    return met.join(holders, "holder").filter(whole("items", "held")).select("holder", "number")


def whole(items: str, held: str) -> Column:
    return (F.size(items) == 1) | is_subset(F.col(items), F.col(held))
