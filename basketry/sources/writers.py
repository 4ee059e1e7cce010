"""Writers of the stored layout."""

from pyspark.sql import Column, DataFrame, Observation

from basketry.schemas import PARTITION_COLUMNS


def write_partitioned(
    df: DataFrame, path: str, mode: str = "overwrite", measures: dict[str, Column] | None = None
) -> dict:
    """Write by store and month; an overwrite replaces only the partitions it brings.

    Rebalancing gives every partition few, evenly sized files: small ones are
    put together, and a store's busy month is split over several tasks instead
    of being written by one.  ``measures`` are aggregates taken on the rows as
    they are written and returned, which saves a second pass.
    """
    balanced = df.hint("rebalance", *PARTITION_COLUMNS)
    observation = Observation()
    if measures:
        named = [measure.alias(name) for name, measure in measures.items()]
        balanced = balanced.observe(observation, *named)
    (
        balanced.write.partitionBy(*PARTITION_COLUMNS)
        .mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )
    return observation.get if measures else {}


def write_table(df: DataFrame, path: str) -> None:
    """Replace an unpartitioned table: catalog, rules or clusters."""
    df.write.mode("overwrite").parquet(path)
