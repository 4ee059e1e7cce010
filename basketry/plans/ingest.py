"""Bulk load: raw receipts to the stored tables."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from basketry.operators import prepare
from basketry.session import staged
from basketry.sources import readers, writers


@dataclass(frozen=True)
class Store:
    """Paths of the stored tables under one base folder."""

    base: str

    @property
    def lines(self) -> str:
        return f"{self.base}/processed/transactions_long"

    @property
    def baskets(self) -> str:
        return f"{self.base}/processed/transactions_basket"

    @property
    def catalog(self) -> str:
        return f"{self.base}/processed/catalog"

    @property
    def clusters(self) -> str:
        return f"{self.base}/processed/customer_clusters.parquet"

    @property
    def rejected(self) -> str:
        return f"{self.base}/rejected/incoming"

    @property
    def customer_months(self) -> str:
        return f"{self.base}/processed/customer_months"

    @property
    def customer_cube(self) -> str:
        return f"{self.base}/processed/customer_cube"

    @property
    def itemsets(self) -> str:
        return f"{self.base}/models/itemsets"

    @property
    def rules(self) -> str:
        return f"{self.base}/models/association_rules.parquet"

    @property
    def kmeans(self) -> str:
        return f"{self.base}/models/kmeans"


def bulk_load(
    spark: SparkSession, raw: DataFrame, catalog: DataFrame, categories: DataFrame, store: Store
) -> DataFrame:
    """Write catalog, baskets and lines; returns the one-row load report.

    The receipts are read and shuffled once, for the baskets, which are staged in
    the shared folder.  Both tables are written from there: lines first, because
    the incremental load takes them for the truth and rebuilds baskets from
    them, so a load that broke off in between is completed by loading again or
    by the next batch.  Only the partitions of these receipts are replaced, and
    the report is about these receipts only.
    """
    writers.write_table(catalog, store.catalog)
    products = readers.read_catalog(spark, store.catalog)
    baskets = staged(
        prepare.build_baskets(prepare.categorise(prepare.receipt_items(raw), products)), "baskets"
    )
    writers.write_partitioned(prepare.lines_of(baskets, categories), store.lines)
    writers.write_partitioned(baskets, store.baskets)
    return prepare.ingest_report(baskets)
