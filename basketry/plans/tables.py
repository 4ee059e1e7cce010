"""The order tables read as a retailer's receipts.

An order is a receipt, its line items are the products on it, the customer's
nation is the store, and a part's size is the product's category.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import prepare
from basketry.schemas import RECEIPT_KEY


@dataclass(frozen=True)
class RetailTables:
    """DataFrames over one data folder, all of them lazy."""

    spark: SparkSession
    folder: str
    stores: int | None = None  # nations are dealt to so many stores, where stored tables should have few partitions

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def receipts(self) -> DataFrame:
        """One row per order."""
        nation = F.col("c_nationkey") if self.stores is None else F.col("c_nationkey") % self.stores
        customers = self.table("customer").select("c_custkey", nation.alias("c_nationkey"))
        return (
            self.table("orders")
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                "o_orderkey",
                F.col("o_orderdate").cast("date").alias("date"),
                F.col("c_nationkey").cast("bigint").alias("store_id"),
                F.col("o_custkey").cast("bigint").alias("customer_id"),
            )
        )

    @property
    def items(self) -> DataFrame:
        """One row per product on a receipt.

        Orders and line items grow together, so neither is ever a side to
        broadcast, whatever a size estimate says; a sort-merge join lets
        adaptive execution split an order that holds most of the items.
        """
        return self.line_items.select(*RECEIPT_KEY, F.col("l_partkey").alias("product_code"))

    @property
    def line_items(self) -> DataFrame:
        bought = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        same_order = F.col("l_orderkey") == F.col("o_orderkey")
        return bought.hint("merge").join(self.receipts, same_order)

    @property
    def raw_receipts(self) -> DataFrame:
        """Receipts as text: one per line item, with blanks and a bad token around two codes.

        The second code is the supplier's number, read as a product's.  Receipts
        of the same customer, store and day merge into one transaction.
        """
        codes = [F.col(c).cast("string") for c in ("l_partkey", "l_suppkey")]
        return self.line_items.select(
            F.col("date").cast("string").alias("date"),
            "store_id",
            "customer_id",
            F.concat(F.lit(" "), codes[0], F.lit("  x "), codes[1], F.lit(" ")).alias("products_raw"),
        )

    @property
    def catalog(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_code"), F.col("p_size").cast("bigint").alias("category_id")
        )

    @property
    def type_catalog(self) -> DataFrame:
        """The same products under six coarse categories, named by type."""
        return self.table("part").select(
            F.col("p_partkey").alias("product_code"), F.col("p_type").alias("category_id")
        )

    @property
    def categories(self) -> DataFrame:
        """Sizes are numbers from 1 to 50, so the dimension goes to whatever it is joined with."""
        category = F.col("p_size").cast("bigint")
        name = F.concat(F.lit("CATEGORY "), F.lpad(category.cast("string"), 2, "0"))
        named = self.table("part").select(category.alias("category_id"), name.alias("category_name"))
        return F.broadcast(named.distinct())

    @property
    def categorised(self) -> DataFrame:
        return prepare.categorise(self.items, self.catalog)

    @property
    def lines(self) -> DataFrame:
        return prepare.build_lines(self.categorised, self.categories)

    @property
    def baskets(self) -> DataFrame:
        return prepare.build_baskets(self.categorised)

    @property
    def type_baskets(self) -> DataFrame:
        return prepare.build_baskets(prepare.categorise(self.items, self.type_catalog))
