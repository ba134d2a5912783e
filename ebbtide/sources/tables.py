"""The sales view over the star-schema test tables.

Only the joins that the requested columns need are added, so a query on the
fact table alone never touches a dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators.ordering import dealt

FACT = {
    "sale_date": lambda: F.col("l_shipdate").cast("date"),
    "transaction_number": lambda: F.col("l_orderkey"),
    "product_id": lambda: F.col("l_partkey"),
    "supplier_id": lambda: F.col("l_suppkey"),
    "transaction_type": lambda: F.when(F.col("l_returnflag") == "R", "RETURN").otherwise("INV"),
    "quantity": lambda: F.col("l_quantity").cast("decimal(14,2)"),
    "list_amount": lambda: F.col("l_extendedprice").cast("decimal(14,2)"),
    "discount_amount": lambda: F.col("l_extendedprice").cast("decimal(14,2)")
    * F.col("l_discount").cast("decimal(4,2)"),
    "net_sales": lambda: _net(),
    "gross_sales": lambda: F.greatest(_net(), F.lit(0).cast("decimal(18,4)")),
    "return_value": lambda: F.greatest(-_net(), F.lit(0).cast("decimal(18,4)")),
    "vat_amount": lambda: _net() * F.col("l_tax").cast("decimal(4,2)"),
    "line_status": lambda: F.col("l_linestatus"),
    "line_number": lambda: F.col("l_linenumber"),
}
ORDER = {"customer_key": "o_custkey", "order_status": "o_orderstatus", "priority": "o_orderpriority"}
CUSTOMER = {"channel": "c_mktsegment"}
PRODUCT = {"category": "p_type", "brand": "p_brand", "product_name": "p_name"}
BRANCH = {"branch": "s_nationkey"}
REGION = {"region": "r_name"}


def _net():
    amount = F.col("l_extendedprice").cast("decimal(14,2)") * (
        F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(4,2)")
    )
    signed = F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount)
    return signed.cast("decimal(18,4)")


class Tables:
    """Readers for one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sales(self, *columns: str, spread: bool = False) -> DataFrame:
        """Sales lines with the requested columns; with `spread`, lines meet
        their orders in tasks whose size does not grow with the table."""
        lines = self.read("lineitem")
        wanted = set(columns)
        if wanted & (set(ORDER) | set(CUSTOMER)):
            orders = self.read("orders")
            if wanted & set(CUSTOMER):
                customers = self.read("customer").select("c_custkey", "c_mktsegment")
                orders = orders.join(customers, orders.o_custkey == customers.c_custkey)
            if spread:
                rows = lines.count()
                lines, orders = dealt(lines, rows, "l_orderkey"), dealt(orders, rows, "o_orderkey")
            lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        if wanted & set(PRODUCT):
            lines = lines.join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        if wanted & (set(BRANCH) | set(REGION)):
            branches = self.read("supplier").select("s_suppkey", "s_nationkey")
            if wanted & set(REGION):
                nations = self.read("nation").select("n_nationkey", "n_regionkey")
                regions = self.read("region").select("r_regionkey", "r_name")
                branches = branches.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).join(
                    regions, F.col("n_regionkey") == F.col("r_regionkey")
                )
            lines = lines.join(branches, F.col("l_suppkey") == F.col("s_suppkey"))
        looked_up = {**ORDER, **CUSTOMER, **PRODUCT, **BRANCH, **REGION}
        return lines.select(
            *[
                (FACT[c]() if c in FACT else F.col(looked_up[c])).alias(c)
                for c in columns
            ]
        )
