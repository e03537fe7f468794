"""Input views: the driver's tables, and derived tables with gaps, copies and constants.

The derived tables are written as SQL expressions that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.customers import ColumnMapping

DIRTY_EXPRESSIONS = (
    "o_orderkey AS order_key",
    "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS customer",
    "CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_totalprice END AS amount",
    "o_orderdate AS ordered_at",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority",
    "o_orderstatus AS status",
    "'A' AS flag",
    "CASE WHEN o_orderkey % 200 = 0 THEN 'Y' ELSE 'X' END AS near_flag",
    "CASE WHEN o_orderkey % 25 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 1000 AS VARCHAR(20)) END AS code_text",
    "CASE WHEN o_orderkey % 30 = 0 THEN 'soon' ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS date_text",
)
DIRTY_COLUMNS = ("order_key", "customer", "amount", "ordered_at", "priority", "status", "flag", "near_flag", "code_text", "date_text")
DIRTY_SQL = (
    f"(SELECT {', '.join(DIRTY_EXPRESSIONS)} FROM orders"
    f" UNION ALL SELECT {', '.join(DIRTY_EXPRESSIONS)} FROM orders WHERE o_orderkey % 50 = 0)"
)

TRANSACTION_EXPRESSIONS = (
    "o_orderkey", "o_custkey AS customer_id", "o_orderdate AS order_date", "o_totalprice AS revenue",
    "o_totalprice * 0.1 * (1 + o_orderkey % 3) AS profit",
    "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS churn",
)
TRANSACTIONS_SQL = f"(SELECT {', '.join(TRANSACTION_EXPRESSIONS)} FROM orders)"
TRANSACTIONS = ColumnMapping("customer_id", "order_date", "revenue", "profit", None, "churn")

ITEM_EXPRESSIONS = (
    "l_orderkey * 10 + l_linenumber AS item_key",
    "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS quantity",
    "CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS price",
    "l_extendedprice * 2 + l_linenumber AS price_twin",
    "l_discount AS discount", "l_tax AS tax", "l_returnflag AS returnflag", "l_linestatus AS linestatus", "l_shipdate AS shipdate",
)
ITEMS_SQL = f"(SELECT {', '.join(ITEM_EXPRESSIONS)} FROM lineitem)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.selectExpr(*DIRTY_EXPRESSIONS).unionAll(o.where("o_orderkey % 50 = 0").selectExpr(*DIRTY_EXPRESSIONS))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*TRANSACTION_EXPRESSIONS)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*ITEM_EXPRESSIONS)
