"""Source, catalogue and history queries."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions.durable import ensure_checkpoint_dir
from ..operators import profile
from ..sources import history, readers
from .views import table

_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _csv(s, d):
    """Orders written as CSV to the shared folder and read back with the same schema."""
    path = f"{ensure_checkpoint_dir(s)}/csv-{uuid.uuid4().hex}"
    orders = table(s, d, "orders")
    orders.write.option("header", True).csv(path)
    return readers.read_csv(s, path, ",", "UTF-8", orders.schema)


def _detected(s, d):
    """Orders under a delimiter and an encoding that the reader has to find out."""
    path = f"{ensure_checkpoint_dir(s)}/csv-{uuid.uuid4().hex}"
    orders = table(s, d, "orders").withColumn("o_orderpriority", F.concat(F.lit("café "), "o_orderpriority"))
    orders.write.options(header=True, sep=";", encoding="ISO-8859-1").csv(path)
    return readers.read_csv(s, path, schema=orders.schema)


def _inline(s, d):
    return readers.read_records(s, [r.asDict() for r in table(s, d, "nation").collect()], table(s, d, "nation").schema)


def _history(s, d):
    """Reports of two runs over two tables; the latest of each table, with what its report says."""
    kept = history.ReportHistory(s, f"{ensure_checkpoint_dir(s)}/history-{uuid.uuid4().hex}")
    for turn, names in enumerate((("orders", "customer"), ("orders",))):
        for name in names:
            kept.append("profile", f"run{turn}", name, profile.cell_summary(table(s, d, name)), created_at=datetime(2024, 1, 1 + turn))
    report = F.from_json("report", "array<struct<row_count:bigint,column_count:int>>")[0]
    return kept.latest("profile").select("dataset_id", "run_id", report["row_count"].alias("row_count"))


def _exported(s, d):
    path = f"{ensure_checkpoint_dir(s)}/export-{uuid.uuid4().hex}"
    priorities = table(s, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    history.export_csv(priorities, path)
    return readers.read_csv(s, path, ",", "UTF-8", priorities.schema)


def _column_types(s, d):
    """Every column of orders with its type and how many values it has."""
    orders = table(s, d, "orders")
    filled = profile.missing_by_column(orders).select("column_name", "missing_count")
    known = readers.column_types(orders).join(filled, "column_name", "left")
    return known.select("position", "column_name", "data_type", (F.lit(orders.count()) - F.coalesce("missing_count", F.lit(0))).alias("filled"))


QUERIES = {
    "csv_roundtrip": _csv,
    "csv_detected": _detected,
    "records_inline": _inline,
    "report_history": _history,
    "csv_exported": _exported,
    "scan_parquet": lambda s, d: readers.read_table(s, f"{d}/nation.parquet"),
    "preview_orders": lambda s, d: readers.preview(table(s, d, "orders"), 10, ["o_orderkey"]),
    "column_types": _column_types,
    "latest_per_key": lambda s, d: history.latest_per_key(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]),
    "catalogue_counts": lambda s, d: history.catalogue_counts({n: table(s, d, n) for n in _TABLES}),
}
_WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}

_FILLED = " ".join(f"WHEN '{c}' THEN (SELECT count({c}) FROM orders)" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))

ORACLES = {
    "csv_roundtrip": "SELECT * FROM orders",
    "csv_detected": "SELECT * REPLACE ('café ' || o_orderpriority AS o_orderpriority) FROM orders",
    "records_inline": "SELECT * FROM nation",
    "report_history": "SELECT 'orders' AS dataset_id, 'run1' AS run_id, count(*) AS row_count FROM orders UNION ALL SELECT 'customer', 'run0', count(*) FROM customer",
    "csv_exported": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "scan_parquet": "SELECT * FROM nation",
    "preview_orders": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    "column_types": """SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS position, column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
        WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS data_type, CASE column_name """ + _FILLED + """ END AS filled FROM (DESCRIBE SELECT * FROM orders) z""",
    "latest_per_key": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) z WHERE rn = 1",
    "catalogue_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS row_count, {w}::INTEGER AS column_count FROM {n}" for n, w in _WIDTHS.items()),
}
