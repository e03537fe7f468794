"""Profile and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from .views import DIRTY_COLUMNS, DIRTY_SQL, dirty_orders

_WIDTH = len(DIRTY_COLUMNS)
_MISSING = " + ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in DIRTY_COLUMNS)
_PER_COLUMN = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS missing_count,"
    f" round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct,"
    f" count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c})::DOUBLE / count(*), 4) AS distinct_ratio,"
    f" CAST(min(CAST({c} AS VARCHAR)) AS VARCHAR) AS smallest FROM d"
    for i, c in enumerate(DIRTY_COLUMNS)
)
_KIND = {
    "order_key": "numerical", "customer": "numerical", "amount": "numerical", "ordered_at": "datetime", "priority": "categorical",
    "status": "categorical", "flag": "categorical", "near_flag": "categorical", "code_text": "categorical", "date_text": "datetime",
}
_TYPE = {"order_key": "bigint", "customer": "bigint", "amount": "double", "ordered_at": "timestamp_ntz"}
_KIND_CASE = "CASE column_name " + " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in _KIND.items()) + " END"
_TYPE_CASE = "CASE column_name " + " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in _TYPE.items()) + " ELSE 'string' END"
_ID = (
    "(row_count > 1 AND missing_count = 0 AND distinct_count = row_count AND ("
    + " OR ".join(f"column_name LIKE '%{p}%'" for p in ("id", "uuid", "guid", "code", "index", "key")) + "))"
)
_WITH = f"WITH d AS {DIRTY_SQL}, p AS ({_PER_COLUMN})"
_DUP = f"u AS (SELECT DISTINCT * FROM d), dup AS (SELECT (SELECT count(*) FROM d) AS row_count, (SELECT count(*) FROM d) - (SELECT count(*) FROM u) AS duplicate_rows)"
_DUP_PCT = "round(duplicate_rows * 100.0::DOUBLE / row_count, 2)"


def _counts(c: str) -> str:
    return f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY 2"


_VALUES = " UNION ALL ".join(f"({_counts(c)})" for c in DIRTY_COLUMNS)

QUERIES = {
    "profile_summary": lambda s, d: P.cell_summary(dirty_orders(s, d)),
    "duplicate_rows": lambda s, d: P.duplicate_summary(dirty_orders(s, d)),
    "missing_by_column": lambda s, d: P.missing_by_column(dirty_orders(s, d), only_missing=True),
    "distinct_by_column": lambda s, d: P.distinct_by_column(dirty_orders(s, d)),
    "column_profile": lambda s, d: P.column_profile(dirty_orders(s, d)),
    "sample_values": lambda s, d: P.sample_values(dirty_orders(s, d)),
    "columns_by_kind": lambda s, d: P.columns_by_kind(P.column_profile(dirty_orders(s, d))).select(
        *[F.concat_ws(",", c).alias(c) for c in ("numerical_columns", "categorical_columns", "datetime_columns", "potential_id_columns", "constant_columns")]),
    "quality_warnings": lambda s, d: P.quality_warnings(dirty_orders(s, d)).select("severity", "code", "column_name"),
    "quality_score": lambda s, d: P.quality_score(dirty_orders(s, d)),
}

ORACLES = {
    "profile_summary": f"""WITH d AS {DIRTY_SQL}
        SELECT count(*) AS row_count, {_WIDTH}::INTEGER AS column_count, count(*) * {_WIDTH} AS total_cells,
               CAST({_MISSING} AS BIGINT) AS missing_cells,
               round(CAST({_MISSING} AS DOUBLE) * 100.0 / (count(*) * {_WIDTH}), 2) AS missing_pct FROM d""",
    "duplicate_rows": f"""WITH d AS {DIRTY_SQL}, {_DUP} SELECT row_count, duplicate_rows, {_DUP_PCT} AS duplicate_pct FROM dup""",
    "missing_by_column": f"""{_WITH} SELECT position::INTEGER AS position, column_name, row_count, missing_count, missing_pct FROM p WHERE missing_count > 0""",
    "distinct_by_column": f"""{_WITH} SELECT column_name, distinct_count, distinct_ratio FROM p""",
    "column_profile": f"""{_WITH} SELECT position::INTEGER AS position, column_name, {_TYPE_CASE} AS data_type,
        CASE WHEN {_ID} THEN 'id' ELSE {_KIND_CASE} END AS inferred_type, row_count, missing_count, missing_pct, distinct_count,
        distinct_ratio, distinct_count <= 1 AS is_constant, {_ID} AS is_potential_id FROM p""",
    "sample_values": f"""WITH d AS {DIRTY_SQL}, v AS ({_VALUES}), r AS (
        SELECT column_name, value, CAST(row_number() OVER (PARTITION BY column_name ORDER BY value) AS INTEGER) AS position FROM v)
        SELECT column_name, value, position FROM r WHERE position <= 5""",
    "columns_by_kind": f"""{_WITH}, k AS (SELECT *, CASE WHEN {_ID} THEN 'id' ELSE {_KIND_CASE} END AS kind FROM p)
        SELECT coalesce(string_agg(CASE WHEN kind = 'numerical' THEN column_name END, ',' ORDER BY position), '') AS numerical_columns,
               coalesce(string_agg(CASE WHEN kind = 'categorical' THEN column_name END, ',' ORDER BY position), '') AS categorical_columns,
               coalesce(string_agg(CASE WHEN kind = 'datetime' THEN column_name END, ',' ORDER BY position), '') AS datetime_columns,
               coalesce(string_agg(CASE WHEN kind = 'id' THEN column_name END, ',' ORDER BY position), '') AS potential_id_columns,
               coalesce(string_agg(CASE WHEN distinct_count <= 1 THEN column_name END, ',' ORDER BY position), '') AS constant_columns FROM k""",
    "quality_warnings": f"""{_WITH}, {_DUP}, k AS (SELECT *, CASE WHEN {_ID} THEN 'id' ELSE {_KIND_CASE} END AS kind FROM p)
        SELECT CASE WHEN {_DUP_PCT} < 10 THEN 'WARNING' ELSE 'CRITICAL' END AS severity, 'DUPLICATE_ROWS' AS code, NULL::VARCHAR AS column_name FROM dup WHERE duplicate_rows > 0
        UNION ALL SELECT 'WARNING', 'CONSTANT_COLUMN', column_name FROM k WHERE distinct_count <= 1
        UNION ALL SELECT CASE WHEN missing_pct >= 50 THEN 'CRITICAL' ELSE 'WARNING' END, 'HIGH_MISSINGNESS', column_name FROM k WHERE missing_pct >= 20
        UNION ALL SELECT 'INFO', 'HIGH_CARDINALITY', column_name FROM k WHERE kind = 'categorical' AND distinct_count > 50""",
    "quality_score": f"""{_WITH}, {_DUP}, a AS (
        SELECT CAST(sum(missing_count) AS BIGINT) AS missing_cells, CAST(sum(row_count) AS BIGINT) AS cells,
               count(*) FILTER (WHERE distinct_count <= 1) AS constant_columns,
               count(*) FILTER (WHERE missing_pct >= 50) AS crit0,
               count(*) FILTER (WHERE distinct_count <= 1) + count(*) FILTER (WHERE missing_pct >= 20 AND missing_pct < 50) AS warn0, count(*) AS column_count FROM p),
        b AS (SELECT *, crit0 + CASE WHEN duplicate_rows > 0 AND {_DUP_PCT} >= 10 THEN 1 ELSE 0 END AS critical_count,
                     warn0 + CASE WHEN duplicate_rows > 0 AND {_DUP_PCT} < 10 THEN 1 ELSE 0 END AS warning_count, {_DUP_PCT} AS pct FROM a, dup)
        SELECT row_count, column_count, missing_cells, duplicate_rows, constant_columns, critical_count, warning_count,
               greatest(0.0::DOUBLE, round(100.0::DOUBLE - least(40.0::DOUBLE, missing_cells * 150.0::DOUBLE / cells) - least(25.0::DOUBLE, pct)
                 - least(15.0::DOUBLE, constant_columns * 50.0::DOUBLE / column_count) - critical_count * 10.0::DOUBLE - warning_count * 3.0::DOUBLE, 1)) AS quality_score FROM b""",
}
