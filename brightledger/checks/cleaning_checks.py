"""Cleaning and feature preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import as_moment, as_number, literal_rows
from ..operators import cleaning as K
from .views import DIRTY_COLUMNS, DIRTY_SQL, ITEMS_SQL, dirty_orders, items

_NUM = ["quantity", "price"]
_TRAIN_COLUMNS = ["order_key", "amount", "priority", "status"]
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _items(s, d):
    return items(s, d).select("item_key", "quantity", "price", "returnflag")


def _rounded(df, columns=_NUM):
    return df.select(*[F.round(c, 4).alias(c) if c in columns else F.col(c) for c in df.columns])


def _coerced(s, d):
    t = dirty_orders(s, d)
    found = K.numeric_text_columns(t, ["code_text", "priority", "status"])
    return t.select("order_key", *[as_number(t, c).alias(c) for c in found])


def _correlated(s, d):
    # Prices without the inflated ones, which would hide that one column repeats the other.
    rows = items(s, d).selectExpr("quantity", "(price_twin - item_key % 10) / 2 AS price", "price_twin", "discount", "tax")
    found = K.correlated_columns(rows, ["quantity", "price", "price_twin", "discount", "tax"], 0.60)
    return literal_rows(s, [(a, b, round(r, 4)) for a, b, r in found], "column_name string, repeats string, r double")


def _train_and_holdout(s, d):
    t = dirty_orders(s, d).select(*_TRAIN_COLUMNS)
    return t.where("order_key % 5 <> 0"), t.where("order_key % 5 = 0")


def _holdout(s, d):
    train, hold = _train_and_holdout(s, d)
    model, _ = K.fit(train)
    out = model.transform(hold)
    return out.withColumn("amount", F.round("amount", 4))


def _fit_report(s, d):
    model, _ = K.fit(dirty_orders(s, d).drop("order_key"))
    return model.report(s)["summary"]


def _fit_removed(s, d):
    model, _ = K.fit(dirty_orders(s, d))
    return model.report(s)["removed"].select("column_name")


def _fit_roles(s, d):
    model, _ = K.fit(dirty_orders(s, d))
    return model.report(s)["roles"]


_I = f"WITH d AS {ITEMS_SQL}"
_BOUNDS = f"""{_I}, q AS (SELECT quantile_cont(quantity, 0.25) AS q1q, quantile_cont(quantity, 0.75) AS q3q, quantile_cont(price, 0.25) AS q1p, quantile_cont(price, 0.75) AS q3p,
   median(quantity) AS mq, median(price) AS mp FROM d),
  b AS (SELECT q1q - 1.5::DOUBLE * (q3q - q1q) AS loq, q3q + 1.5::DOUBLE * (q3q - q1q) AS hiq, q1p - 1.5::DOUBLE * (q3p - q1p) AS lop, q3p + 1.5::DOUBLE * (q3p - q1p) AS hip, * FROM q)"""


def _scaled(q: str, p: str) -> str:
    return f"SELECT item_key, round({q}, 4) AS quantity, round({p}, 4) AS price, returnflag FROM d, s"


QUERIES = {
    "dedupe_rows": lambda s, d: K.dedupe(dirty_orders(s, d)),
    "coerce_numeric": _coerced,
    "parse_dates": lambda s, d: (lambda t: t.select("order_key", as_moment(t, "date_text").alias("date_text")))(dirty_orders(s, d)),
    "date_parts": lambda s, d: (lambda t: t.select("item_key", *K.date_parts(t, "shipdate")))(items(s, d)),
    "constant_columns": lambda s, d: K.constant_columns(dirty_orders(s, d)),
    "near_constant_columns": lambda s, d: K.near_constant_columns(dirty_orders(s, d)),
    "high_correlation_drop": _correlated,
    "iqr_bounds": lambda s, d: K.bounds_table(items(s, d), ["quantity", "price", "discount"]),
    "zscore_bounds": lambda s, d: K.bounds_table(items(s, d), ["quantity", "price", "discount"], "zscore", 3.0),
    "outlier_clip": lambda s, d: _rounded(K.handle_outliers(_items(s, d), _NUM)),
    "outlier_impute": lambda s, d: _rounded(K.handle_outliers(_items(s, d), _NUM, action="impute")),
    "outlier_drop_rows": lambda s, d: K.handle_outliers(_items(s, d), _NUM, action="drop_rows"),
    "impute_numeric": lambda s, d: _rounded(K.impute(_items(s, d), ["quantity"])),
    "impute_numeric_mean": lambda s, d: _rounded(K.impute(_items(s, d), ["quantity"], "mean")),
    "impute_numeric_mode": lambda s, d: K.impute(_items(s, d), ["quantity"], "most_frequent"),
    "impute_categorical": lambda s, d: K.impute_categories(dirty_orders(s, d).select("order_key", "priority"), ["priority"]),
    "scale_standard": lambda s, d: _rounded(K.scale(_items(s, d), _NUM)),
    "scale_minmax": lambda s, d: _rounded(K.scale(_items(s, d), _NUM, "minmax")),
    "scale_robust": lambda s, d: _rounded(K.scale(_items(s, d), _NUM, "robust")),
    "encode_onehot": lambda s, d: K.encode(dirty_orders(s, d).select("order_key", "priority"), ["priority"]),
    "encode_ordinal": lambda s, d: K.encode(dirty_orders(s, d).select("order_key", "priority"), ["priority"], "ordinal"),
    "clean_transform_holdout": _holdout,
    "clean_fit_summary": _fit_report,
    "clean_fit_removed": _fit_removed,
    "clean_fit_roles": _fit_roles,
}

_ONEHOT = ", ".join(f"CASE WHEN priority = '{p}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"priority_{p}\"" for p in _PRIORITIES)
_ONEHOT_FILLED = _ONEHOT.replace("WHEN priority =", "WHEN coalesce(priority, fp) =")
_STATUS = ", ".join(f"CASE WHEN status = '{p}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"status_{p}\"" for p in ("F", "O", "P"))

# A missing date counts as no weekend, so that part stays present in every row.
_DATE_PARTS = {
    "year": "year({c})", "month": "month({c})", "day": "day({c})", "dayofweek": "isodow({c}) - 1",
    "is_weekend": "CASE WHEN isodow({c}) >= 6 THEN 1 ELSE 0 END",
}

ORACLES = {
    "clean_fit_roles": f"""WITH d AS {DIRTY_SQL}, u AS (SELECT DISTINCT * FROM d)
        SELECT 'order_key' AS column_name, CASE WHEN count(DISTINCT order_key) = count(*) THEN 'id' ELSE 'numerical' END AS role FROM u
        UNION ALL SELECT 'customer', CASE WHEN typeof(any_value(customer)) IN ('BIGINT', 'INTEGER') THEN 'numerical' ELSE 'categorical' END FROM u
        UNION ALL SELECT 'amount', CASE WHEN typeof(any_value(amount)) = 'DOUBLE' THEN 'numerical' ELSE 'categorical' END FROM u
        UNION ALL SELECT 'ordered_at', CASE WHEN typeof(any_value(ordered_at)) LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'categorical' END FROM u
        UNION ALL SELECT 'date_text', CASE WHEN count(TRY_CAST(date_text AS TIMESTAMP))::DOUBLE / count(date_text) > 0.8 THEN 'datetime' ELSE 'categorical' END FROM u
        UNION ALL """ + " UNION ALL ".join(
        f"SELECT '{c}', CASE WHEN count(TRY_CAST({c} AS DOUBLE))::DOUBLE / count({c}) > 0.9 THEN 'numerical' ELSE 'categorical' END FROM u" for c in ("priority", "status", "flag", "near_flag", "code_text")),
    "dedupe_rows": f"WITH d AS {DIRTY_SQL} SELECT DISTINCT * FROM d",
    "coerce_numeric": f"WITH d AS {DIRTY_SQL} SELECT order_key, TRY_CAST(code_text AS DOUBLE) AS code_text FROM d",
    "parse_dates": f"WITH d AS {DIRTY_SQL} SELECT order_key, TRY_CAST(date_text AS TIMESTAMP) AS date_text FROM d",
    "date_parts": f"""{_I} SELECT item_key, year(shipdate)::DOUBLE AS shipdate_year, month(shipdate)::DOUBLE AS shipdate_month, day(shipdate)::DOUBLE AS shipdate_day,
        (isodow(shipdate) - 1)::DOUBLE AS shipdate_dayofweek, CASE WHEN isodow(shipdate) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS shipdate_is_weekend FROM d""",
    "constant_columns": f"WITH d AS {DIRTY_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name FROM d HAVING count(DISTINCT {c}) = 1" for c in DIRTY_COLUMNS),
    "near_constant_columns": f"WITH d AS {DIRTY_SQL} " + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, round(max(n)::DOUBLE / sum(n), 4) AS top_share FROM (SELECT {c}, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY 1) z HAVING count(*) > 1) y WHERE top_share >= 0.98"
        for c in DIRTY_COLUMNS),
    "high_correlation_drop": """WITH d AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS quantity, l_extendedprice AS price, l_extendedprice * 2 + l_linenumber AS price_twin FROM lineitem),
        r AS (SELECT abs(corr(quantity, price)) AS qp, abs(corr(quantity, price_twin)) AS qt, abs(corr(price, price_twin)) AS pt FROM d)
        SELECT 'price' AS column_name, 'quantity' AS repeats, round(qp, 4) AS r FROM r WHERE qp > 0.60
        UNION ALL SELECT 'price_twin', CASE WHEN qt > 0.60 THEN 'quantity' ELSE 'price' END, round(CASE WHEN qt > 0.60 THEN qt ELSE pt END, 4) FROM r WHERE qt > 0.60 OR pt > 0.60""",
    "iqr_bounds": f"{_I} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.25) - 1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 4) AS lower_bound, round(quantile_cont({c}, 0.75) + 1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 4) AS upper_bound FROM d"
        for c in ("quantity", "price", "discount")),
    "zscore_bounds": f"{_I} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg({c}) - 3 * stddev_samp({c}), 4) AS lower_bound, round(avg({c}) + 3 * stddev_samp({c}), 4) AS upper_bound FROM d" for c in ("quantity", "price", "discount")),
    "outlier_clip": f"""{_BOUNDS} SELECT item_key, round(CASE WHEN quantity IS NULL THEN NULL ELSE greatest(least(quantity, hiq), loq) END, 4) AS quantity,
        round(CASE WHEN price IS NULL THEN NULL ELSE greatest(least(price, hip), lop) END, 4) AS price, returnflag FROM d, b""",
    "outlier_impute": f"""{_BOUNDS} SELECT item_key, round(CASE WHEN quantity < loq OR quantity > hiq THEN mq ELSE quantity END, 4) AS quantity,
        round(CASE WHEN price < lop OR price > hip THEN mp ELSE price END, 4) AS price, returnflag FROM d, b""",
    "outlier_drop_rows": f"""{_BOUNDS} SELECT item_key, quantity, price, returnflag FROM d, b
        WHERE NOT (coalesce(quantity < loq OR quantity > hiq, false) OR coalesce(price < lop OR price > hip, false))""",
    "impute_numeric": f"{_I} SELECT item_key, round(coalesce(quantity, (SELECT median(quantity) FROM d)), 4) AS quantity, price, returnflag FROM d".replace("price, returnflag", "round(price, 4) AS price, returnflag"),
    "impute_numeric_mean": f"{_I} SELECT item_key, round(coalesce(quantity, (SELECT avg(quantity) FROM d)), 4) AS quantity, round(price, 4) AS price, returnflag FROM d",
    "impute_numeric_mode": f"{_I} SELECT item_key, coalesce(quantity, (SELECT quantity FROM d WHERE quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS quantity, price, returnflag FROM d",
    "impute_categorical": f"WITH d AS {DIRTY_SQL} SELECT order_key, coalesce(priority, (SELECT priority FROM d WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM d",
    "scale_standard": f"{_I}, s AS (SELECT avg(quantity) AS a, stddev_pop(quantity) AS b, avg(price) AS e, stddev_pop(price) AS f FROM d) " + _scaled("(quantity - a) / b", "(price - e) / f"),
    "scale_minmax": f"{_I}, s AS (SELECT min(quantity) AS a, max(quantity) - min(quantity) AS b, min(price) AS e, max(price) - min(price) AS f FROM d) " + _scaled("(quantity - a) / b", "(price - e) / f"),
    "scale_robust": f"""{_I}, s AS (SELECT median(quantity) AS a, quantile_cont(quantity, 0.75) - quantile_cont(quantity, 0.25) AS b, median(price) AS e,
        quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS f FROM d) """ + _scaled("(quantity - a) / b", "(price - e) / f"),
    "encode_onehot": f"WITH d AS {DIRTY_SQL} SELECT {_ONEHOT}, order_key FROM d",
    "encode_ordinal": f"""WITH d AS {DIRTY_SQL}, c AS (SELECT priority AS p, CAST(row_number() OVER (ORDER BY priority) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT priority FROM d WHERE priority IS NOT NULL) z)
        SELECT coalesce(code, -1.0) AS priority, order_key FROM d LEFT JOIN c ON c.p = d.priority""",
    "clean_transform_holdout": f"""WITH d AS (SELECT order_key, amount, priority, status FROM {DIRTY_SQL} z), t AS (SELECT * FROM d WHERE order_key % 5 <> 0),
        q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b, median(amount) AS m,
                     (SELECT priority FROM t WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS fp FROM t),
        f AS (SELECT CASE WHEN amount IS NULL THEN m ELSE greatest(least(amount, b + 1.5::DOUBLE * (b - a)), a - 1.5::DOUBLE * (b - a)) END AS x FROM t, q), s AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM f)
        SELECT round((coalesce(amount, m) - mu) / sd, 4) AS amount, {_ONEHOT_FILLED}, {_STATUS}, order_key FROM d, q, s WHERE order_key % 5 = 0""",
    "clean_fit_removed": f"""WITH d AS {DIRTY_SQL}, u AS (SELECT DISTINCT * FROM d), t AS (SELECT *, TRY_CAST(date_text AS TIMESTAMP) AS dt FROM u)
        SELECT 'ordered_at' AS column_name UNION ALL SELECT 'date_text' FROM t HAVING count(dt)::DOUBLE / count(date_text) > 0.8
        UNION ALL SELECT 'flag' FROM u HAVING count(DISTINCT flag) = 1 UNION ALL SELECT 'near_flag' FROM u HAVING count(*) FILTER (WHERE near_flag = 'X')::DOUBLE / count(*) >= 0.98
        UNION ALL """ + " UNION ALL ".join(
        f"SELECT 'date_text_{n}' FROM t HAVING abs(corr({e.format(c='ordered_at')}, {e.format(c='dt')})) > 0.95" for n, e in _DATE_PARTS.items()),
}
