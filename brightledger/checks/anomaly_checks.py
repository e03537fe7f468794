"""Anomaly queries over order lines with gaps and inflated prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies as A
from .views import ITEMS_SQL, items

FEATURES = ("quantity", "price", "discount", "tax")


def _table(s, d):
    return items(s, d).select("item_key", *FEATURES)


def _run(s, d, method):
    return A.detect(_table(s, d), A.AnomalyConfig(method, FEATURES))


def _scored(s, d, method):
    return _run(s, d, method)["scores"].select("item_key", "is_anomaly", F.round("anomaly_score", 4).alias("anomaly_score"))


def _two_methods(s, d):
    t = _table(s, d)
    scale = A.fit_scale(t, list(FEATURES))
    table = A.filled(t, scale)
    return A.combine(table, [], [A.zscore_columns(scale), A.iqr_columns(scale)], 0.05)


def _contributions(s, d):
    flagged = _run(s, d, "zscore")["flagged"]
    text = F.array_join(F.transform(F.map_entries("contributing_features"), lambda e: F.concat_ws("=", e["key"], F.format_string("%.3f", e["value"]))), ";")
    return flagged.select("item_key", text.alias("contributions"))


def _zmatrix(s, d):
    t = _table(s, d)
    scale = A.fit_scale(t, list(FEATURES))
    return A.filled(t, scale).select("item_key", *[F.round(A.z_of(c, scale), 4).alias(f"z_{c}") for c in FEATURES])


def _fill(s, d):
    t = _table(s, d)
    scale = A.fit_scale(t, list(FEATURES))
    return A.filled(t, scale).select("item_key", *[F.col(f"_x_{c}").alias(c) for c in FEATURES])


def _iforest(s, d):
    return _run(s, d, "isolation_forest")["summary"]


def _ensemble(s, d):
    return _run(s, d, "ensemble")["summary"]


def _rows_of(method):
    """Every row with its score; what holds for any forest is left to compare."""
    def run(s, d):
        scored = _run(s, d, method)["scores"]
        known = F.col("is_anomaly").isNotNull() & F.col("anomaly_score").between(0.0, 1.0)
        return scored.select("item_key", known.alias("is_scored"))
    return run


def _flagged_share(s, d):
    """Rows, and whether those below the limit are the contaminated share (ties at the limit are not flagged)."""
    scored = _run(s, d, "isolation_forest")["scores"]
    worst, best = F.min(F.when(F.col("is_anomaly"), F.col("anomaly_score"))), F.max(F.when(~F.col("is_anomaly"), F.col("anomaly_score")))
    return scored.agg(F.count(F.lit(1)).alias("total_rows"), (F.count_if("is_anomaly") <= F.ceil(0.05 * F.count(F.lit(1)))).alias("within_share"), (worst >= best).alias("flagged_are_highest"))


def _projection(s, d):
    scored = _run(s, d, "zscore")["scores"]
    return A.projection(scored, list(FEATURES), ["item_key", "is_anomaly", "anomaly_score"])


_FILL = f"""d AS (SELECT item_key, quantity, price, discount, tax FROM {ITEMS_SQL} i), md AS (SELECT median(quantity) AS mq, median(price) AS mp, median(discount) AS md, median(tax) AS mt FROM d),
  x AS (SELECT item_key, coalesce(quantity, mq) AS quantity, coalesce(price, mp) AS price, coalesce(discount, md) AS discount, coalesce(tax, mt) AS tax FROM d, md)"""
_Z = f"""{_FILL}, st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM x),
  z AS (SELECT x.*, {', '.join(f'abs(({c} - m_{c}) / s_{c}) AS z_{c}' for c in FEATURES)} FROM x, st), zt AS (SELECT *, greatest({', '.join(f'z_{c}' for c in FEATURES)}) AS top FROM z),
  zs AS (SELECT *, top > 3.0 AS zf, greatest(0.0::DOUBLE, least(1.0::DOUBLE, top / 6.0)) AS zsc FROM zt)"""
_Q = f"""{_Z}, qt AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}' for c in FEATURES)} FROM x),
  dv AS (SELECT zs.*, greatest({', '.join(f'(greatest(0.0::DOUBLE, {c} - (b_{c} + 1.5::DOUBLE * (b_{c} - a_{c}))) + greatest(0.0::DOUBLE, (a_{c} - 1.5::DOUBLE * (b_{c} - a_{c})) - {c})) / (b_{c} - a_{c})' for c in FEATURES)}) AS dev FROM zs, qt),
  iq AS (SELECT item_key, zf, zsc, dev > 0 AS qf, greatest(0.0::DOUBLE, least(1.0::DOUBLE, dev / 4.5::DOUBLE)) AS qsc FROM dv)"""
_SEV = "CASE WHEN zsc >= 0.85 THEN 'Critical' WHEN zsc >= 0.70 THEN 'High' WHEN zsc >= 0.50 THEN 'Medium' ELSE 'Low' END"
_SORTED = "list_sort([" + ", ".join(f"{{'a': -z_{c}, 'b': '{c}'}}" for c in FEATURES) + "])[1:3]"
_TOP = f"""{_Z}, k AS (SELECT item_key, {_SORTED} AS top3 FROM zs WHERE zf)"""

QUERIES = {
    "anomaly_fill": _fill,
    "zscore_matrix": _zmatrix,
    "anomaly_zscore": lambda s, d: _scored(s, d, "zscore"),
    "anomaly_iqr": lambda s, d: _scored(s, d, "iqr"),
    "anomaly_two_methods": lambda s, d: _two_methods(s, d).select("item_key", "is_anomaly", F.round("anomaly_score", 4).alias("anomaly_score")),
    "anomaly_iforest": _iforest,
    "anomaly_ensemble": _ensemble,
    "anomaly_iforest_rows": _rows_of("isolation_forest"),
    "anomaly_ensemble_rows": _rows_of("ensemble"),
    "anomaly_iforest_share": _flagged_share,
    "anomaly_severity": lambda s, d: _run(s, d, "zscore")["flagged"].select("item_key", "severity"),
    "anomaly_contributions": _contributions,
    "anomaly_feature_ranking": lambda s, d: _run(s, d, "zscore")["ranking"],
    "anomaly_summary": lambda s, d: _run(s, d, "zscore")["summary"],
    "anomaly_projection": _projection,
}

ORACLES = {
    "anomaly_iforest_rows": f"SELECT item_key, true AS is_scored FROM {ITEMS_SQL} i",
    "anomaly_ensemble_rows": f"SELECT item_key, true AS is_scored FROM {ITEMS_SQL} i",
    "anomaly_iforest_share": f"SELECT count(*) AS total_rows, true AS within_share, true AS flagged_are_highest FROM {ITEMS_SQL} i",
    "anomaly_fill": f"WITH {_FILL} SELECT * FROM x",
    "zscore_matrix": f"WITH {_Z} SELECT item_key, {', '.join(f'round(z_{c}, 4) AS z_{c}' for c in FEATURES)} FROM z",
    "anomaly_zscore": f"WITH {_Z} SELECT item_key, zf AS is_anomaly, round(zsc, 4) AS anomaly_score FROM zs",
    "anomaly_iqr": f"WITH {_Q} SELECT item_key, qf AS is_anomaly, round(qsc, 4) AS anomaly_score FROM iq",
    "anomaly_two_methods": f"""WITH {_Q}, m AS (SELECT item_key, (zsc + qsc) / 2 AS sc, CAST(zf AS INTEGER) + CAST(qf AS INTEGER) AS votes FROM iq)
        SELECT item_key, votes >= 2 OR sc >= (SELECT quantile_cont(sc, 0.95) FROM m) AS is_anomaly, round(sc, 4) AS anomaly_score FROM m""",
    "anomaly_severity": f"WITH {_Z} SELECT item_key, {_SEV} AS severity FROM zs WHERE zf",
    "anomaly_contributions": f"WITH {_TOP} SELECT item_key, list_aggregate(list_transform(top3, lambda e: e.b || '=' || printf('%.3f', round(-e.a, 3))), 'string_agg', ';') AS contributions FROM k",
    "anomaly_feature_ranking": f"""WITH {_TOP}, n AS (SELECT count(*) AS n FROM zs WHERE zf), u3 AS (SELECT unnest(top3) AS e FROM k), g AS (SELECT e.b AS feature, sum(CAST(round(-e.a * 1000) AS BIGINT)) AS s FROM u3 GROUP BY 1)
        SELECT f AS feature, CAST((20 * coalesce(s, 0) + greatest(n, 1)) // (2 * greatest(n, 1)) AS DOUBLE) / 10000 AS importance FROM (SELECT unnest([{', '.join(f"'{c}'" for c in FEATURES)}]) AS f) u LEFT JOIN g ON g.feature = u.f, n""",
    "anomaly_summary": f"""WITH {_Z} SELECT 'zscore' AS method, count(*) AS total_rows, count(*) FILTER (WHERE zf) AS affected_rows, round(count(*) FILTER (WHERE zf) * 100.0::DOUBLE / count(*), 2) AS anomaly_pct,
        CASE max(CASE WHEN zf THEN CASE WHEN zsc >= 0.85 THEN 4 WHEN zsc >= 0.70 THEN 3 WHEN zsc >= 0.50 THEN 2 ELSE 1 END END) WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS max_severity FROM zs""",
}
