"""Recommendation queries over results of the other modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import literal_rows
from ..operators import advise as R
from ..operators import anomalies as A
from ..operators import customers as C
from ..operators import explore as E
from ..operators import profile as P
from . import anomaly_checks, customer_checks, explain_checks, explore_checks, learn_checks, profile_checks, series_checks
from .views import DIRTY_SQL, TRANSACTIONS, dirty_orders, items, transactions

_SHOWN = ("title", "priority", "affected_metric", "source_module")
_GAPPY = ("customer", "amount", "priority")


def _show(df):
    return df.select(*_SHOWN)


def _missing(s, d):
    return R.missing_rule(P.cell_summary(dirty_orders(s, d).select(*_GAPPY)))


def _outliers(s, d):
    return R.outlier_rule(E.outlier_analysis(items(s, d), explore_checks.NUMBERS))


def _model(s, d):
    from ..operators.learn import class_metrics
    m = class_metrics(learn_checks._ruled(s, d)).select(F.lit("rule").alias("model_name"), F.lit("classification").alias("task"), "accuracy", F.lit(True).alias("is_best"))
    return R.model_rule(m)


def _future(s, d):
    """The held-out values of each daily series in the place of a forecast."""
    return series_checks._split(s, d).where("part = 'test'").select("series", (F.col("pos") - F.col("n_train")).alias("step"), F.round("value", 6).alias("predicted"))


def _anomaly(s, d):
    return R.anomaly_rule(anomaly_checks._run(s, d, "zscore")["summary"])


def _kpis(s, d):
    """Customers as order keys, so that nobody buys twice."""
    from dataclasses import replace
    return C.business_kpis(transactions(s, d), replace(TRANSACTIONS, customer_id="o_orderkey"))


def _churn(s, d):
    labelled = C.churn_labels(customer_checks._rfm(s, d), transactions(s, d), customer_checks._no_churn())
    return R.churn_rule(C.churn_rate(labelled).withColumnRenamed("churned_customers", "high_risk_customers"))


def _drivers(s, d):
    from ..operators.explain import global_importance
    return R.driver_rule(global_importance(explain_checks._linear(s, d), explain_checks.FEATURES))


def _all(s, d):
    rules = [_missing(s, d), _outliers(s, d), _model(s, d), R.forecast_rule(_future(s, d)), _anomaly(s, d), R.repeat_rule(_kpis(s, d)), _churn(s, d), _drivers(s, d)]
    return R.recommend(s, rules)


def _overview(s, d):
    from ..operators.series import forecast_metrics
    out = R.executive_overview(
        s, P.cell_summary(dirty_orders(s, d)), P.quality_score(dirty_orders(s, d)), C.business_kpis(transactions(s, d), TRANSACTIONS),
        anomaly_checks._run(s, d, "zscore")["summary"], "rule", forecast_metrics(series_checks._naive(s, d)), _all(s, d))
    return out.withColumn("top_items", F.array_join("top_items", "; "))


QUERIES = {
    "rec_missing": lambda s, d: _show(_missing(s, d)),
    "rec_outliers": lambda s, d: _show(_outliers(s, d)),
    "rec_model": lambda s, d: _show(_model(s, d)),
    "rec_forecast": lambda s, d: _show(R.forecast_rule(_future(s, d))),
    "forecast_change": lambda s, d: R.forecast_change(_future(s, d)),
    "rec_anomaly": lambda s, d: _show(_anomaly(s, d)),
    "rec_repeat": lambda s, d: _show(R.repeat_rule(_kpis(s, d))),
    "rec_churn": lambda s, d: _show(_churn(s, d)),
    "rec_drivers": lambda s, d: _show(_drivers(s, d)),
    "recommendations": lambda s, d: _all(s, d).select(*_SHOWN, "priority_rank"),
    "recommendation_counts": lambda s, d: R.recommendation_counts(_all(s, d)),
    "executive_overview": _overview,
}


def _item(title: str, priority: str, metric: str, module: str, tail: str) -> str:
    return f"SELECT {title} AS title, {priority} AS priority, '{metric}' AS affected_metric, '{module}' AS source_module FROM {tail}"


_GAPS = f"(SELECT round(({' + '.join(f'count(*) - count({c})' for c in _GAPPY)}) * 100.0::DOUBLE / (count(*) * {len(_GAPPY)}), 2) AS pct FROM {DIRTY_SQL} dd) g"
_OUT = f"(SELECT sum(iqr_outliers) AS n FROM ({explore_checks.ORACLES['outlier_analysis']}) o) oo"
_CHANGE = f"""(WITH {series_checks.SPLIT_SQL}, fv AS (SELECT series, pos - n_train AS step, round(value, 6) AS predicted FROM s WHERE pos > n_train),
  e AS (SELECT series, arg_min(predicted, step) AS first_value, arg_max(predicted, step) AS last_value, count(*) AS steps FROM fv GROUP BY 1)
  SELECT *, round((last_value - first_value) * 100.0 / greatest(1e-8, abs(first_value)), 2) AS change_pct FROM e) c"""
_CHURN = f"(SELECT CAST(churned_customers AS BIGINT) AS n FROM ({customer_checks.ORACLES['churn_derived']}) q) h"

PARTS = {
    "rec_missing": _item("'Close the gaps in the data'", "CASE WHEN pct > 25 THEN 'High' ELSE 'Medium' END", "Completeness", "EDA", f"{_GAPS} WHERE pct > 10"),
    "rec_outliers": _item("'Check extreme values'", "'Medium'", "Data integrity", "EDA", f"{_OUT} WHERE n > 0"),
    "rec_model": _item("'Improve the predictive model'", "'High'", "Model accuracy", "ML Engine", f"({learn_checks.ORACLES['class_metrics']}) cm WHERE accuracy < 0.70"),
    "rec_forecast": _item("CASE WHEN change_pct < 0 THEN 'Plan for a falling forecast' ELSE 'Prepare capacity for growth' END",
                          "CASE WHEN change_pct < -20 THEN 'Critical' WHEN change_pct < -5 THEN 'High' ELSE 'Medium' END", "Expected demand", "Forecasting", f"{_CHANGE} WHERE change_pct < -5 OR change_pct > 15"
                          ).replace("'Expected demand' AS affected_metric", "CASE WHEN change_pct < 0 THEN 'Expected demand' ELSE 'Supply capacity' END AS affected_metric"),
    "rec_anomaly": _item("'Review flagged records'", "CASE WHEN max_severity = 'Critical' THEN 'Critical' WHEN anomaly_pct > 5 THEN 'High' ELSE 'Medium' END", "Operational risk", "Anomaly Detection",
                         f"({anomaly_checks.ORACLES['anomaly_summary']}) a WHERE affected_rows > 0"),
    "rec_repeat": _item("'Bring customers back'", "'High'", "Customer retention", "BI Module",
                        "(SELECT count(*) AS n, count(*) FILTER (WHERE k > 1) * 100.0::DOUBLE / count(*) AS rate FROM (SELECT o_orderkey, count(*) AS k FROM orders GROUP BY 1) z) r WHERE rate < 20 AND n > 10"),
    "rec_churn": _item("'Keep customers at risk'", "CASE WHEN n >= 5 THEN 'Critical' ELSE 'High' END", "Churn", "BI Module", f"{_CHURN} WHERE n > 0"),
    "rec_drivers": _item("'Look at the main drivers: ' || max(CASE WHEN rank = 1 THEN feature_name END) || ' and ' || max(CASE WHEN rank = 2 THEN feature_name END)", "'Medium'", "Prediction drivers", "SHAP XAI",
                         f"({explain_checks.ORACLES['global_importance']}) gi HAVING count(*) >= 2"),
}
_ALL = " UNION ALL ".join(f"SELECT {i} AS rule_order, * FROM ({q}) p{i}" for i, q in enumerate(PARTS.values()))
_RANK = "CASE priority WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 ELSE 4 END"

ORACLES = {
    **PARTS,
    "forecast_change": f"SELECT * FROM {_CHANGE}",
    "recommendations": f"SELECT title, priority, affected_metric, source_module, {_RANK} AS priority_rank FROM ({_ALL}) z",
    "recommendation_counts": f"SELECT count(*) AS total, count(*) FILTER (WHERE priority = 'Critical') AS critical, count(*) FILTER (WHERE priority = 'High') AS high FROM ({_ALL}) z",
    "executive_overview": f"""WITH sc AS ({profile_checks.ORACLES['quality_score']}), kp AS ({customer_checks.ORACLES['business_kpis']}), an AS ({anomaly_checks.ORACLES['anomaly_summary']}),
        fm AS ({series_checks.ORACLES['forecast_metrics']}), re AS (SELECT * FROM ({_ALL}) z ORDER BY {_RANK}, rule_order LIMIT 3)
        SELECT row_count, CAST(column_count AS INTEGER) AS column_count, quality_score, total_revenue, affected_rows AS flagged_anomalies, max_severity, 'rule' AS best_model,
          (SELECT model FROM fm ORDER BY rmse, series, model LIMIT 1) AS forecast_model, (SELECT smape FROM fm ORDER BY rmse, series, model LIMIT 1) AS forecast_smape,
          (SELECT string_agg(title, '; ' ORDER BY {_RANK}, rule_order) FROM re) AS top_items FROM sc, kp, an""",
}
