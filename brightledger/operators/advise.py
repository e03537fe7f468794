"""Ranked recommendations out of the other modules' result tables, and the executive overview row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import literal_rows

# Ranks of the priorities.
PRIORITY_RANK = {"Critical": 1, "High": 2, "Medium": 3, "Low": 4}
COLUMNS = ("title", "explanation", "evidence", "priority", "affected_metric", "suggested_action", "source_module")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


def _items(rows: DataFrame, title: Column, explanation: Column, evidence: Column, priority: Column, metric: str, action: Column, module: str) -> DataFrame:
    return rows.select(title.alias("title"), explanation.alias("explanation"), evidence.alias("evidence"), priority.alias("priority"),
                       F.lit(metric).alias("affected_metric"), action.alias("suggested_action"), F.lit(module).alias("source_module"))


def missing_rule(summary: DataFrame) -> DataFrame:
    """More than 10 % missing cells: Medium; more than 25 %: High. Input: the cell summary."""
    pct = F.col("missing_pct")
    return _items(summary.where(pct > 10.0), F.lit("Close the gaps in the data"),
                  F.format_string("%.2f%% of the cells are empty, which biases statistics and models", pct),
                  F.format_string("%d of %d cells in %d columns are empty", F.col("missing_cells"), F.col("total_cells"), F.col("column_count")),
                  F.when(pct > 25.0, "High").otherwise("Medium"), "Completeness", F.lit("Fill numeric and category gaps, or drop columns that are mostly empty"), "EDA")


def outlier_rule(outliers: DataFrame) -> DataFrame:
    """Any value outside the IQR bounds: Medium. Input: the outlier table."""
    total = outliers.agg(F.coalesce(F.sum("iqr_outliers"), F.lit(0)).cast("long").alias("n")).where("n > 0")
    return _items(total, F.lit("Check extreme values"), F.lit("Some values lie far outside the usual range: entry errors or unusual events"),
                  F.format_string("%d values lie outside the IQR bounds", F.col("n")), F.lit("Medium"), "Data integrity", F.lit("Review the values and clip them where they are errors"), "EDA")


def model_rule(leaderboard: DataFrame) -> DataFrame:
    """Best classifier below 70 % accuracy: High. Input: rows with model_name, task, accuracy, is_best."""
    best = leaderboard.where("is_best and task = 'classification' and accuracy < 0.70")
    pct = F.col("accuracy") * 100
    return _items(best, F.lit("Improve the predictive model"), F.format_string("The best model, %s, is right in %.1f%% of the cases", F.col("model_name"), pct),
                  F.format_string("%s: accuracy %.1f%% on held-out rows", F.col("model_name"), pct), F.lit("High"), "Model accuracy",
                  F.lit("Tune parameters, add interactions or collect more features"), "ML Engine")


def forecast_change(future: DataFrame) -> DataFrame:
    """First and last predicted value of each series and the change in percent (2 decimals)."""
    ends = future.groupBy("series").agg(F.min_by("predicted", "step").alias("first_value"), F.max_by("predicted", "step").alias("last_value"), F.count(F.lit(1)).alias("steps"))
    change = F.round((F.col("last_value") - F.col("first_value")) * 100.0 / F.greatest(F.lit(1e-8), F.abs("first_value")), 2)
    return ends.where("steps >= 2").withColumn("change_pct", change)


def forecast_rule(future: DataFrame, model: str = "forecast") -> DataFrame:
    """Decline over 5 %: High, over 20 %: Critical; growth over 15 %: Medium. Input: future rows (series, step, predicted)."""
    c = F.col("change_pct")
    ends = forecast_change(future)
    evidence = F.format_string("%s goes from %.2f to %.2f (%.2f%%) according to the %s model", F.col("series"), F.col("first_value"), F.col("last_value"), c, F.lit(model))
    down = _items(ends.where(c < -5.0), F.lit("Plan for a falling forecast"), F.format_string("A decline of %.2f%% is expected over %d periods", F.abs(c), F.col("steps")), evidence,
                  F.when(c < -20.0, "Critical").otherwise("High"), "Expected demand", F.lit("Lower stock, revisit the schedule and plan promotions"), "Forecasting")
    up = _items(ends.where(c > 15.0), F.lit("Prepare capacity for growth"), F.format_string("Growth of %.2f%% is expected over %d periods", c, F.col("steps")), evidence,
                F.lit("Medium"), "Supply capacity", F.lit("Raise capacity and purchasing before the peak"), "Forecasting")
    return down.unionByName(up)


def anomaly_rule(summary: DataFrame) -> DataFrame:
    """Flagged rows: Critical when the worst severity is, High above 5 %, else Medium. Input: the anomaly summary."""
    level = F.when(F.col("max_severity") == "Critical", "Critical").when(F.col("anomaly_pct") > 5.0, "High").otherwise("Medium")
    return _items(summary.where("affected_rows > 0"), F.lit("Review flagged records"), F.format_string("%d records (%.2f%%) look unlike the rest", F.col("affected_rows"), F.col("anomaly_pct")),
                  F.format_string("%d of %d rows flagged, worst severity %s", F.col("affected_rows"), F.col("total_rows"), F.col("max_severity")), level, "Operational risk",
                  F.lit("Inspect the flagged rows and confirm the transactions"), "Anomaly Detection")


def repeat_rule(kpis: DataFrame) -> DataFrame:
    """Repeat purchases under 20 % with more than ten customers: High. Input: the KPI row."""
    hit = kpis.where("repeat_purchase_rate < 20.0 and total_customers > 10")
    return _items(hit, F.lit("Bring customers back"), F.format_string("Only %.2f%% of the customers buy again", F.col("repeat_purchase_rate")),
                  F.format_string("Repeat rate %.2f%% over %d customers", F.col("repeat_purchase_rate"), F.col("total_customers")), F.lit("High"), "Customer retention",
                  F.lit("Follow up after purchases and reward loyalty"), "BI Module")


def churn_rule(churn: DataFrame) -> DataFrame:
    """Customers at high risk: High, five or more: Critical. Input: the churn summary."""
    n = F.col("high_risk_customers")
    return _items(churn.where(n > 0), F.lit("Keep customers at risk"), F.format_string("%d customers are likely to leave", n),
                  F.format_string("%d customers at high risk, churn rate %.2f%%", n, F.col("churn_rate_pct")), F.when(n >= 5, "Critical").otherwise("High"), "Churn",
                  F.lit("Make retention offers and contact the accounts at risk"), "BI Module")


def driver_rule(importance: DataFrame) -> DataFrame:
    """The two strongest drivers: Medium. Input: the global importance table."""
    top = importance.where("rank <= 2").agg(F.sort_array(F.collect_list(F.struct("rank", "feature_name", "mean_abs_contribution"))).alias("t")).where(F.size("t") == 2)
    a, b = F.col("t")[0], F.col("t")[1]
    names = F.concat(a["feature_name"], F.lit(" and "), b["feature_name"])
    return _items(top, F.concat(F.lit("Look at the main drivers: "), names), F.concat(names, F.lit(" influence the predictions most")),
                  F.concat(a["feature_name"], F.lit(": "), a["mean_abs_contribution"].cast("string"), F.lit("; "), b["feature_name"], F.lit(": "), b["mean_abs_contribution"].cast("string")),
                  F.lit("Medium"), "Prediction drivers", F.concat(F.lit("Control and monitor "), a["feature_name"]), "SHAP XAI")


def recommend(spark, parts: list[DataFrame], row_count: int | None = None, column_count: int | None = None) -> DataFrame:
    """All items by priority (then by rule order); a single Low item when no rule fired."""
    empty = literal_rows(spark, [], SCHEMA + ", rule_order int")
    items = reduce(DataFrame.unionByName, [p.withColumn("rule_order", F.lit(i)) for i, p in enumerate(parts)], empty)
    if items.isEmpty():
        size = f"{row_count if row_count is not None else 'unknown'} rows, {column_count if column_count is not None else 'unknown'} columns"
        items = literal_rows(spark, [("Run the analyses", "No finding yet: explore, model and forecast the table first", size, "Low", "Analytics coverage",
                                      "Run exploration, training and forecasting", "System", 0)], SCHEMA + ", rule_order int")
    rank = reduce(lambda acc, kv: acc.when(F.col("priority") == kv[0], kv[1]), PRIORITY_RANK.items(), F.when(F.lit(False), 0))
    return items.withColumn("priority_rank", rank).orderBy("priority_rank", "rule_order", "evidence").drop("rule_order")


def recommendation_counts(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("priority") == "Critical").alias("critical"), F.count_if(F.col("priority") == "High").alias("high"))


def executive_overview(
    spark, cells: DataFrame, score: DataFrame, kpis: DataFrame | None = None, anomalies: DataFrame | None = None,
    best_model: str | None = None, forecast_metrics: DataFrame | None = None, items: DataFrame | None = None,
) -> DataFrame:
    """One row for the front page, from the one-row results of the modules."""
    c, s = cells.first(), score.first()
    k = kpis.first() if kpis is not None else None
    a = anomalies.first() if anomalies is not None else None
    f = forecast_metrics.orderBy("rmse", "series", "model").first() if forecast_metrics is not None else None
    top = []
    if items is not None:
        urgent = [r["title"] for r in items.where("priority_rank <= 2").limit(3).collect()]
        top = urgent or [r["title"] for r in items.limit(3).collect()]
    return literal_rows(spark, [(
        c["row_count"], c["column_count"], s["quality_score"], k["total_revenue"] if k else 0.0, a["affected_rows"] if a else 0,
        a["max_severity"] if a else None, best_model or "not trained", f["model"] if f else None, f["smape"] if f else None, top)],
        "row_count long, column_count int, quality_score double, total_revenue double, flagged_anomalies long, max_severity string, best_model string, forecast_model string, forecast_smape double, top_items array<string>")
