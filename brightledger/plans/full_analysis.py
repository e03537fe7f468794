"""Profile, exploration, customers, anomalies, forecast, drivers, recommendations and overview of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import advise, anomalies, customers, explain, explore, learn, profile, series


def analyse(
    df: DataFrame, mapping: customers.ColumnMapping | None = None, target: str | None = None, forecast: series.ForecastConfig | None = None,
    anomaly: anomalies.AnomalyConfig = anomalies.AnomalyConfig(), training: learn.TrainingConfig | None = None,
) -> dict[str, dict[str, DataFrame]]:
    """Runs every module that was asked for and turns their results into recommendations and the overview."""
    spark = df.sparkSession
    out: dict[str, dict[str, DataFrame]] = {"profile": profile.validate(df), "explore": explore.explore(df, target)}
    rules = [advise.missing_rule(out["profile"]["summary"]), advise.outlier_rule(out["explore"]["outliers"])]
    best_model, metrics = None, None
    if training:
        done = learn.train(df, training)
        best_model = done.best.name
        out["learn"] = {"leaderboard": done.leaderboard}
        if done.task == learn.CLASSIFICATION:
            rules.append(advise.model_rule(done.leaderboard.withColumnRenamed("test_accuracy", "accuracy")))
    if forecast:
        out["forecast"] = series.forecast(df, forecast)
        metrics = out["forecast"]["metrics"]
        best = out["forecast"]["best"].select("series", F.col("best_model").alias("model"))
        rules.append(advise.forecast_rule(out["forecast"]["forecast"].where("part = 'future'").join(best, ["series", "model"], "left_semi")))
    out["anomalies"] = anomalies.detect(df, anomaly)
    rules.append(advise.anomaly_rule(out["anomalies"]["summary"]))
    out["customers"] = customers.analyse_customers(df, mapping)
    rules.append(advise.repeat_rule(out["customers"]["kpis"]))
    if "churn" in out["customers"]:
        rules.append(advise.churn_rule(out["customers"]["churn"]))
    if target:
        out["explain"] = explain.explain(df, target)
        rules.append(advise.driver_rule(out["explain"]["global"]))
    cells = out["profile"]["summary"].first()
    items = advise.recommend(spark, rules, cells["row_count"], cells["column_count"])
    overview = advise.executive_overview(spark, out["profile"]["summary"], out["profile"]["score"], out["customers"]["kpis"], out["anomalies"]["summary"], best_model, metrics, items)
    out["advice"] = {"items": items, "counts": advise.recommendation_counts(items), "overview": overview}
    return out
