"""Sources, history, recommendations and the whole chain."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightledger.operators import advise as R
from brightledger.operators import anomalies, learn, series
from brightledger.plans.full_analysis import analyse
from brightledger.sources import history, readers


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_delimiters(spark, tmp_path):
    comma = readers.read_csv(spark, write(tmp_path / "a.csv", "id,name,score\n1,x,90\n2,y,85\n3,z,100\n"))
    assert comma.count() == 3 and len(comma.columns) == 3 and comma.agg(F.sum("score")).first()[0] == 275
    semi = readers.read_csv(spark, write(tmp_path / "b.csv", 'id;name;score\n1;"a,b;c,d,e";2\n2;y;3\n'))
    assert (semi.count(), len(semi.columns)) == (2, 3)
    for i, sep in enumerate("\t|"):
        path = write(tmp_path / f"c{i}.txt", f"p{sep}q\n1{sep}2\n")
        assert readers.detect_delimiter(spark, path) == sep and readers.read_table(spark, path).columns == ["p", "q"]
    late = write(tmp_path / "late.csv", "a|b\n" + "x,y\n" * 3 + "1|2\n" * 40)
    assert readers.detect_delimiter(spark, late) == "|"
    with pytest.raises(ValueError):
        readers.read_csv(spark, write(tmp_path / "empty.csv", ""))


def test_long_lines_are_skipped_and_short_ones_padded(spark, tmp_path):
    path = write(tmp_path / "bad.csv", 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,"x,y",12\n')
    got = readers.read_csv(spark, path, ",", "UTF-8").orderBy(F.col("a").cast("int")).collect()
    assert [tuple(r) for r in got] == [(1, "2", 3), (4, "5", None), (10, "x,y", 12)]


def test_encoding_fallback(spark, tmp_path):
    path = write(tmp_path / "latin.csv", "name,n\ncaf\xe9,1\n".encode("latin-1"))
    assert readers.detect_encoding(spark, path) == "ISO-8859-1"
    assert readers.read_csv(spark, path).first()["name"] == "caf\xe9"
    assert readers.detect_encoding(spark, write(tmp_path / "utf.csv", "name\ncaf\xe9\n")) == "UTF-8"


def test_database_options():
    assert readers.database_options("jdbc:x", " SELECT a FROM t; ")["dbtable"] == "(SELECT a FROM t) q"
    got = readers.database_options("jdbc:x", "orders", "id", 0, 100, 8)
    assert got["dbtable"] == "orders" and got["numPartitions"] == "8"
    with pytest.raises(ValueError):
        readers.database_options("jdbc:x", "orders", "id")


def test_records_preview_and_types(spark):
    df = readers.read_records(spark, [{"a": 3, "b": "x"}, {"a": 1, "b": "y"}])
    assert readers.preview(df, 1, ["a"]).first()["a"] == 1
    assert [(r["column_name"], r["data_type"]) for r in readers.column_types(df).orderBy("position").collect()] == [("a", "bigint"), ("b", "string")]


def test_history_and_catalogue(spark, tmp_path):
    h = history.ReportHistory(spark, str(tmp_path))
    report = spark.createDataFrame([("x", 1.5)], "k string, v double")
    h.append("eda", "r1", "d1", report, created_at=datetime(2024, 1, 1))
    h.append("eda", "r2", "d1", report, report, datetime(2024, 1, 2))
    h.append("bi", "r3", "d1", report, created_at=datetime(2024, 1, 3))
    assert h.latest("eda").first()["run_id"] == "r2" and h.latest("eda").count() == 1
    assert '"v":1.5' in h.by_id("bi", "r3").first()["report"]
    c = history.Catalogue(spark, str(tmp_path))
    c.register("d1", "first", "csv", report, datetime(2024, 1, 1))
    c.register("d2", "second", "csv", report, datetime(2024, 2, 1))
    assert [r["dataset_id"] for r in c.list().collect()] == ["d2", "d1"] and c.list().first()["row_count"] == 1


def test_every_rule(spark):
    one = lambda row, schema: spark.createDataFrame([row], schema)
    rules = [
        R.missing_rule(one((5, 2, 10, 2, 20.0), "row_count long, column_count int, total_cells long, missing_cells long, missing_pct double")),
        R.outlier_rule(one((12,), "iqr_outliers long")),
        R.model_rule(one(("forest", "classification", 0.62, True), "model_name string, task string, accuracy double, is_best boolean")),
        R.forecast_rule(spark.createDataFrame([("all", 1, 100.0), ("all", 2, 90.0), ("all", 3, 70.0)], "series string, step int, predicted double")),
        R.anomaly_rule(one(("ensemble", 200, 15, 7.5, "Critical"), "method string, total_rows long, affected_rows long, anomaly_pct double, max_severity string")),
        R.repeat_rule(one((12.0, 100), "repeat_purchase_rate double, total_customers long")),
        R.churn_rule(one((8, 30.0), "high_risk_customers long, churn_rate_pct double")),
        R.driver_rule(spark.createDataFrame([("price", 4.5, 1), ("recency", 2.1, 2)], "feature_name string, mean_abs_contribution double, rank int")),
    ]
    items = R.recommend(spark, rules)
    got = [r["priority"] for r in items.collect()]
    assert got == ["Critical"] * 3 + ["High"] * 2 + ["Medium"] * 3
    counts = R.recommendation_counts(items).first()
    assert (counts["total"], counts["critical"], counts["high"]) == (8, 3, 2)
    quiet = R.recommend(spark, [R.outlier_rule(one((0,), "iqr_outliers long"))], 10, 2).collect()
    assert [(r["priority"], r["source_module"]) for r in quiet] == [("Low", "System")]


def test_export(spark, tmp_path):
    items = R.recommend(spark, [])
    history.export_csv(items, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1


def test_whole_chain(spark):
    rng = np.random.default_rng(42)
    rows = [(f"C{int(rng.integers(0, 25))}", datetime(2024, 1, 1) + timedelta(days=i), float(rng.uniform(20, 500)), float(rng.uniform(1, 90)), int(rng.integers(1, 9)), int(rng.integers(0, 2))) for i in range(150)]
    df = spark.createDataFrame(rows, "customer_id string, order_date timestamp, revenue double, profit double, quantity int, churn int")
    out = analyse(
        df, target="churn", forecast=series.ForecastConfig("order_date", "revenue", horizon=7, models=("baseline",)), anomaly=anomalies.AnomalyConfig("zscore"),
        training=learn.TrainingConfig("churn", models=("logistic_regression",), folds=1))
    overview = out["advice"]["overview"].first()
    assert overview["row_count"] == 150 and overview["best_model"] == "logistic_regression" and overview["total_revenue"] > 0
    assert out["advice"]["items"].count() >= 1 and out["forecast"]["forecast"].where("part = 'future'").count() == 7
