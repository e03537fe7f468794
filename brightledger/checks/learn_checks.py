"""Training and scoring queries: document labels for classes, order lines with their part for numbers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions.columns import literal_rows
from ..functions.durable import ensure_checkpoint_dir
from ..operators import learn as L
from ..operators.registry import ModelRegistry
from .views import table

_RULE = "CASE WHEN l_discount > 0.05 THEN 'R' WHEN l_tax > 0.04 THEN 'A' ELSE 'N' END"
FLAGS = ["A", "N", "R"]


def _ruled(s, d):
    return table(s, d, "lineitem").selectExpr("l_returnflag AS label", f"{_RULE} AS prediction", "l_discount * 10 + l_tax AS score")


def labelled_documents(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), F.length("text").cast("double").alias("text_length"))
    return docs.join(table(s, d, "labels").select("doc_id", "quality"), "doc_id")


def priced_lines(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", F.col("p_size").cast("double").alias("p_size"), "p_brand")
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_extendedprice")
    return line.join(part, "l_partkey").drop("l_partkey")


def _classes(s, d, *models, **extra):
    cfg = L.TrainingConfig("quality", models=models, key=("doc_id",), **extra)
    return L.train(labelled_documents(s, d), cfg)


def _numbers(s, d, *models, **extra):
    cfg = L.TrainingConfig("l_extendedprice", models=models, key=("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), **extra)
    return L.train(priced_lines(s, d), cfg)


def _one_feature(s, d):
    """A line through one feature, whose test metrics SQL can work out too."""
    # The key is text, so that it splits the rows and is no feature.
    rows = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("double").alias("customer"), "o_totalprice")
    cfg = L.TrainingConfig("o_totalprice", task="regression", models=("linear_regression",), key=("o_orderkey",), folds=1)
    best = L.train(rows, cfg).best
    return literal_rows(s, [(best.name, round(best.test["mae"], 0), round(best.test["rmse"], 0), round(best.test["r2"], 3))], "model_name string, test_mae double, test_rmse double, test_r2 double")


def _board(training):
    return training.leaderboard.drop("model_id", "training_seconds")


def _search(s, d):
    return _board(_classes(s, d, "logistic_regression", tuning=True, trials=10))


def _predictions(s, d):
    docs = labelled_documents(s, d)
    return L.predict(_classes(s, d, "logistic_regression").best, docs).select("doc_id", "prediction", F.map_values("probabilities").alias("shares"))


def _stored(s, d):
    """A registry that holds one training run over the labelled documents, and the run's id."""
    registry = ModelRegistry(s, f"{ensure_checkpoint_dir(s)}/registry-{uuid.uuid4()}")
    done = _classes(s, d, "logistic_regression", folds=2)
    registry.save_training(done)
    return registry, done.run_id


def _registered(s, d):
    """What the registry tells of the run: its model with the rows of every part."""
    registry, run_id = _stored(s, d)
    meta = registry.choose(task="classification")
    run = json.loads(registry.experiment(run_id)["report"])
    row = (meta["model_name"], meta["task"], meta["target"], meta["is_best"], run["selection_metric"], *(run[f"{k}_rows"] for k in ("total", "train", "validation", "test")), len(run["results"]))
    return literal_rows(s, [row], "model_name string, task string, target string, is_best boolean, selection_metric string, total_rows long, train_rows long, validation_rows long, test_rows long, models int")


def _stored_predictions(s, d):
    """Every row scored by the stored model: sum of its shares, and whether the prediction is the class of the largest."""
    docs = labelled_documents(s, d)
    scored = _stored(s, d)[0].predict(docs)
    top = F.array_max(F.map_values("probabilities"))
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x)
    return scored.select("doc_id", "quality", F.round(total, 6).alias("share_sum"), (F.element_at("probabilities", F.col("prediction").cast("string")) == top).alias("is_largest"))


QUERIES = {
    "task_type": lambda s, d: L.task_types(table(s, d, "lineitem"), ["l_returnflag", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity"]),
    "label_codes": lambda s, d: L.encode_labels(table(s, d, "orders"), "o_orderpriority").select("o_orderkey", F.col("label").cast("int").alias("code")),
    "stratified_split": lambda s, d: L.split(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus"),
    "class_metrics": lambda s, d: L.class_metrics(_ruled(s, d)).select(*[F.round(c, 5).alias(c) for c in ("accuracy", "precision", "recall", "f1")]),
    "confusion_matrix": lambda s, d: L.confusion_matrix(_ruled(s, d), FLAGS),
    "roc_auc": lambda s, d: L.roc_auc(_ruled(s, d), F.col("label") == "R", F.col("score")),
    "regression_metrics": lambda s, d: L.regression_metrics(table(s, d, "lineitem").selectExpr("l_extendedprice AS label", "l_quantity * 1500 AS prediction")).select(
        F.round("mae", 2).alias("mae"), F.round("mse", 0).alias("mse"), F.round("rmse", 2).alias("rmse"), F.round("r2", 4).alias("r2"), F.round("mape", 4).alias("mape")),
    "ml_logistic": lambda s, d: _board(_classes(s, d, "logistic_regression")),
    "ml_linear": lambda s, d: _board(_numbers(s, d, "linear_regression")),
    "linear_one_feature": _one_feature,
    "ml_rf_class": lambda s, d: _board(_classes(s, d, "random_forest")),
    "ml_rf_reg": lambda s, d: _board(_numbers(s, d, "random_forest")),
    "ml_gbt_class": lambda s, d: _board(_classes(s, d, "gradient_boosting", folds=1)),
    "ml_gbt_reg": lambda s, d: _board(_numbers(s, d, "gradient_boosting", folds=1)),
    "ml_boosted_alt": lambda s, d: _board(_classes(s, d, "boosted_alt", folds=1)),
    "ml_random_search": _search,
    "ml_cv": lambda s, d: _board(_classes(s, d, "logistic_regression", folds=5)),
    "ml_leaderboard": lambda s, d: _board(_classes(s, d, "logistic_regression", "random_forest")),
    "ml_predict": _predictions,
    "model_registry": _registered,
    "ml_predict_stored": _stored_predictions,
}

_CELLS = f"m AS (SELECT l_returnflag AS label, {_RULE} AS prediction, l_discount * 10 + l_tax AS score FROM lineitem)"

_PART = "CAST(ceil(n * 0.15::DOUBLE - 1e-9) AS BIGINT)"

ORACLES = {
    "linear_one_feature": """WITH k AS (SELECT o_custkey::DOUBLE AS x, o_totalprice AS y, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders),
        q AS (SELECT *, CAST(ceil(n * 0.15::DOUBLE - 1e-9) AS BIGINT) AS part FROM k), f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM q WHERE p >= 2 * part), t AS (SELECT y, a * x + b AS z FROM q, f WHERE p < part)
        SELECT 'linear_regression' AS model_name, round(avg(abs(y - z)), 0) AS test_mae, round(sqrt(avg((y - z) * (y - z))), 0) AS test_rmse, round(1 - avg((y - z) * (y - z)) / var_pop(y), 3) AS test_r2 FROM t""",
    "model_registry": f"""WITH c AS (SELECT quality, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1)
        SELECT 'logistic_regression' AS model_name, 'classification' AS task, 'quality' AS target, true AS is_best, 'f1' AS selection_metric, CAST(sum(n) AS BIGINT) AS total_rows,
               CAST(sum(n - 2 * {_PART}) AS BIGINT) AS train_rows, CAST(sum({_PART}) AS BIGINT) AS validation_rows, CAST(sum({_PART}) AS BIGINT) AS test_rows, 1 AS models FROM c""",
    "ml_predict_stored": "SELECT doc_id, quality, 1.0::DOUBLE AS share_sum, true AS is_largest FROM documents JOIN labels USING (doc_id)",
    "task_type": """SELECT c AS target, CASE WHEN c = 'l_returnflag' OR k <= 10 OR (k <= 20 AND k::DOUBLE / n < 0.05) THEN 'classification' ELSE 'regression' END AS task FROM (
        SELECT 'l_returnflag' AS c, count(DISTINCT l_returnflag) AS k, count(*) AS n FROM lineitem UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), count(*) FROM lineitem
        UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice), count(*) FROM lineitem UNION ALL SELECT 'l_discount', count(DISTINCT l_discount), count(*) FROM lineitem
        UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity), count(*) FROM lineitem) z""",
    "label_codes": """SELECT o_orderkey, code FROM orders JOIN (SELECT p, CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) a) b ON p = o_orderpriority""",
    "stratified_split": """WITH k AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
        SELECT o_orderkey, o_orderstatus, CASE WHEN p < ceil(n * 0.15::DOUBLE - 1e-9) THEN 'test' WHEN p < 2 * ceil(n * 0.15::DOUBLE - 1e-9) THEN 'val' ELSE 'train' END AS part FROM k""",
    "class_metrics": f"""WITH {_CELLS}, a AS (SELECT label AS c, count(*) AS support, count(*) FILTER (WHERE label = prediction) AS tp FROM m GROUP BY 1), g AS (SELECT prediction AS c, count(*) AS guessed FROM m GROUP BY 1),
        e AS (SELECT support, tp, coalesce(tp::DOUBLE / guessed, 0) AS p, tp::DOUBLE / support AS r FROM a LEFT JOIN g ON g.c = a.c)
        SELECT round(sum(tp)::DOUBLE / sum(support), 5) AS accuracy, round(sum(p * support) / sum(support), 5) AS precision, round(sum(r * support) / sum(support), 5) AS recall,
               round(sum(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END * support) / sum(support), 5) AS f1 FROM e""",
    "confusion_matrix": f"WITH {_CELLS} SELECT label, " + ", ".join(f"count(*) FILTER (WHERE prediction = '{c}') AS \"predicted_{c}\"" for c in FLAGS) + " FROM m GROUP BY 1",
    "roc_auc": f"""WITH {_CELLS}, r AS (SELECT label = 'R' AS pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM m)
        SELECT round((sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE pos)::DOUBLE * count(*) FILTER (WHERE NOT pos)), 6) AS roc_auc FROM r""",
    "regression_metrics": """WITH m AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
        SELECT round(avg(abs(y - p)), 2) AS mae, round(avg((y - p) * (y - p)), 0) AS mse, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse,
               round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2, round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 4) AS mape FROM m""",
}
