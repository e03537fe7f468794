"""The model registry: whole models kept in a folder, with an append-only table of what is there.

A stored model holds all that a prediction needs: the estimator, the fitted preparation (column roles, bounds, fills, scales,
category levels; large dictionaries as tables), the classes in their own type, and the names of its features. A session that
has never seen the training data loads it and predicts the same rows. The registry row is written last, so a
model whose writing was cut short is never listed, and what is read back is checked against a digest.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, fields
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import literal_rows
from .cleaning import CleaningConfig, CleaningModel
from .forest import DeepForestModel
from .learn import CLASSIFICATION, TrainedModel, Training, predict

REGISTRY_SCHEMA = (
    "model_id string, run_id string, model_name string, task string, target string, features array<string>, params string, metrics string,"
    " training_seconds double, path string, is_best boolean, deleted boolean, created_at timestamp"
)
EXPERIMENT_SCHEMA = "run_id string, target string, task string, best_model_id string, report string, created_at timestamp"
_STATE_SCHEMA = "name string, state string, sha256 string"
#: Parts of the preparation that are plain values; dictionaries are tables of their own.
_PLAIN = [f.name for f in fields(CleaningModel) if f.name not in ("config", "dictionaries")]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _write_state(spark: SparkSession, path: str, name: str, state: dict) -> None:
    text = json.dumps(state)
    row = (name, text, hashlib.sha256(text.encode()).hexdigest())
    literal_rows(spark, [row], _STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def _read_state(spark: SparkSession, path: str, name: str) -> dict:
    rows = spark.read.schema(_STATE_SCHEMA).parquet(path).where(F.col("name") == name).collect()
    if len(rows) != 1 or not rows[0]["state"] or hashlib.sha256(rows[0]["state"].encode()).hexdigest() != rows[0]["sha256"]:
        raise ValueError(f"{path} is damaged")
    return json.loads(rows[0]["state"])


def save_preparation(spark: SparkSession, model: CleaningModel, folder: str) -> None:
    """The fitted preparation as a row of JSON, and a table for each dictionary."""
    tables = []
    for i, (column, (dictionary, size, hot)) in enumerate(model.dictionaries.items()):
        dictionary.write.mode("overwrite").parquet(f"{folder}/dictionary-{i}")
        tables.append({"column": column, "size": size, "hot": hot})
    state = {"config": asdict(model.config), "dictionaries": tables, **{name: getattr(model, name) for name in _PLAIN}}
    _write_state(spark, f"{folder}/state", "preparation", state)


def load_preparation(spark: SparkSession, folder: str) -> CleaningModel:
    """The preparation that was saved; a folder that is not whole raises."""
    state = _read_state(spark, f"{folder}/state", "preparation")
    config = {k: tuple(v) if isinstance(v, list) else v for k, v in state["config"].items()}
    model = CleaningModel(CleaningConfig(**config), **{name: state[name] for name in _PLAIN})
    model.bounds = {c: tuple(b) for c, b in model.bounds.items()}
    model.log = [tuple(entry) for entry in model.log]
    for i, t in enumerate(state["dictionaries"]):
        dictionary = spark.read.schema("value string, code double").parquet(f"{folder}/dictionary-{i}")
        if dictionary.count() != t["size"]:
            raise ValueError(f"{folder}/dictionary-{i} is damaged")
        model.dictionaries[t["column"]] = (dictionary, t["size"], t["hot"])
    return model


def _load_estimator(spark: SparkSession, path: str, task: str):
    if exists(spark, f"{path}/forest"):
        return DeepForestModel.load(spark, path)
    name = json.loads(spark.read.text(f"{path}/metadata").first()[0])["class"].rsplit(".", 1)[-1]
    package = "pyspark.ml.classification" if task == CLASSIFICATION else "pyspark.ml.regression"
    return getattr(import_module(package), name).load(path)


def save_model(spark: SparkSession, trained: TrainedModel, path: str) -> None:
    if isinstance(trained.model, DeepForestModel):
        trained.model.save(f"{path}/estimator")
    else:
        trained.model.write().overwrite().save(f"{path}/estimator")
    save_preparation(spark, trained.cleaning, f"{path}/preparation")
    literal_rows(spark, list(enumerate(trained.classes)), f"position int, value {trained.target_type}").coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")
    state = {k: getattr(trained, k) for k in ("model_id", "name", "features", "task", "target", "target_type", "validation", "test", "cv_mean", "cv_std", "seconds", "params")}
    _write_state(spark, f"{path}/model", "model", {**state, "classes": len(trained.classes)})


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    """The whole model; a missing folder or one that is not whole raises."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no model in {path}")
    state = _read_state(spark, f"{path}/model", "model")
    n = state.pop("classes")
    rows = spark.read.schema(f"position int, value {state['target_type']}").parquet(f"{path}/classes").orderBy("position").collect()
    if [r["position"] for r in rows] != list(range(n)):
        raise ValueError(f"{path}/classes is damaged")
    return TrainedModel(model=_load_estimator(spark, f"{path}/estimator", state["task"]), cleaning=load_preparation(spark, f"{path}/preparation"), classes=[r["value"] for r in rows], **state)


class ModelRegistry:
    """Saved models in a folder (a deletion is one more row of the table)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _append(self, name: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).withColumn("created_at", F.coalesce("created_at", F.current_timestamp())).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        """The table, empty before its first row; a table that is there but cannot be read raises."""
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else literal_rows(self.spark, [], schema)

    def save(self, trained: TrainedModel, run_id: str, is_best: bool = False) -> str:
        path = f"{self.folder}/models/{trained.model_id}"
        save_model(self.spark, trained, path)
        metrics = json.dumps({"validation": trained.validation, "test": trained.test}, default=str)
        self._append("registry", (trained.model_id, run_id, trained.name, trained.task, trained.target, trained.features, json.dumps(trained.params), metrics,
                                  trained.seconds, path, is_best, False, None), REGISTRY_SCHEMA)
        return path

    def save_training(self, training: Training) -> None:
        for m in training.models:
            self.save(m, training.run_id, m is training.best)
        report = {**training.report().first().asDict(), "results": [r.asDict() for r in training.leaderboard.collect()]}
        self._append("experiments", (training.run_id, training.best.target, training.task, training.best.model_id, json.dumps(report, default=str), None), EXPERIMENT_SCHEMA)

    def list(self, task: str | None = None) -> DataFrame:
        """Models that are not deleted, newest first."""
        rows = self._read("registry", REGISTRY_SCHEMA)
        last = rows.groupBy("model_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "model_id"]), F.struct("created_at", "deleted")).alias("r"))
        live = last.select("model_id", "r.*").where("not deleted").drop("deleted")
        return (live.where(F.col("task") == task) if task else live).orderBy(F.desc("created_at"), "model_id")

    def metadata(self, model_id: str) -> dict | None:
        row = self.list().where(F.col("model_id") == model_id).first()
        return row.asDict() if row else None

    def latest_best(self, task: str | None = None) -> dict | None:
        row = self.list(task).where("is_best").first()
        return row.asDict() if row else None

    def choose(self, model_id: str | None = None, task: str | None = None) -> dict:
        """The model of that id; without one the latest best model, or else the newest."""
        if model_id is not None:
            meta = self.metadata(model_id)
            if meta is None:
                raise FileNotFoundError(f"no model {model_id}")
            return meta
        best = self.list(task).orderBy(F.desc("is_best"), F.desc("created_at"), "model_id").first()
        if best is None:
            raise LookupError("the registry has no model" + (f" for {task}" if task else ""))
        return best.asDict()

    def load(self, model_id: str) -> TrainedModel:
        return load_model(self.spark, self.choose(model_id)["path"])

    def predict(self, df: DataFrame, model_id: str | None = None, task: str | None = None) -> DataFrame:
        """Rows of df with the prediction, and for classes their probabilities, of the chosen stored model."""
        return predict(load_model(self.spark, self.choose(model_id, task)["path"]), df)

    def delete(self, model_id: str) -> bool:
        meta = self.metadata(model_id)
        if meta is None:
            return False
        self._append("registry", (model_id, meta["run_id"], meta["model_name"], meta["task"], meta["target"], meta["features"], meta["params"], meta["metrics"],
                                  meta["training_seconds"], meta["path"], meta["is_best"], True, None), REGISTRY_SCHEMA)
        return True

    def experiment(self, run_id: str) -> dict | None:
        row = self._read("experiments", EXPERIMENT_SCHEMA).where(F.col("run_id") == run_id).orderBy(F.desc("created_at")).first()
        return row.asDict() if row else None
