"""Stored models: whole, checked, and usable by a session that never saw the training data."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brightledger.operators import learn as L
from brightledger.operators.cleaning import CleaningConfig, fit
from brightledger.operators.registry import ModelRegistry, load_preparation, save_preparation


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    return spark.range(400).select(
        i.alias("row_key"), (i % 13).cast("double").alias("x"), F.when(i % 9 != 0, (i * 7 % 31).cast("double")).alias("y.z"), F.when(i % 6 != 1, F.concat(F.lit("it's "), i % 5)).alias("word"),
        F.concat(F.lit("w"), i % 60).alias("many"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(id % 90)").alias("day"), F.when(i % 13 + i % 5 > 8, "yes").otherwise("no").alias("target"),
    )


@pytest.fixture(scope="module")
def stored(spark, table, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("registry"))
    config = L.TrainingConfig("target", models=("logistic_regression", "random_forest"), key=("row_key",), folds=1, trees=5, cleaning=CleaningConfig(encoding="ordinal", max_categories=10))
    done = L.train(table, config)
    registry = ModelRegistry(spark, folder)
    registry.save_training(done)
    return registry, done, folder


def rows(df):
    return sorted((r["row_key"], r["prediction"], tuple(sorted(r["probabilities"].items()))) for r in df.collect())


def test_loaded_models_predict_the_same_rows(stored, table):
    registry, done, _ = stored
    for m in done.models:
        assert "many" in m.cleaning.dictionaries
        loaded = registry.load(m.model_id)
        assert (loaded.classes, loaded.features, loaded.task, loaded.target, loaded.test) == (m.classes, m.features, m.task, m.target, m.test)
        assert loaded.cleaning.log == m.cleaning.log and loaded.cleaning.config == m.cleaning.config and loaded.cleaning.bounds == m.cleaning.bounds
        assert rows(L.predict(loaded, table)) == rows(L.predict(m, table)) == rows(registry.predict(table, m.model_id))
    assert rows(registry.predict(table)) == rows(L.predict(done.best, table))
    unseen = table.drop("target").limit(3).withColumn("many", F.lit("never seen")).withColumn("word", F.lit(None).cast("string"))
    assert registry.predict(unseen).count() == 3


def test_a_fresh_session_predicts_the_same(stored, table, tmp_path):
    registry, done, folder = stored
    table.write.parquet(str(tmp_path / "in"))
    code = f"""
from brightledger.operators.registry import ModelRegistry
from brightledger.session import local_session
spark = local_session(2)
out = ModelRegistry(spark, {folder!r}).predict(spark.read.parquet({str(tmp_path / "in")!r}))
out.write.parquet({str(tmp_path / "out")!r})
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent, env={**os.environ, "PYTHONPATH": str(Path(__file__).parent.parent)}, timeout=300)
    assert rows(table.sparkSession.read.parquet(str(tmp_path / "out"))) == rows(L.predict(done.best, table))


def test_choice_by_id_best_and_newest(spark, stored, tmp_path):
    registry, done, _ = stored
    other = [m for m in done.models if m is not done.best][0]
    assert registry.choose()["model_id"] == registry.latest_best()["model_id"] == done.best.model_id and registry.choose(other.model_id)["model_name"] == other.name
    with pytest.raises(FileNotFoundError):
        registry.predict(spark.range(1), "nobody")
    empty = ModelRegistry(spark, str(tmp_path / "none"))
    assert empty.list().count() == 0 and empty.experiment("x") is None and empty.latest_best() is None
    with pytest.raises(LookupError):
        empty.choose()
    empty.save(other, "r1")
    empty.save(done.best, "r2")
    assert empty.latest_best() is None and empty.choose()["model_id"] == done.best.model_id
    with pytest.raises(LookupError):
        empty.choose(task="regression")
    empty.save(other, "r3", is_best=True)
    assert empty.choose()["model_id"] == other.model_id


def test_training_report(stored):
    registry, done, _ = stored
    r = done.report().first()
    assert r["total_rows"] == 400 and r["train_rows"] + r["validation_rows"] + r["test_rows"] == 400 and r["selection_metric"] == "f1" and r["best_model_id"] == done.best.model_id
    kept = json.loads(registry.experiment(done.run_id)["report"])
    assert kept["features"] == done.best.features and len(kept["results"]) == 2 and kept["test_rows"] == r["test_rows"]


def damage(folder, part):
    found = [f for f in Path(folder).rglob("*.parquet") if part in str(f)]
    assert found
    for f in found:
        f.write_bytes(b"not a table")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize("part", ["preparation/state", "dictionary-0", "/model/", "/classes/", "registry/"])
def test_a_damaged_folder_raises(spark, stored, tmp_path, part):
    registry, done, _ = stored
    broken = ModelRegistry(spark, str(tmp_path))
    broken.save(done.best, "run", True)
    damage(tmp_path, part)
    with pytest.raises(Exception, match="(?i)parquet|damaged"):
        broken.load(done.best.model_id)
    if part == "registry/":
        with pytest.raises(Exception, match="(?i)parquet"):
            broken.list().collect()


@pytest.mark.parametrize("encoding", ["onehot", "ordinal", "none"])
def test_a_preparation_survives_storage(spark, table, tmp_path, encoding):
    model, _ = fit(table, CleaningConfig(target="target", encoding=encoding, max_categories=10, onehot_form="vector", scaling="robust", outlier_action="impute", category_fill="constant"))
    save_preparation(spark, model, str(tmp_path))
    got = load_preparation(spark, str(tmp_path))
    assert got.transform(table).columns == model.transform(table).columns
    assert sorted(map(str, got.transform(table).collect())) == sorted(map(str, model.transform(table).collect()))
    assert {k: v.collect() for k, v in got.report(spark).items()} == {k: v.collect() for k, v in model.report(spark).items()}


def test_regression_models_are_stored(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("row_key"), (F.col("id") % 17).cast("double").alias("a"), (3.0 * (F.col("id") % 17) + F.col("id") % 3).alias("price"))
    done = L.train(df, L.TrainingConfig("price", task="regression", models=("linear_regression", "gradient_boosting"), key=("row_key",), folds=1, trees=3))
    registry = ModelRegistry(spark, str(tmp_path))
    registry.save_training(done)
    for m in done.models:
        same = lambda out: sorted((r["row_key"], r["prediction"]) for r in out.collect())
        assert same(registry.predict(df, m.model_id)) == same(L.predict(m, df))
    assert registry.choose(task="regression")["model_id"] == done.best.model_id
