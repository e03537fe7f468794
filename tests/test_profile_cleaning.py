"""Profile, quality and cleaning on small tables with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brightledger.operators import cleaning as K
from brightledger.operators import profile as P


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_clean_table_scores_100(spark):
    df = spark.createDataFrame([(i, 20 + i, f"2025-01-0{i}", c) for i, c in zip(range(1, 6), "abcde")], "customer_id int, age int, signup_date string, city string")
    assert one(P.quality_score(df))["quality_score"] == 100.0
    profile = {r["column_name"]: r for r in P.column_profile(df).collect()}
    assert profile["customer_id"]["inferred_type"] == "id" and profile["signup_date"]["inferred_type"] == "datetime"
    assert one(P.duplicate_summary(df))["duplicate_rows"] == 0 and one(P.cell_summary(df))["missing_cells"] == 0


def test_duplicates_gaps_and_constants(spark):
    df = spark.createDataFrame([(1, 10.0, "A"), (2, None, "A"), (2, None, "A"), (4, 40.0, "A"), (5, 50.0, "A")], "id int, value double, constant_col string")
    assert one(P.duplicate_summary(df))["duplicate_rows"] == 1
    assert one(P.cell_summary(df))["missing_cells"] == 2
    codes = {(r["code"], r["column_name"], r["severity"]) for r in P.quality_warnings(df).collect()}
    assert codes == {("DUPLICATE_ROWS", None, "CRITICAL"), ("CONSTANT_COLUMN", "constant_col", "WARNING"), ("HIGH_MISSINGNESS", "value", "WARNING")}
    # 100 - 2/15*150 - 20 - min(15, 50/3) - 10 - 2*3
    assert one(P.quality_score(df))["quality_score"] == pytest.approx(100 - 20 - 20 - 15 - 10 - 6, abs=0.05)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert one(P.quality_score(df))["quality_score"] == 0.0
    assert [(r["severity"], r["code"]) for r in P.quality_warnings(df).collect()] == [("CRITICAL", "EMPTY_DATASET")]


def test_high_cardinality(spark):
    df = spark.createDataFrame([(i, f"place {i}") for i in range(60)], "user_index int, location string")
    assert ("INFO", "HIGH_CARDINALITY", "location") in {(r["severity"], r["code"], r["column_name"]) for r in P.quality_warnings(df).collect()}


def test_approximate_distinct_is_close(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("g"))
    got = {r["column_name"]: r["distinct_count"] for r in P.distinct_by_column(df, approximate=True).collect()}
    assert got["g"] == 7 and abs(got["id"] - 5000) < 500


@pytest.fixture(scope="module")
def messy(spark):
    rng = np.random.default_rng(42)
    n = 100
    normal = rng.normal(50, 10, n)
    pdf = pd.DataFrame({
        "user_id": [f"u{i:03d}" for i in range(n)],
        "created_at": pd.date_range("2024-01-01", periods=n).strftime("%Y-%m-%d"),
        "feature_normal": normal, "feature_outlier": rng.normal(0, 1, n), "feature_corr": 2 * normal + rng.normal(0, 0.01, n),
        "const_col": "same", "near_const_col": ["X"] * (n - 1) + ["Y"],
        "category_col": [None if i % 4 == 0 else "abc"[i % 3] for i in range(n)], "target": [i % 2 for i in range(n)],
    })
    pdf.loc[5, "feature_outlier"], pdf.loc[6, "feature_outlier"] = 999.0, -999.0
    pdf["feature_normal"] = [None if i % 10 == 0 else v for i, v in enumerate(pdf["feature_normal"])]
    pdf = pd.concat([pdf, pdf.iloc[:3]], ignore_index=True)
    df = spark.createDataFrame(pdf)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c.startswith("feature") else F.col(c) for c in df.columns])


def test_fit_runs_every_stage(spark, messy):
    model, cleaned = K.fit(messy, K.CleaningConfig(target="target"))
    assert model.duplicates_removed == 3 and model.rows_out == 100 and cleaned.count() == 100
    assert model.outliers_found >= 2
    assert set(model.removed) >= {"const_col", "near_const_col", "created_at"}
    assert "feature_corr" in model.removed and "feature_normal" not in model.removed
    assert one(P.cell_summary(cleaned))["missing_cells"] == 0
    assert "category_col_a" in cleaned.columns and "target" in cleaned.columns and "user_id" in cleaned.columns
    held = model.transform(messy.limit(20))
    assert held.columns == cleaned.columns and held.count() == 20
    steps = [r["step"] for r in model.report(spark)["log"].orderBy("position").collect()]
    assert steps == ["remove_duplicates", "date_parts", "constant_columns", "correlated_columns", "outliers", "fill_scale_encode"]


def test_no_refit_on_new_rows(spark):
    rng = np.random.default_rng(1)
    train = spark.createDataFrame(pd.DataFrame({"f1": rng.normal(10, 1, 100), "f2": rng.normal(10, 1, 100)}))
    held = spark.createDataFrame(pd.DataFrame({"f1": rng.normal(1000, 1, 50), "f2": rng.normal(1000, 1, 50)}))
    model, _ = K.fit(train)
    before = dict(model.shift)
    out = model.transform(held).agg(F.min("f1"), F.min("f2")).first()
    assert model.shift == before and all(v < 20 for v in before.values()) and min(out) > 100


def test_drop_rows_action_and_codes_for_many_categories(spark):
    rows = [(float(i), f"v{i % 40}" if i < 399 else None, i) for i in range(400)] + [(1e6, "v1", 400)]
    df = spark.createDataFrame(rows, "x double, word string, row_key int")
    model, cleaned = K.fit(df, K.CleaningConfig(outlier_action="drop_rows", encoding="ordinal", max_categories=10, drop_correlated=False))
    assert model.rows_out == cleaned.count() == 400
    assert "word" in model.dictionaries
    words = sorted({f"v{i}" for i in range(40)})
    got = {r["row_key"]: r["word"] for r in model.transform(df).collect()}
    assert all(got[i] == words.index(f"v{i % 40}") for i in range(399))
    new = spark.createDataFrame([(1.0, "never seen", 1)], "x double, word string, row_key int")
    assert model.transform(new).first()["word"] == -1.0
    wide, out = K.fit(df, K.CleaningConfig(encoding="onehot", onehot_form="vector"))
    first = out.first()["word_onehot"].toArray()
    assert out.schema["word_onehot"].dataType.simpleString() == "vector" and first.sum() == 1.0 and len(first) == 40
    assert wide.transform(new).first()["word_onehot"].toArray().tolist() == [0.0] * 40


def test_one_hot_has_one_form_for_every_number_of_categories(spark):
    for n in (256, 300):
        df = spark.range(2 * n).select(F.concat(F.lit("v"), F.col("id") % n).alias("word"), F.col("id").cast("double").alias("x"))
        out = K.encode(df, ["word"])
        assert len(out.columns) == n + 1
        row = out.where("x = 7").first().asDict()
        assert row.pop("x") == 7.0 and row.pop("word_v7") == 1.0 and set(row.values()) == {0.0}


@pytest.mark.parametrize("fill,want", [("median", 2.0), ("mean", 7 / 3), ("most_frequent", 1.0), ("constant", 9.0)])
def test_numeric_fills(spark, fill, want):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (4.0,)], "x double")
    got = sorted(r[0] for r in K.impute(df, ["x"], fill, 9.0).collect())
    assert any(v == pytest.approx(want) for v in got) and len(got) == 4


def test_scaling_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    for how in ("standard", "minmax", "robust"):
        assert {r[0] for r in K.scale(df, ["x"], how).collect()} == {0.0}


def test_drop_strategy(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None), (4.0, "b")], "x double, s string")
    model, cleaned = K.fit(df, K.CleaningConfig(numeric_fill="drop", category_fill="drop", outlier_action="none"))
    assert cleaned.count() == 2 == model.rows_out


def test_too_many_categories_for_columns_are_refused(spark):
    from brightledger.operators.cleaning import CleaningConfig, fit

    df = spark.range(300).select((F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("w"), F.col("id") % 120).alias("word"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind"))
    with pytest.raises(ValueError, match="word"):
        fit(df, CleaningConfig(max_columns=100))
    model, cleaned = fit(df, CleaningConfig(max_columns=100, onehot_form="vector"))
    assert "word_onehot" in cleaned.columns and model.dictionaries["word"][1] == 120
    assert len(fit(df, CleaningConfig(max_columns=123))[1].columns) == 1 + 123
    unseen = model.transform(spark.createDataFrame([(1.0, "never", "k1")], "x double, word string, kind string")).first()
    assert unseen["word_onehot"].numNonzeros() == 0 and unseen["kind_onehot"].numNonzeros() == 1


@pytest.mark.parametrize("threshold", [0.0, 0.5, 1.5])
def test_fills_of_clipped_numbers_are_their_medians(spark, monkeypatch, threshold):
    from brightledger.operators import cleaning

    asked, real = [], cleaning.quantiles
    monkeypatch.setattr(cleaning, "quantiles", lambda df, columns, probs: asked.append(probs) or real(df, columns, probs))
    monkeypatch.setattr(cleaning, "medians", lambda df, columns: asked.append([0.5]) or {c: v[0] for c, v in real(df, columns, [0.5]).items()})
    rows = [(float(i * i % 97), float(-i) if i % 3 else None, 1e9 if i % 11 == 0 else float(i % 5)) for i in range(60)]
    model, _ = cleaning.fit(spark.createDataFrame(rows, "x double, y double, z double"), cleaning.CleaningConfig(remove_duplicates=False, outlier_threshold=threshold))
    for i, c in enumerate("xyz"):
        lo, hi = model.bounds.get(c, (-np.inf, np.inf))
        assert model.fills[c] == np.median(np.clip([r[i] for r in rows if r[i] is not None], lo, hi))
    assert len(asked) == (1 if threshold >= 0.5 else 2)
