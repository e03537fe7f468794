"""Training, registry and explanations."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brightledger.functions import trees as T
from brightledger.operators import explain as X
from brightledger.operators import learn as L
from brightledger.operators import registry as R


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(0, 1, (200, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.3, 200) > 0, "ClassA", "ClassB")
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"feat_{i}" for i in range(5)]).assign(target=y, row_no=range(200))).persist()


def test_task_types(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("few"), F.col("id").alias("many"), (F.col("id") % 15).alias("mid"), F.lit("x").alias("s"), (F.col("id") > 5).alias("b"))
    want = {"few": "classification", "many": "regression", "mid": "regression", "s": "classification", "b": "classification"}
    assert {c: L.task_type(df, c) for c in want} == want
    assert L.task_type(df.unionAll(df).unionAll(df), "mid") == "classification"


@pytest.mark.parametrize("literals", [1000, 3])
def test_label_codes_with_and_without_a_dictionary(spark, literals):
    df = spark.range(200).select("id", F.when(F.col("id") % 20 != 7, F.concat(F.lit("c"), F.when(F.col("id") < 90, 0).otherwise(F.col("id") % 12))).alias("y"))
    got = L.encode_labels(df, "y", literal_classes=literals).toPandas()
    order = {c: float(i) for i, c in enumerate(sorted(got["y"].dropna().unique()))}
    assert len(got) == 200 and all((pd.isna(v) and y is None) or order[y] == v for y, v in zip(got["y"], got["label"]))


def test_split_has_exact_shares_and_ignores_layout(classes):
    a = L.split(classes, ["row_no"], "target")
    b = L.split(classes.repartition(7), ["row_no"], "target")
    assert sorted(a.select("row_no", "part").collect()) == sorted(b.select("row_no", "part").collect())
    sizes = {(r["target"], r["part"]): r["count"] for r in a.groupBy("target", "part").count().collect()}
    for c, n in classes.groupBy("target").count().collect():
        assert sizes[(c, "test")] == np.ceil(n * 0.15) and sizes[(c, "val")] == np.ceil(n * 0.15)


def test_training_prediction_and_registry(spark, classes, tmp_path):
    done = L.train(classes, L.TrainingConfig("target", models=("logistic_regression", "random_forest"), key=("row_no",), folds=2, trees=10))
    board = done.leaderboard.toPandas()
    assert len(board) == 2 and board["is_best"].sum() == 1 and done.task == "classification"
    assert board["test_accuracy"].min() > 0.7 and board["test_roc_auc"].min() > 0.8 and board["cv_mean"].notna().all()
    got = L.predict(done.best, classes).toPandas()
    assert len(got) == 200 and set(got["prediction"]) <= {"ClassA", "ClassB"}
    assert all(abs(sum(p.values()) - 1) < 1e-9 for p in got["probabilities"])
    assert (got["prediction"] == got["target"]).mean() > 0.8
    registry = R.ModelRegistry(spark, str(tmp_path))
    assert registry.list().count() == 0
    registry.save_training(done)
    assert registry.list("classification").count() == 2 and registry.list("regression").count() == 0
    assert registry.latest_best()["model_id"] == done.best.model_id
    loaded = registry.load(done.best.model_id)
    assert type(loaded.model) is type(done.best.model) and loaded.classes == done.best.classes
    assert registry.experiment(done.run_id)["best_model_id"] == done.best.model_id
    assert registry.delete(done.best.model_id) and not registry.delete(done.best.model_id)
    assert registry.list().count() == 1
    with pytest.raises(FileNotFoundError):
        registry.load(done.best.model_id)


@pytest.mark.parametrize("form", ["columns", "vector"])
def test_training_on_many_categories(spark, form):
    from brightledger.operators.cleaning import CleaningConfig

    df = spark.range(3000).select("id", F.concat(F.lit("v"), F.col("id") % 300).alias("word"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 300 < 150).cast("int").alias("y"))
    cleaning = CleaningConfig(onehot_form=form, drop_correlated=False)
    done = L.train(df, L.TrainingConfig("y", models=("logistic_regression",), key=("id",), folds=1, cleaning=cleaning))
    assert done.best.validation["accuracy"] > 0.9


def test_training_rows_are_clipped_and_others_are_not(spark):
    from brightledger.operators.cleaning import CleaningConfig, fit

    df = spark.createDataFrame([(float(i % 10), i) for i in range(99)] + [(1e6, 99)], "x double, row_key int")
    model, _ = fit(df, CleaningConfig(scaling="none"))
    assert L._trained_rows(model, df).count() == 100
    assert model.transform(df, clip=True).agg(F.max("x")).first()[0] < 100 < model.transform(df).agg(F.max("x")).first()[0]
    dropping, _ = fit(df, CleaningConfig(scaling="none", outlier_action="drop_rows"))
    assert L._trained_rows(dropping, df).count() == 99 and L._trained_rows(dropping, df).columns == df.columns


def test_folds_differ_by_one_row_per_class(classes):
    folded = L.fold_column(classes, ["row_no"], 5, label="target")
    n = folded.groupBy("target", "fold").count().groupBy("target").agg(F.max("count") - F.min("count"), F.count("fold")).collect()
    assert all(r[1] <= 1 and r[2] == 5 for r in n)
    same = lambda df: sorted(map(tuple, L.fold_column(df, ["row_no"], 5, label="target").select("row_no", "fold").collect()))
    assert same(classes.repartition(1)) == same(classes.repartition(17))


def test_regression_training(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (200, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(price=3 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 200)))
    done = L.train(df, L.TrainingConfig("price", models=("linear_regression", "gradient_boosting"), folds=1, trees=5))
    assert done.task == "regression" and done.best.name == "linear_regression" and done.best.test["r2"] > 0.95
    assert L.predict(done.best, df).count() == 200


def test_multiclass_boosting_uses_one_model_per_class(spark):
    df = spark.range(90).select((F.col("id") % 3).cast("string").alias("y"), ((F.col("id") % 3) * 10 + F.rand(1)).alias("x"), F.rand(2).alias("z"))
    done = L.train(df, L.TrainingConfig("y", models=("gradient_boosting",), folds=1, trees=2))
    # Split candidates are bins, so a row next to a class border may fall on the wrong side.
    assert done.best.test["accuracy"] >= 0.85
    assert all(abs(sum(p.values()) - 1) < 1e-9 for (p,) in L.predict(done.best, df).select("probabilities").collect())


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1), (0, 0.05)]
    df = spark.createDataFrame(rows, "y int, s double")
    wins = sum((a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z)
    assert L.roc_auc(df, F.col("y") == 1, F.col("s")).first()[0] == pytest.approx(wins / 9, abs=1e-6)


@pytest.mark.parametrize("cuts", [[], [0.2, 0.5, 0.5, 0.9]])
def test_auc_of_all_classes_in_one_pass(spark, monkeypatch, cuts):
    rng = np.random.default_rng(2)
    rows = [(float(rng.integers(4)), [float(x) for x in rng.integers(0, 8, 5) / 8]) for _ in range(300)]
    df = spark.createDataFrame(rows, "label double, probs array<double>")
    monkeypatch.setattr(L, "slice_cuts", lambda *_: {"s": cuts})
    got = {r["code"]: r["roc_auc"] for r in L.roc_auc_by_class(df, F.col("label"), F.col("probs")).collect()}
    for k in range(4):
        a = [p[k] for y, p in rows if y == k]
        b = [p[k] for y, p in rows if y != k]
        assert got[k] == pytest.approx(np.mean([(x > z) + 0.5 * (x == z) for x in a for z in b]), abs=1e-6)
    assert got[4] is None


def test_class_metrics_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "a"), ("c", "c")], "label string, prediction string")
    m = L.class_metrics(df).first()
    assert m["accuracy"] == 0.75 and m["recall"] == 0.75
    assert m["precision"] == pytest.approx((2 * 2 / 3 + 0 + 1) / 4, abs=1e-6)


def brute_force_shap(tree, x):
    """Average over all feature orders of the path-dependent expectation."""
    def value(node, known):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        l, r = tree.left[node], tree.right[node]
        if f in known:
            return value(l if x[f] <= tree.threshold[node] else r, known)
        return (tree.cover[l] * value(l, known) + tree.cover[r] * value(r, known)) / tree.cover[node]
    n = len(x)
    out = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for k in range(n):
            for s in combinations(others, k):
                w = factorial(k) * factorial(n - k - 1) / factorial(n)
                out[i] += w * (value(0, {*s, i}) - value(0, set(s)))
    return out


def test_tree_shap_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=x[:, 0] * x[:, 1] + x[:, 2]))
    rows, features, model, task = X.surrogate(df, "y", trees=3, depth=4)
    assert task == "regression" and features == ["a", "b", "c"]
    fitted = T.model_trees(model, spark)
    got = X.tree_shap(rows, features, model).toPandas().sort_values("a")
    cells = np.stack(got["xs"])
    phi = np.stack(got["phi"])
    for i in range(5):
        want = sum(t.weight * brute_force_shap(T.Tree(t.feature, t.threshold, t.left, t.right, t.value, t.cover, 1.0), cells[i]) for t in fitted)
        assert np.allclose(phi[i], want, atol=1e-9)
    assert np.allclose(phi.sum(1) + got["base"], T.predict(fitted, cells))
    paths = T.leaf_paths(fitted)
    monkeypatch.setattr(T, "BLOCK", 10)
    assert np.allclose(T.shap_values(paths, cells), phi)
    assert T.shap_values(paths, cells[:0]).shape == (0, 3)


def random_tree(rng, features, depth, cover=1000.0):
    """A tree that asks for the same features again and again on its paths."""
    tree = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}

    def grow(level, size):
        at = len(tree["feature"])
        for k, v in zip(tree, (-1, 0.0, -1, -1, rng.normal(), size)):
            tree[k].append(v)
        if level < depth and rng.random() < 0.9:
            tree["feature"][at], tree["threshold"][at] = int(rng.integers(features)), rng.normal()
            share = rng.uniform(0.1, 0.9)
            tree["left"][at] = grow(level + 1, size * share)
            tree["right"][at] = grow(level + 1, size * (1 - share))
        return at

    grow(0, cover)
    return T.Tree(*(np.array(tree[k]) for k in tree), 1.0)


@pytest.mark.parametrize("features,depth", [(1, 6), (3, 6), (6, 7), (8, 4)])
def test_shapley_values_of_deep_trees_equal_brute_force(features, depth):
    rng = np.random.default_rng(features)
    trees = [random_tree(rng, features, depth) for _ in range(3)]
    x = rng.normal(0, 1, (4, features))
    paths = T.leaf_paths(trees)
    want = np.array([sum(brute_force_shap(t, row) for t in trees) for row in x])
    assert np.allclose(T.shap_values(paths, x), want, atol=1e-10)
    assert np.allclose(want.sum(1) + T.expected_value(paths), T.predict(trees, x))


def test_a_hundred_deep_trees_stay_small():
    rng = np.random.default_rng(1)
    trees = [random_tree(rng, 12, 10) for _ in range(100)]
    paths = T.leaf_paths(trees)
    x = rng.normal(0, 1, (3, 12))
    assert sum(a.nbytes for p in paths for a in (p.low, p.high, p.ratio, p.value)) < 100 << 20
    assert np.allclose(T.shap_values(paths, x).sum(1) + T.expected_value(paths), T.predict(trees, x))


def test_classifier_shap_sums_to_the_probability(spark, classes):
    rows, features, model, task = X.surrogate(classes.drop("row_no"), "target", trees=5, depth=4)
    assert task == "classification"
    got = X.tree_shap(rows, features, model).toPandas()
    fitted = T.model_trees(model, spark)
    assert np.allclose(np.stack(got["phi"]).sum(1) + got["base"], T.predict(fitted, np.stack(got["xs"])))


def test_explanations_are_ranked(classes):
    out = X.explain(classes.withColumnRenamed("row_no", "name").withColumn("name", F.col("name").cast("string")), "target", key=["name"], trees=5)
    g = out["global"].orderBy("rank").collect()
    assert g[0]["rank"] == 1 and g[0]["feature_name"] == "feat_0" and len(g) == 5
    row = out["local"].first()
    sizes = [abs(c["contribution"]) for c in row["contributions"]]
    assert sizes == sorted(sizes, reverse=True) and len(row["top_positive"]) <= 3
    assert all(c["contribution"] < 0 for c in row["top_negative"])


def test_tree_shap_works_out_each_cell_once(spark, monkeypatch):
    """Rows between the same thresholds share one computation, wherever they lie."""
    from brightledger.functions.trees import leaf_paths, model_trees, shap_values

    df = spark.range(4000).selectExpr("id + 0.5D AS a", "CAST(id % 7 AS DOUBLE) AS b", "CAST(id > 1500 AND id % 7 > 2 AS INT) AS t").repartition(5)
    rows, features, model, _ = X.surrogate(df, "t", trees=2, depth=2)
    asked, join = [], X.join_few
    monkeypatch.setattr(X, "join_few", lambda r, known, on: asked.append(known.count()) or join(r, known, on))
    got = X.tree_shap(rows, features, model)
    assert got.columns == [*rows.columns, "xs", "phi", "base"] and 2 <= asked[0] <= 49
    out = got.toPandas()
    want = shap_values(leaf_paths(model_trees(model, spark)), np.stack(out["xs"].to_numpy()))
    assert len(out) == 4000 and np.allclose(np.stack(out["phi"].to_numpy()), want)


def test_pairs_of_one_pass_are_few(spark, monkeypatch):
    from brightledger.functions import moments

    asked = []
    monkeypatch.setattr(moments, "pearson", lambda x, y, real=moments.pearson: asked.append(1) or real(x, y))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6))
    x[:, 3] += x[:, 0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdef")))
    passes = []
    monkeypatch.setattr(type(df), "agg", lambda self, *c, real=type(df).agg: passes.append(len(c)) or real(self, *c))
    found = moments.pair_correlations(df, list("abcdef"))
    assert max(passes) <= moments.PASS_PAIRS and sum(passes) == len(asked) == 15
    for (a, b), r in found.items():
        assert r == pytest.approx(np.corrcoef(x[:, ord(a) - 97], x[:, ord(b) - 97])[0, 1])


def test_the_surrogate_remembers_nodes_and_stays_the_same_forest(spark):
    """Rows keep the node they are in from level to level, which changes no tree."""
    from pyspark.ml.classification import RandomForestClassifier

    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (600, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=np.where(x[:, 0] * x[:, 1] > 0, "u", "v"))).coalesce(1)
    rows, features, model, _ = X.surrogate(df, "y", trees=6, depth=5)
    assert model.getCacheNodeIds()
    plain = RandomForestClassifier(numTrees=6, maxDepth=5, seed=42, labelCol="label", featuresCol="features").fit(L.vectorise(rows, features, ["label"]).coalesce(1))
    assert model.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]
