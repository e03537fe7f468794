"""Model training, comparison and prediction on Spark ML estimators; `registry` keeps the models."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce
from random import Random

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.columns import as_number, is_number, literal_rows, ref
from ..functions.durable import durable, ensure_checkpoint_dir
from ..functions.joins import frequent_values, lookup_join
from ..functions.layout import compact
from ..functions.ranking import hash_positions, positions, ranked_counts, slice_cuts
from .cleaning import CleaningConfig, CleaningModel, fit as fit_cleaning
from .forest import DeepForest

CLASSIFICATION, REGRESSION = "classification", "regression"
MACHINE_EPS = 2.220446049250313e-16

# Search grids per algorithm.
GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0]},
    "linear_regression": {"fitIntercept": [True, False]},
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [None, 10, 20, 30], "minRowsToSplit": [2, 5, 10]},
    "gradient_boosting": {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 5, 8]},
    "boosted_alt": {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 6, 10]},
}
CLASSIFIERS = ("logistic_regression", "random_forest", "gradient_boosting", "boosted_alt")
REGRESSORS = ("linear_regression", "random_forest", "gradient_boosting", "boosted_alt")


@dataclass(frozen=True)
class TrainingConfig:
    target: str
    task: str = "auto"
    models: tuple[str, ...] = ()
    test_size: float = 0.15
    val_size: float = 0.15
    folds: int = 5
    tuning: bool = False
    trials: int = 10
    seed: int = 42
    trees: int = 100
    key: tuple[str, ...] = ()
    cleaning: CleaningConfig = CleaningConfig()


def task_type(df: DataFrame, target: str) -> str:
    """Text and booleans are classes; numbers are classes with at most 10 distinct values, or 20 under 5 % of the rows."""
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    values = df.select(ref(target).alias("t")).where("t is not null")
    dtype = df.schema[target].dataType
    few = values.distinct().limit(21).count()
    if few == 0:
        raise ValueError(f"{target} has no values")
    if not is_number(dtype) or isinstance(dtype, T.BooleanType) or few <= 10:
        return CLASSIFICATION
    return CLASSIFICATION if few <= 20 and few / values.count() < 0.05 else REGRESSION


def task_types(df: DataFrame, targets: list[str]) -> DataFrame:
    return literal_rows(df.sparkSession, [(t, task_type(df, t)) for t in targets], "target string, task string")


def label_values(df: DataFrame, target: str) -> list:
    """Distinct classes in sorted order; their position is the label code."""
    return sorted(r[0] for r in df.where(ref(target).isNotNull()).select(ref(target)).distinct().collect())


def label_codes(df: DataFrame, target: str, classes: list | None = None) -> Column:
    classes = label_values(df, target) if classes is None else classes
    at = F.create_map(*[x for i, v in enumerate(classes) for x in (F.lit(v), F.lit(float(i)))])
    return F.try_element_at(at, ref(target))


def encode_labels(df: DataFrame, target: str, out: str = "label", literal_classes: int = 1000) -> DataFrame:
    """Adds the label code (position of the class in sorted order) without a limit on the number of classes.

    Up to ``literal_classes`` classes are literals; more become a dictionary table that is joined back with its
    frequent classes salted.
    """
    counts = df.where(ref(target).isNotNull()).groupBy(ref(target).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    size = counts.agg(F.count(F.lit(1)).alias("k"), F.sum("_n").alias("n")).first()
    if size["k"] <= literal_classes:
        return df.withColumn(out, label_codes(df, target)) if size["k"] else df.withColumn(out, F.lit(None).cast("double"))
    coded = positions(counts.select("_class"), ["_class"], out, size["k"]).withColumn(out, F.col(out).cast("double"))
    hot = frequent_values(counts, "_class", "_n", size["n"])
    return lookup_join(df.withColumn("_class", ref(target)), coded, "_class", hot).drop("_class")


def split(df: DataFrame, key: list[str], label: str | None, test_size: float = 0.15, val_size: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``part``: exact shares of train / val / test, inside each class when every class has two rows or more.

    Rows are ordered by an md5 digest of key and seed, so the split does not depend on partitions or runs.
    """
    digest = F.md5(F.concat_ws("|", *[ref(k).cast("string") for k in key], F.lit(str(seed))))
    group, work = [], df
    if label is not None:
        sizes = df.groupBy(ref(label).alias("l")).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.count(F.lit(1))).first()
        if sizes[0] is not None and sizes[0] >= 2 and sizes[1] > 1:
            group = [label]
    if not group:
        work, group = df.withColumn("_all", F.lit(0)), ["_all"]
    placed = hash_positions(work, group, digest, "_at", key)
    n_test = F.ceil(F.col("_at_size") * F.lit(test_size) - 1e-9)
    n_val = F.ceil(F.col("_at_size") * F.lit(val_size) - 1e-9)
    part = F.when(F.col("_at") < n_test, "test").when(F.col("_at") < n_test + n_val, "val").otherwise("train")
    return placed.withColumn("part", part).drop("_at", "_at_size", "_all")


# --- metrics --------------------------------------------------------------------------------------------

def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n): everything else about a classifier follows from this small table."""
    return rows.groupBy(ref(label).alias("label"), ref(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(rows: DataFrame, classes: list, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per true class, one column per predicted class."""
    wide = confusion(rows, label, prediction).groupBy("label").pivot("prediction", classes).agg(F.sum("n"))
    return wide.select("label", *[F.coalesce(ref(str(c)), F.lit(0)).cast("long").alias(f"predicted_{c}") for c in classes])


def class_metrics(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (0 where undefined)."""
    cells = confusion(rows, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    actual = cells.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    guessed = cells.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("guessed"))
    each = actual.join(guessed, "c", "left").withColumn("guessed", F.coalesce("guessed", F.lit(0)))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("guessed")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    total = F.sum("support")
    return each.agg(
        F.round(F.sum("tp") / total, 6).alias("accuracy"), F.round(F.sum(p * F.col("support")) / total, 6).alias("precision"),
        F.round(F.sum(r * F.col("support")) / total, 6).alias("recall"), F.round(F.sum(f * F.col("support")) / total, 6).alias("f1"),
    )


def roc_auc(rows: DataFrame, positive: Column, score: Column) -> DataFrame:
    """Exact area under the ROC curve from average ranks of the distinct scores (ties count half)."""
    counts = rows.select(score.cast("double").alias("s"), positive.cast("int").alias("y")).where("s is not null").groupBy("s").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    size = counts.agg(F.count(F.lit(1))).first()[0]
    cuts = slice_cuts(counts, {"s": F.col("s")}, size)["s"]
    ranked = ranked_counts(counts, "s", "n", cuts)
    pos, neg = F.sum("pos").cast("double"), F.sum(F.col("n") - F.col("pos")).cast("double")
    return ranked.agg(F.round(F.try_divide(F.sum(F.col("avg_rank") * F.col("pos")) - pos * (pos + 1) / 2, pos * neg), 6).alias("roc_auc"))


def roc_auc_by_class(rows: DataFrame, label: Column, shares: Column) -> DataFrame:
    """(code, roc_auc): one class against all others, for every position of the array of shares, in one pass.

    Equal scores of a class are counted first. Scores are cut into the same slices for all classes; ranks run inside a
    class's slice, and the sizes of the slices before it come from a small table.
    """
    each = rows.select(label.cast("long").alias("_y"), F.posexplode(shares).alias("code", "s")).where("s IS NOT NULL AND _y IS NOT NULL")
    counts = durable(each.groupBy("code", "s").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_y") == F.col("code")).cast("long")).alias("pos")))
    cuts = sorted(set(slice_cuts(counts, {"s": F.col("s")}, counts.count())["s"]))
    part = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda a, c: a + (F.col("s") > c).cast("int")) if cuts else F.lit(0)
    sliced = counts.withColumn("slice", part)
    sizes = sliced.groupBy("code", "slice").agg(F.sum("n").alias("m"))
    before = sizes.select("code", "slice", F.coalesce(F.sum("m").over(W.partitionBy("code").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("code", "slice").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = sliced.withColumn("ahead", ahead).join(before, ["code", "slice"]).withColumn("rank", F.col("before") + F.col("ahead") + (F.col("n") + 1) / 2)
    pos, neg = F.sum("pos").cast("double"), F.sum(F.col("n") - F.col("pos")).cast("double")
    area = F.try_divide(F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2, pos * neg)
    return ranked.groupBy("code").agg(F.round(area, 6).alias("roc_auc"))


def regression_metrics(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MAE, MSE, RMSE, R2 and MAPE (a fraction)."""
    y, p = as_number(rows, label), as_number(rows, prediction)
    err = y - p
    out = rows.agg(F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.var_pop(y).alias("v"), F.avg(F.abs(err) / F.greatest(F.abs(y), F.lit(MACHINE_EPS))).alias("mape"))
    return out.select(F.round("mae", 4).alias("mae"), F.round("mse", 4).alias("mse"), F.round(F.sqrt("mse"), 4).alias("rmse"),
                      F.round(1 - F.try_divide(F.col("mse"), F.col("v")), 6).alias("r2"), F.round("mape", 6).alias("mape"))


# --- estimators -----------------------------------------------------------------------------------------

def estimator(name: str, task: str, classes: int = 2, rows: int = 1, trees: int = 100, seed: int = 42, **params):
    """A Spark ML estimator for the algorithm, with the defaults the comparison uses."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    cols = {"featuresCol": "features", "labelCol": "label"}
    if task == CLASSIFICATION:
        if name == "logistic_regression":
            strength = params.pop("C", 1.0)
            return C.LogisticRegression(maxIter=1000, regParam=1.0 / (strength * max(1, rows)), standardization=False, **cols, **params)
        if name == "random_forest":
            return DeepForest(**{"classes": classes, "numTrees": trees, "seed": seed, **params})
        base = {"maxDepth": 3, "stepSize": 0.1} if name == "gradient_boosting" else {"maxDepth": 6, "stepSize": 0.3}
        boosted = C.GBTClassifier(**{"maxIter": trees, "seed": seed, **base, **cols, **params})
        return boosted if classes <= 2 else C.OneVsRest(classifier=boosted, parallelism=min(classes, 8), featuresCol="features", labelCol="label")
    if name == "linear_regression":
        return R.LinearRegression(**{**cols, **params})
    if name == "random_forest":
        return DeepForest(**{"classes": 0, "numTrees": trees, "seed": seed, **params})
    base = {"maxDepth": 3, "stepSize": 0.1} if name == "gradient_boosting" else {"maxDepth": 6, "stepSize": 0.3}
    return R.GBTRegressor(**{"maxIter": trees, "seed": seed, **base, **cols, **params})


def _evaluator(task: str):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    if task == CLASSIFICATION:
        return MulticlassClassificationEvaluator(metricName="f1")
    return RegressionEvaluator(metricName="rmse")


def param_draws(name: str, trials: int, seed: int) -> list[dict]:
    """A random subset of the grid without repeats."""
    combos = [{}]
    for k, values in GRIDS[name].items():
        combos = [{**c, k: v} for c in combos for v in values]
    return Random(seed).sample(combos, min(trials, len(combos)))


def fold_column(df: DataFrame, key: list[str], folds: int, seed: int = 42, label: str | None = None) -> DataFrame:
    """Adds ``fold``: rows in the order of a digest of key and seed take folds in turn, the same on every run and layout.

    With a label the turns run inside each class, so fold sizes differ by one row per class at most.
    """
    digest = F.md5(F.concat_ws("|", *[ref(k).cast("string") for k in key], F.lit(f"fold{seed}")))
    work, group = (df, [label]) if label else (df.withColumn("_all", F.lit(0)), ["_all"])
    placed = hash_positions(work, group, digest, "_turn", key)
    return placed.withColumn("fold", F.pmod("_turn", F.lit(folds)).cast("int")).drop("_turn", "_turn_size", "_all")


def cross_validate(vectors: DataFrame, task: str, make, folds: int) -> list[float]:
    """Score of each fold (weighted F1, or minus RMSE) for the estimator that ``make()`` builds."""
    judge, out = _evaluator(task), []
    for f in range(folds):
        train, held = vectors.where(F.col("fold") != f), vectors.where(F.col("fold") == f)
        if train.isEmpty() or held.isEmpty():
            continue
        value = judge.evaluate(make().fit(train).transform(held))
        out.append(value if task == CLASSIFICATION else -value)
    return out


def random_search(vectors: DataFrame, task: str, name: str, classes: int, rows: int, trials: int, folds: int, seed: int) -> tuple[dict, DataFrame]:
    """Best parameters of the drawn ones by mean fold score, and the table of all tries."""
    tried = []
    for params in param_draws(name, trials, seed):
        scores = cross_validate(vectors, task, lambda: estimator(name, task, classes, rows, seed=seed, **params), folds)
        mean = sum(scores) / len(scores)
        tried.append((json.dumps(params, sort_keys=True), float(mean), float((sum((x - mean) ** 2 for x in scores) / len(scores)) ** 0.5)))
    best = max(tried, key=lambda t: t[1])
    return json.loads(best[0]), literal_rows(vectors.sparkSession, tried, "params string, mean_score double, std_score double")


# --- training -------------------------------------------------------------------------------------------

@dataclass
class TrainedModel:
    model_id: str
    name: str
    model: object
    cleaning: CleaningModel
    features: list[str]
    task: str
    target: str
    classes: list
    validation: dict
    test: dict
    cv_mean: float | None
    cv_std: float | None
    seconds: float
    params: dict = field(default_factory=dict)
    target_type: str = "string"


@dataclass
class Training:
    run_id: str
    task: str
    models: list[TrainedModel]
    leaderboard: DataFrame
    best: TrainedModel
    total_rows: int = 0
    part_rows: dict[str, int] = field(default_factory=dict)

    def report(self) -> DataFrame:
        """One row: how many rows each part had, the features, and which model was chosen by which metric."""
        b = self.best
        metric = "f1" if self.task == CLASSIFICATION else "rmse"
        row = (self.run_id, b.target, self.task, self.total_rows, *(self.part_rows.get(p, 0) for p in ("train", "val", "test")), b.features, metric, b.model_id, b.name)
        return literal_rows(self.leaderboard.sparkSession, [row], "run_id string, target string, task string, total_rows long, train_rows long, validation_rows long,"
                            " test_rows long, features array<string>, selection_metric string, best_model_id string, best_model_name string")


def vectorise(cleaned: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    # The assembler reads dots in names as struct access, so it gets plain helper names. Vectors go in as they are.
    kinds = dict(cleaned.dtypes)
    named = cleaned.select(*[ref(k) for k in keep], *[(ref(f) if kinds[f] == "vector" else ref(f).cast("double")).alias(f"_f{i}") for i, f in enumerate(features)])
    out = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="features", handleInvalid="keep").transform(named)
    return out.select(*keep, "features")


def probabilities(scored: DataFrame) -> DataFrame:
    """Adds ``probs`` (array): class probabilities where the model gives them, else a 0 / 1 indicator from raw scores."""
    from pyspark.ml.functions import vector_to_array
    if "probs" in scored.columns:
        return scored
    if "probability" in scored.columns:
        return scored.withColumn("probs", vector_to_array("probability"))
    raw = vector_to_array("rawPrediction")
    logistic = F.transform(raw, lambda v: 1.0 / (1.0 + F.exp(-2.0 * v)))
    total = F.aggregate(logistic, F.lit(0.0), lambda s, v: s + v)
    return scored.withColumn("probs", F.transform(logistic, lambda v: v / total))


def evaluate(model, vectors: DataFrame, task: str, classes: int) -> dict:
    """Metrics of a fitted model on prepared rows."""
    scored = model.transform(vectors)
    if task == REGRESSION:
        return regression_metrics(scored).first().asDict()
    scored = probabilities(scored).select("label", "prediction", "probs").persist(StorageLevel.MEMORY_AND_DISK)
    out = class_metrics(scored).first().asDict()
    if classes == 2:
        out["roc_auc"] = roc_auc(scored, F.col("label") == 1.0, F.col("probs")[1]).first()[0]
    else:
        row = roc_auc_by_class(scored, F.col("label"), F.col("probs")).agg(F.count("roc_auc"), F.avg("roc_auc")).first()
        out["roc_auc"] = row[1] if row[0] == classes else None
    scored.unpersist()
    return out


def _trained_rows(cleaner: CleaningModel, rows: DataFrame) -> DataFrame:
    """The rows that the fit kept: without outliers where its action drops them."""
    if cleaner.config.outlier_action != "drop_rows" or not cleaner.bounds:
        return rows
    typed = cleaner.prepared(rows.withColumn("_row", F.struct("*")))
    return typed.where(~reduce(lambda a, b: a | b, [cleaner.is_outlier(c) for c in cleaner.bounds])).select("_row.*")


def train(df: DataFrame, config: TrainingConfig) -> Training:
    """Split, preparation fitted on the training part only, every chosen model, metrics and the leaderboard."""
    spark, target = df.sparkSession, config.target
    rows = df.where(ref(target).isNotNull())
    if rows.isEmpty():
        raise ValueError(f"{target} has no values")
    task = task_type(rows, target) if config.task == "auto" else config.task
    classes = label_values(rows, target) if task == CLASSIFICATION else []
    label = label_codes(rows, target, classes) if task == CLASSIFICATION else as_number(rows, target)
    key = list(config.key) or [c for c in rows.columns if c != target]
    inputs = [c for c in rows.columns if c != target]
    parts = split(rows.withColumn("label", label), key, "label" if task == CLASSIFICATION else None, config.test_size, config.val_size, config.seed)
    # The order of the folds is counted before its rows are numbered, and the split should not run for both.
    split_rows = parts.persist(StorageLevel.MEMORY_AND_DISK) if config.folds > 1 else parts
    # Folds are dealt among training rows only: each part and class is a group of its own.
    strata = split_rows.withColumn("_stratum", F.concat_ws("|", "part", F.col("label").cast("string") if task == CLASSIFICATION else F.lit("")))
    parts = fold_column(strata, key, config.folds, config.seed, "_stratum").drop("_stratum").persist(StorageLevel.MEMORY_AND_DISK)

    from dataclasses import replace
    cleaner, _ = fit_cleaning(parts.where("part = 'train'").select(*[ref(c) for c in inputs]), replace(config.cleaning, remove_duplicates=False))
    split_rows.unpersist()  # `parts` was written by then
    features = [c for c in cleaner.feature_names if c not in cleaner.kept or cleaner.roles.get(c) == "id" and is_number(df.schema[c].dataType)]
    # Label, part and fold ride along as pass-through columns, so the rows stay matched to their labels.
    cleaner_with_labels = replace(cleaner, kept=cleaner.kept + ["label", "part", "fold"])
    # Estimators see training rows as the fit saw them, with its outlier action; the other parts are only transformed.
    chosen_rows = parts.select(*[ref(c) for c in inputs], "label", "part", "fold")
    seen, unseen = (cleaner_with_labels.transform(_trained_rows(cleaner, chosen_rows.where("part = 'train'")), clip=True), cleaner_with_labels.transform(chosen_rows.where("part <> 'train'")))
    ready = vectorise(seen.unionByName(unseen), features, ["label", "part", "fold"])
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["part"]: r["n"] for r in ready.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = {p: ready.where(F.col("part") == p) for p in ("val", "test")}
    fit_rows = compact(ready.where("part = 'train'")).persist(StorageLevel.MEMORY_AND_DISK)
    n = sizes.get("train", 0)

    run_id, trained = f"run_{uuid.uuid4().hex[:10]}", []
    known = CLASSIFIERS if task == CLASSIFICATION else REGRESSORS
    chosen = [m for m in known if not config.models or m in config.models]
    if not chosen:
        raise ValueError(f"no known model for {task} among {config.models}")
    if {"gradient_boosting", "boosted_alt"} & set(chosen):
        ensure_checkpoint_dir(spark)  # boosting cuts its lineage, a step a round, only where there is such a folder
    for name in chosen:
        start, params = time.time(), {}
        if config.tuning:
            params, _ = random_search(fit_rows, task, name, len(classes), n, config.trials, config.folds, config.seed)
        make = lambda: estimator(name, task, len(classes), n, **{"trees": config.trees, "seed": config.seed, **params})
        model = make().fit(fit_rows)
        seconds = round(time.time() - start, 4)
        scores = cross_validate(fit_rows, task, make, config.folds) if config.folds > 1 else []
        mean = sum(scores) / len(scores) if scores else None
        spread = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5 if scores else None
        trained.append(TrainedModel(
            f"model_{name}_{uuid.uuid4().hex[:8]}", name, model, cleaner, features, task, target, classes,
            evaluate(model, held["val"], task, len(classes)), evaluate(model, held["test"], task, len(classes)), mean, spread, seconds, params,
            df.schema[target].dataType.simpleString()))
    pick = (lambda m: -(m.validation["f1"] or 0.0)) if task == CLASSIFICATION else (lambda m: m.validation["rmse"] if m.validation["rmse"] is not None else float("inf"))
    best = min(trained, key=pick)
    for used in (parts, ready, fit_rows):
        used.unpersist()
    return Training(run_id, task, trained, leaderboard(spark, trained, best), best, sum(sizes.values()), sizes)


METRIC_NAMES = {CLASSIFICATION: ("accuracy", "precision", "recall", "f1", "roc_auc"), REGRESSION: ("mae", "mse", "rmse", "r2", "mape")}


def leaderboard(spark: SparkSession, models: list[TrainedModel], best: TrainedModel) -> DataFrame:
    """One row per model: test metrics, validation selection metric, fold scores and the best flag."""
    names = METRIC_NAMES[best.task]
    choose = "f1" if best.task == CLASSIFICATION else "rmse"
    rows = [(m.model_id, m.name, m.task, m.validation.get(choose), *[m.test.get(k) for k in names], m.cv_mean, m.cv_std, m.seconds, m is best) for m in models]
    schema = f"model_id string, model_name string, task string, validation_{choose} double, " + ", ".join(f"test_{k} double" for k in names)
    return literal_rows(spark, rows, schema + ", cv_mean double, cv_std double, training_seconds double, is_best boolean")


def predict(trained: TrainedModel, df: DataFrame) -> DataFrame:
    """Input rows with ``prediction`` (original labels) and, for classes, ``probabilities`` (label -> share)."""
    from dataclasses import replace
    inputs = [c for c in df.columns if c != trained.target]
    packed = df.select(*[ref(c) for c in inputs], F.struct(*[ref(c) for c in df.columns]).alias("_row"))
    cleaner = replace(trained.cleaning, kept=trained.cleaning.kept + ["_row"], roles={**trained.cleaning.roles, "_row": "id"})
    scored = trained.model.transform(vectorise(cleaner.transform(packed), trained.features, ["_row"]))
    if trained.task == REGRESSION:
        return scored.select("_row.*", "prediction")
    names = F.array(*[F.lit(str(c)) for c in trained.classes])
    out = probabilities(scored)
    return out.select("_row.*", F.element_at(F.array(*map(F.lit, trained.classes)), F.col("prediction").cast("int") + 1).alias("prediction"),
                      F.map_from_arrays(names, "probs").alias("probabilities"))
