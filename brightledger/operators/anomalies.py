"""Anomaly detection: z-score, IQR, isolation forest and their ensemble, with severity and contributing features.

Every method is fitted by bounded aggregates (means, deviations, quantiles, a forest of at most some thousand
nodes) and scored in one narrow pass over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_number, is_number, literal_rows, ref
from ..functions.layout import spread
from ..functions.quantiles import medians, quantiles

TINY = 1e-8
# Lower score limit of each severity.
SEVERITIES = ((0.85, "Critical"), (0.70, "High"), (0.50, "Medium"), (0.0, "Low"))
TOP_FEATURES = 3
TREES, TREE_ROWS = 100, 256
#: Contents with this share of the rows are sampled with certainty; the sketch that finds them tracks so many items.
FREQUENT, TRACKED = 1e-4, 1 << 17


@dataclass(frozen=True)
class AnomalyConfig:
    method: str = "ensemble"     # ensemble, isolation_forest, zscore, iqr
    features: tuple[str, ...] = ()
    contamination: float = 0.05
    z_threshold: float = 3.0
    iqr_multiplier: float = 1.5
    id_column: str | None = None


def default_features(df: DataFrame) -> list[str]:
    """Numeric columns that are no identifiers by name."""
    return [f.name for f in df.schema.fields if is_number(f.dataType) and f.name.lower() != "id" and not f.name.lower().endswith("_id")]


def _x(c: str) -> str:
    return f"_x_{c}"


@dataclass
class AnomalyScale:
    features: list[str]
    median: dict[str, float | None]
    mean: dict[str, float]
    std: dict[str, float]
    quartiles: dict[str, tuple[float, float]]


def fit_scale(df: DataFrame, features: list[str]) -> AnomalyScale:
    """Medians for gaps, then mean, population deviation and quartiles of the filled features."""
    views = {c: as_number(df, c) for c in features}
    counts = df.agg(F.count(F.lit(1)), *[F.count(x) for x in views.values()]).first()
    gaps = [c for i, c in enumerate(features) if counts[i + 1] < counts[0]]
    middle = dict.fromkeys(features)
    middle.update(medians(df, {c: views[c] for c in gaps}) if gaps else {})
    full = {c: F.coalesce(x, F.lit(middle[c])) if middle[c] is not None else x for c, x in views.items()}
    row = df.agg(*[F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(f"s{i}") for i, x in enumerate(full.values())]).first()
    q = quantiles(df, full, [0.25, 0.75])
    return AnomalyScale(
        features, middle, {c: row[i]["m"] or 0.0 for i, c in enumerate(features)}, {c: row[i]["s"] or TINY for i, c in enumerate(features)},
        {c: (v[0] or 0.0, v[1] or 0.0) for c, v in q.items()},
    )


def filled(df: DataFrame, scale: AnomalyScale) -> DataFrame:
    """The table with one filled numeric helper column per feature."""
    extra = [(F.coalesce(as_number(df, c), F.lit(scale.median[c])) if scale.median[c] is not None else as_number(df, c)).alias(_x(c)) for c in scale.features]
    return df.select(*[ref(c) for c in df.columns], *extra)


def z_of(c: str, scale: AnomalyScale) -> Column:
    return F.abs((ref(_x(c)) - F.lit(scale.mean[c])) / F.lit(scale.std[c]))


def _largest(parts: list[Column]) -> Column:
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def _clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def zscore_columns(scale: AnomalyScale, threshold: float = 3.0) -> tuple[Column, Column]:
    top = _largest([z_of(c, scale) for c in scale.features])
    return top > threshold, _clip01(top / (threshold * 2.0))


def iqr_columns(scale: AnomalyScale, k: float = 1.5) -> tuple[Column, Column]:
    parts = []
    for c in scale.features:
        q1, q3 = scale.quartiles[c]
        iqr = (q3 - q1) or TINY
        lo, hi, x = F.lit(q1 - k * iqr), F.lit(q3 + k * iqr), ref(_x(c))
        parts.append((F.greatest(F.lit(0.0), x - hi) + F.greatest(F.lit(0.0), lo - x)) / F.lit(iqr))
    top = _largest(parts)
    return top > 0, _clip01(top / (k * 3.0))


# --- isolation forest (Liu, Ting and Zhou 2008) ---------------------------------------------------------

def _average_path(n):
    """Mean depth of an unsuccessful search among n items."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
        return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, limit: int, rng) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, split, left, right, path length at a leaf) of one random tree."""
    nodes: list = [None]
    work = [(0, np.arange(len(x)), 0)]
    while work:
        at, rows, depth = work.pop()
        sub = x[rows]
        wide = np.flatnonzero(sub.max(0) > sub.min(0)) if len(rows) > 1 else []
        if depth >= limit or len(wide) == 0:
            nodes[at] = (-1, 0.0, -1, -1, depth + float(_average_path(len(rows))))
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(sub[:, f].min(), sub[:, f].max()))
        left, right = len(nodes), len(nodes) + 1
        nodes.extend([None, None])
        nodes[at] = (f, cut, left, right, 0.0)
        go = sub[:, f] <= cut
        work += [(left, rows[go], depth + 1), (right, rows[~go], depth + 1)]
    return nodes


def isolation_trees(table: DataFrame, features: list[str], rows: int, seed: int = 42, trees: int = TREES, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(tree, node, feature, cut, left, right, depth): one random tree per group of sampled rows.

    Rows with equal features are one content with a number of copies. A content is kept if its hash lies in a share of the
    hash range that holds a bounded number of contents, or if it has FREQUENT of all rows; no other row is moved.
    Of the kept ones as many copies are drawn as their number, over the share, asks for, and a hash of copy and tree
    picks the rows of each tree. Layout and order of the rows change nothing.
    """
    pool_size = trees * tree_rows
    names = [f"f{i}" for i in range(len(features))]
    span = 1 << 40
    chance = min(1.0, 1.1 * pool_size / rows) if rows > pool_size else 1.0
    cells = table.select(*[ref(_x(c)).alias(n) for c, n in zip(features, names)]).withColumn("h", F.xxhash64(*names))
    # Sketches of fixed size: how many contents there are, and a list that holds every content with FREQUENT of the rows.
    facts = cells.agg(F.approx_count_distinct("h", 0.02).alias("contents"), F.expr(f"approx_top_k(h, {TRACKED // 6}, {TRACKED})").alias("top")).first()
    often = [t["item"] for t in facts["top"] if t["count"] >= FREQUENT * rows] if chance < 1.0 else []
    share = min(1.0, 2.0 * pool_size / max(1, facts["contents"])) if chance < 1.0 else 1.0
    unit = lambda salt: F.pmod(F.xxhash64("h", F.lit(seed + salt)), F.lit(span)) / F.lit(float(span))
    drawn_anyway = unit(2) < share
    kept = cells.where((drawn_anyway | F.col("h").isin(often)) if often else drawn_anyway)
    equal = kept.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[F.max(n).alias(n) for n in names])
    frequent = F.col("n") >= F.lit(FREQUENT * rows)
    weight = F.when(frequent, 1.0).when(drawn_anyway, 1.0 / share).otherwise(0.0)
    copies = F.floor(F.col("n") * weight * F.lit(chance) + F.when(weight > 0, unit(0)).otherwise(0.0)).cast("int") if chance < 1.0 else F.col("n").cast("int")
    drawn = equal.withColumn("k", copies).where("k > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("k"))))
    drawn = drawn.select(*names, F.xxhash64("h", "copy").alias("h"))
    expected = min(rows, int(1.1 * pool_size))
    share = min(1.0, 1.25 * tree_rows / max(1, expected))
    picked = (
        drawn.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("r", F.pmod(F.xxhash64("h", "tree", F.lit(seed + 1)), F.lit(span)))
        .where(F.col("r") < int(span * share))
    )
    size = min(tree_rows, rows)
    limit = int(np.ceil(np.log2(max(size, 2))))

    def build(key, pdf):
        chosen = pdf.sort_values(["r", *names]).head(tree_rows)
        nodes = _grow(chosen[names].to_numpy(float), limit, np.random.default_rng([seed, int(key[0])]))
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", key[0])
        return out

    return picked.groupBy("tree").applyInPandas(build, "tree int, node int, feature int, cut double, left int, right int, depth double")


def isolation_scores(table: DataFrame, features: list[str], contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds iso_flag and iso_score (1 minus the min-max scaled decision value).

    Raw scores come from the broadcast nodes, in Arrow batches that hold the features alone. The flag limit and the
    scaling need their quantile and range, for which the scores, and nothing else, are kept until these are known.
    """
    rows = table.count()
    grown = isolation_trees(table, features, rows, seed).collect()
    limit = int(np.ceil(np.log2(max(min(TREE_ROWS, rows), 2))))
    shared = table.sparkSession.sparkContext.broadcast(_heaps(grown, limit))
    scale = float(_average_path(min(TREE_ROWS, rows))) or 1.0

    @F.pandas_udf("double")
    def score(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(-np.exp2(-_mean_depth(cells.to_numpy(float), *shared.value) / scale))

    raw = score(F.struct(*[ref(_x(c)) for c in features]))
    scored = spread(table).withColumn("_iso", raw)
    alone = scored.select("_iso").persist(StorageLevel.MEMORY_AND_DISK)
    offset = quantiles(alone, {"s": F.col("_iso")}, [contamination])["s"][0]
    lo, hi = alone.agg(F.min("_iso"), F.max("_iso")).first()
    alone.unpersist()
    decision = F.col("_iso") - F.lit(offset)
    return scored.withColumn("iso_flag", decision < 0).withColumn(
        "iso_score", 1.0 - (F.col("_iso") - F.lit(lo)) / (F.lit(hi) - F.lit(lo) + TINY)).drop("_iso")


def _heaps(grown: list, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, path length) of all trees as complete binary trees: the children of node k are 2 k + 1 and 2 k + 2.

    Below a leaf every value goes left to a copy of it, so each walk takes the same number of steps.
    """
    by_tree: dict[int, dict] = {}
    for r in grown:
        by_tree.setdefault(r["tree"], {})[r["node"]] = r
    inner = (1 << limit) - 1
    feature, cut, depth = np.zeros((len(by_tree), inner), np.int64), np.full((len(by_tree), inner), np.inf), np.zeros((len(by_tree), inner + 1))
    for i, t in enumerate(sorted(by_tree)):
        work = [(0, 0)]
        while work:
            node, at = work.pop()
            r = by_tree[t][node]
            if r["feature"] >= 0:
                feature[i, at], cut[i, at] = r["feature"], r["cut"]
                work += [(r["left"], 2 * at + 1), (r["right"], 2 * at + 2)]
                continue
            while at < inner:
                at = 2 * at + 1
            depth[i, at - inner] = r["depth"]
    return feature, cut, depth


def _mean_depth(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Mean path length of every row over all trees."""
    total = np.zeros(len(x))
    if not len(x):
        return total
    inner, width = feature.shape[1], x.shape[1]
    flat, first = x.ravel(), np.arange(len(x)) * width
    for f, c, d in zip(feature, cut, depth):
        # All rows are at the root first. What is not left of a cut, gaps too, goes right; "clip" spares the check of indices.
        at = 2 - (flat[f[0] :: width] <= c[0]).astype(np.int64)
        while at[0] < inner:
            left = flat.take(first + f.take(at, mode="clip"), mode="clip") <= c.take(at, mode="clip")
            at = 2 * at + 2 - left
        total += d.take(at - inner, mode="clip")
    return total / max(1, len(feature))


def severity_of(score: Column) -> Column:
    out = F.lit("Low")
    for limit, name in reversed(SEVERITIES[:-1]):
        out = F.when(score >= limit, name).otherwise(out)
    return out


def contributions(scale: AnomalyScale, k: int = TOP_FEATURES) -> Column:
    """The ``k`` features with the largest deviation, largest first (ties: by name), as a map to z rounded to 3."""
    parts = F.array(*[F.struct((-z_of(c, scale)).alias("a"), F.lit(c).alias("b")) for c in scale.features])
    top = F.slice(F.array_sort(parts), 1, k)
    return F.map_from_entries(F.transform(top, lambda s: F.struct(s["b"], F.round(-s["a"], 3))))


def detect(df: DataFrame, config: AnomalyConfig = AnomalyConfig()) -> dict[str, DataFrame]:
    """Scores of all rows, the flagged rows with severity and contributions, feature ranking and summary."""
    features = list(config.features) or default_features(df)
    if not features:
        raise ValueError("no numeric feature column")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    scale = fit_scale(df, features)
    table = filled(df, scale)
    zf, zs = zscore_columns(scale, config.z_threshold)
    qf, qs = iqr_columns(scale, config.iqr_multiplier)
    if config.method == "zscore":
        scored = table.withColumn("is_anomaly", zf).withColumn("anomaly_score", zs)
    elif config.method == "iqr":
        scored = table.withColumn("is_anomaly", qf).withColumn("anomaly_score", qs)
    elif config.method == "isolation_forest":
        scored = isolation_scores(table, features, config.contamination)
        scored = scored.withColumnRenamed("iso_flag", "is_anomaly").withColumnRenamed("iso_score", "anomaly_score")
    else:
        scored = combine(isolation_scores(table, features, config.contamination), [("iso_flag", "iso_score")], [(zf, zs), (qf, qs)], config.contamination)
    return {"scores": scored.drop(*[_x(c) for c in features]), **reports(scored, scale, config)}


def combine(table: DataFrame, named: list[tuple[str, str]], methods: list[tuple[Column, Column]], contamination: float) -> DataFrame:
    """Mean score; flagged by two votes or a mean score in the top ``contamination`` share."""
    flags = [F.col(f) for f, _ in named] + [f for f, _ in methods]
    scores = [F.col(s) for _, s in named] + [s for _, s in methods]
    mean = reduce(lambda a, b: a + b, scores) / len(scores)
    votes = reduce(lambda a, b: a + b, [f.cast("int") for f in flags])
    joined = table.withColumn("anomaly_score", mean).withColumn("votes", votes)
    limit = quantiles(joined, {"s": F.col("anomaly_score")}, [1.0 - contamination])["s"][0]
    return joined.withColumn("is_anomaly", (F.col("votes") >= 2) | (F.col("anomaly_score") >= F.lit(limit))).drop("votes", *[c for pair in named for c in pair])


def reports(scored: DataFrame, scale: AnomalyScale, config: AnomalyConfig) -> dict[str, DataFrame]:
    shown = F.create_map(*[v for c in scale.features for v in (F.lit(c), as_number(scored, c))])
    score = _clip01(F.col("anomaly_score"))
    helper = [_x(c) for c in scale.features]
    flagged = scored.where("is_anomaly").select(
        *[ref(c) for c in scored.columns if c not in helper and c not in ("is_anomaly", "anomaly_score")],
        F.round(score, 4).alias("anomaly_score"), severity_of(score).alias("severity"),
        contributions(scale).alias("contributing_features"), shown.alias("feature_values"),
    )
    rank = F.when(F.col("severity") == "Critical", 4).when(F.col("severity") == "High", 3).when(F.col("severity") == "Medium", 2).otherwise(1)
    summary = scored.select(F.col("is_anomaly"), severity_of(score).alias("severity")).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if("is_anomaly").alias("affected_rows"), F.max(F.when(F.col("is_anomaly"), rank)).alias("_r"),
    ).select(
        F.lit(config.method).alias("method"), "total_rows", "affected_rows", F.round(F.col("affected_rows") * 100.0 / F.col("total_rows"), 2).alias("anomaly_pct"),
        F.when(F.col("_r") == 4, "Critical").when(F.col("_r") == 3, "High").when(F.col("_r") == 2, "Medium").otherwise("Low").alias("max_severity"),
    )
    return {"flagged": flagged, "ranking": feature_ranking(flagged, scale.features), "summary": summary}


def feature_ranking(flagged: DataFrame, features: list[str]) -> DataFrame:
    """Sum of each feature's z where it is among a row's top three, over the number of flagged rows."""
    sums = flagged.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("contributing_features")[c]).alias(f"s{i}") for i, c in enumerate(features)])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.round(F.round(F.coalesce(F.col(f"s{i}"), F.lit(0.0)), 3) / F.greatest(F.col("n"), F.lit(1)), 4).alias("importance")) for i, c in enumerate(features)
    ]))).orderBy(F.desc("importance"), "feature")


def projection(scored: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Two coordinates per row: the two features themselves, or the first two principal components."""
    if len(features) == 1:
        return scored.select(*keep, F.lit(0.0).alias("x"), as_number(scored, features[0]).alias("y"))
    scale_means = scored.agg(*[F.avg(as_number(scored, c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    if len(features) == 2:
        return scored.select(*keep, as_number(scored, features[0]).alias("x"), as_number(scored, features[1]).alias("y"))
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    centred = scored.select("*", *[F.coalesce(as_number(scored, c) - F.lit(scale_means[i] or 0.0), F.lit(0.0)).alias(f"_p{i}") for i, c in enumerate(features)])
    vectors = VectorAssembler(inputCols=[f"_p{i}" for i in range(len(features))], outputCol="_v").transform(centred)
    model = PCA(k=2, inputCol="_v", outputCol="_c").fit(vectors)
    axes = np.array(model.pc.toArray())
    signs = [1.0 if axes[np.argmax(np.abs(axes[:, j])), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(vectors).withColumn("_a", vector_to_array("_c"))
    return out.select(*keep, (F.col("_a")[0] * signs[0]).alias("x"), (F.col("_a")[1] * signs[1]).alias("y"))
