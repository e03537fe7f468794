"""Exploratory analysis: statistics, correlations, outliers, trends, target relations, chart data, insights."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import (
    CATEGORICAL, DATETIME, NUMERICAL, as_moment, as_number, column_kinds, is_number, literal_rows, ref, rows_table,
)
from ..functions.counts import count_summary, value_counts
from ..functions.durable import durable
from ..functions.joins import join_few
from ..functions.moments import pair_correlations, pearson, round4, sample_kurtosis, sample_skewness
from ..functions.quantiles import quantiles, quantiles_by_class
from ..functions.ranking import average_ranks
from .profile import cell_summary, duplicate_summary, missing_by_column

IQR_FACTOR, SIGMA = 1.5, 3.0
TOP_PAIRS, TOP_CATEGORIES = 15, 10


def _of_kind(df: DataFrame, kind: str, given: list[str] | None) -> list[str]:
    return given if given is not None else [c for c, k in column_kinds(df).items() if k == kind]


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Moments, quartiles, missing and zero counts per numeric column."""
    columns = _of_kind(df, NUMERICAL, columns)
    views = {c: as_number(df, c) for c in columns}
    quarts = quantiles(df, views, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(columns):
        x = views[c]
        aggs.append(F.struct(
            F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"), sample_skewness(x).alias("skew"), sample_kurtosis(x).alias("kurt"),
            (F.count(F.lit(1)) - F.count(x)).alias("missing"), F.count_if(x == 0).alias("zeros"),
        ).alias(f"s{i}"))
    wide = df.agg(*aggs)
    return rows_table(wide, [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"s{i}.n").alias("n"), round4(F.col(f"s{i}.mean")).alias("mean"),
            round4(F.col(f"s{i}.std")).alias("std"), round4(F.col(f"s{i}.min")).alias("min"),
            *[round4(F.lit(q).cast("double")).alias(a) for a, q in zip(("q25", "median", "q75"), quarts[c])],
            round4(F.col(f"s{i}.max")).alias("max"), round4(F.col(f"s{i}.skew")).alias("skewness"),
            round4(F.col(f"s{i}.kurt")).alias("kurtosis"), F.col(f"s{i}.missing").alias("missing_count"),
            F.col(f"s{i}.zeros").alias("zero_count"),
        ) for i, c in enumerate(columns)
    ]).where("n > 0")


def categorical_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, distinct values and the most frequent value of each categorical column."""
    columns = _of_kind(df, CATEGORICAL, columns)
    missing = missing_by_column(df.select(*[ref(c) for c in columns])).select("column_name", "row_count", "missing_count")
    found = count_summary(value_counts(df, columns))
    zero = F.lit(0).cast("long")
    return missing.join(found, "column_name", "left").select(
        "column_name", F.coalesce("filled", zero).alias("n"), F.coalesce("distinct_count", zero).alias("distinct_count"),
        "top_value", F.coalesce("top_freq", zero).alias("top_freq"),
        F.coalesce(round4(F.try_divide(F.col("top_freq"), F.col("filled"))), F.lit(0.0)).alias("top_ratio"), "missing_count",
    )


def category_frequencies(df: DataFrame, columns: list[str] | None = None, k: int = TOP_CATEGORIES) -> DataFrame:
    """The ``k`` most frequent values of each categorical column (ties: smallest value first)."""
    columns = _of_kind(df, CATEGORICAL, columns)
    w = W.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return value_counts(df, columns).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _complete_rows(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """Rows without gaps in the columns; with fewer than three of them, all rows with gaps read as 0."""
    view = df.select(*[as_number(df, c).alias(c) for c in columns])
    full = view.na.drop("any")
    n = full.count()
    if n >= 3:
        return full, n
    return view.na.fill(0.0), view.count()


def _matrix(df: DataFrame, columns: list[str], spark, name: str) -> DataFrame:
    found = pair_correlations(df, columns)
    spreads = df.agg(*[F.stddev_pop(ref(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    varies = {c: bool(spreads[i]) for i, c in enumerate(columns)}
    rows = []
    for a in columns:
        for b in columns:
            r = (1.0 if varies[a] else None) if a == b else found.get((a, b), found.get((b, a)))
            rows.append((a, b, r))
    return literal_rows(spark, rows, f"feature1 string, feature2 string, {name} double").withColumn(name, round4(F.col(name)))


def pearson_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered pair over rows complete in all columns."""
    columns = _of_kind(df, NUMERICAL, columns)
    full, _ = _complete_rows(df, columns)
    return _matrix(full, columns, df.sparkSession, "pearson")


def spearman_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rank correlation of every ordered pair over rows complete in all columns."""
    columns = _of_kind(df, NUMERICAL, columns)
    full, n = _complete_rows(df, columns)
    ranks = average_ranks(full, columns, n).persist(StorageLevel.MEMORY_AND_DISK)
    out = _matrix(ranks, columns, df.sparkSession, "spearman")
    ranks.unpersist()
    return out


def top_correlation_pairs(pearson_table: DataFrame, spearman_table: DataFrame, k: int = TOP_PAIRS) -> DataFrame:
    """The strongest pairs by absolute Pearson value."""
    both = pearson_table.where(F.col("feature1") < F.col("feature2")).join(spearman_table, ["feature1", "feature2"])
    return (
        both.where(F.col("pearson").isNotNull())
        .select("feature1", "feature2", "pearson", "spearman", round4(F.abs("pearson")).alias("abs_pearson"))
        .orderBy(F.desc("abs_pearson"), "feature1", "feature2").limit(k)
    )


def outlier_analysis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """IQR and three-sigma bounds with the number of values outside, for columns with at least four values."""
    columns = _of_kind(df, NUMERICAL, columns)
    views = {c: as_number(df, c) for c in columns}
    quarts = quantiles(df, views, [0.25, 0.75])
    row = df.agg(*[F.struct(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).alias(f"s{i}") for i, x in enumerate(views.values())]).first()
    kept, aggs = [], []
    for i, (c, x) in enumerate(views.items()):
        n, mean, std = row[i]["n"], row[i]["m"], row[i]["s"] or 0.0
        if n < 4:
            continue
        q1, q3 = quarts[c]
        lo, hi = q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)
        zlo, zhi = mean - SIGMA * std, mean + SIGMA * std
        z = F.count_if(F.abs((x - F.lit(mean)) / F.lit(std)) > SIGMA) if std > 0 else F.count_if(F.lit(False))
        aggs.append(F.struct(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias("a"), z.alias("b")).alias(f"o{i}"))
        kept.append((i, c, lo, hi, zlo, zhi))
    wide = df.agg(*aggs)
    return rows_table(wide, [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"o{i}.a").alias("iqr_outliers"), F.col(f"o{i}.b").alias("zscore_outliers"),
            *[round4(F.lit(float(v))).alias(a) for a, v in
              (("iqr_lower_bound", lo), ("iqr_upper_bound", hi), ("zscore_lower_bound", zlo), ("zscore_upper_bound", zhi))],
        ) for i, c, lo, hi, zlo, zhi in kept
    ])


def daily_means(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    """Mean per day (per month end when fewer than three days have data); periods with a gap are left out."""
    view = df.select(as_moment(df, date).alias("ts"), *[as_number(df, c).alias(c) for c in columns]).where("ts is not null")
    def by(bucket):
        return view.groupBy(bucket.alias("bucket")).agg(*[F.avg(ref(c)).alias(c) for c in columns]).na.drop("any", subset=columns)
    days = by(F.col("ts").cast("date"))
    return days if len(days.take(3)) == 3 else by(F.last_day(F.col("ts").cast("date")))


def time_trends(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    """Least-squares trend of each column over its day buckets (one row per calendar day reaches the window)."""
    means = daily_means(df, date, columns)
    indexed = means.withColumn("x", (F.row_number().over(W.orderBy("bucket")) - 1).cast("double"))
    wide = indexed.agg(
        F.count(F.lit(1)).alias("points"), F.min("bucket").alias("min_date"), F.max("bucket").alias("max_date"),
        *[F.struct(F.regr_slope(ref(c), F.col("x")).alias("slope"), F.regr_r2(ref(c), F.col("x")).alias("r2")).alias(f"t{i}") for i, c in enumerate(columns)],
    ).where("points > 2")
    return rows_table(wide, [
        F.struct(
            F.lit(c).alias("column_name"), F.col("points"),
            F.when(F.col(f"t{i}.slope") > 0.01, "UPWARD").when(F.col(f"t{i}.slope") < -0.01, "DOWNWARD").otherwise("STABLE").alias("direction"),
            round4(F.col(f"t{i}.slope")).alias("slope"), round4(F.coalesce(F.col(f"t{i}.r2"), F.lit(0.0))).alias("r_squared"),
            F.col("min_date"), F.col("max_date"),
        ) for i, c in enumerate(columns)
    ])


def target_kind(df: DataFrame, target: str) -> str:
    """"numerical" for numbers with more than ten distinct values, else "categorical"."""
    if not is_number(df.schema[target].dataType):
        return CATEGORICAL
    few = df.select(ref(target).alias("t")).where("t is not null").distinct().limit(11).count()
    return NUMERICAL if few > 10 else CATEGORICAL


def target_class_distribution(df: DataFrame, target: str) -> DataFrame:
    return df.where(ref(target).isNotNull()).groupBy(ref(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def target_correlations(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """Pearson of each numeric column with the target over the rows where both are present."""
    columns = [c for c in _of_kind(df, NUMERICAL, columns) if c != target]
    y = as_number(df, target)
    wide = df.agg(*[pearson(as_number(df, c), y).alias(f"r{i}") for i, c in enumerate(columns)])
    return rows_table(wide, [
        F.struct(F.lit(c).alias("column_name"), round4(F.col(f"r{i}")).alias("correlation")) for i, c in enumerate(columns)
    ]).where("correlation is not null")


def histogram_bins(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram; the last bin includes the maximum."""
    x = as_number(df, column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return literal_rows(df.sparkSession, [], "bin int, lower double, upper double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    at = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", round4(F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        round4(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), "n",
    )


def box_by_class(df: DataFrame, label: str, value: str) -> DataFrame:
    """Quartiles and whiskers (furthest values within 1.5 IQR) of a column for each class."""
    tag, x = ref(label).cast("string"), as_number(df, value)
    q = F.col("q")
    bounds = quantiles_by_class(df, tag, x, [0.25, 0.5, 0.75]).select(
        "class", q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"),
        (q[0] - IQR_FACTOR * (q[2] - q[0])).alias("lo"), (q[2] + IQR_FACTOR * (q[2] - q[0])).alias("hi"),
    )
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    return (
        join_few(df.select(tag.alias("class"), x.alias("x")), durable(bounds), "class")
        .groupBy("class", "q25", "median", "q75")
        .agg(F.count("x").alias("n"), F.min(F.when(inside, F.col("x"))).alias("lower"), F.max(F.when(inside, F.col("x"))).alias("upper"))
        .select("class", "n", round4(F.col("lower")).alias("lower_whisker"), round4(F.col("q25")).alias("q25"), round4(F.col("median")).alias("median"),
                round4(F.col("q75")).alias("q75"), round4(F.col("upper")).alias("upper_whisker"))
    )


def target_ols_line(df: DataFrame, feature: str, target: str) -> DataFrame:
    y, x = as_number(df, target), as_number(df, feature)
    return df.agg(
        round4(F.regr_slope(y, x)).alias("slope"), round4(F.regr_intercept(y, x)).alias("intercept"),
        round4(F.regr_r2(y, x)).alias("r_squared"), F.regr_count(y, x).alias("n"),
    )


def describe_all(df: DataFrame) -> DataFrame:
    """One row per column: count, distinct / top / frequency for categories, moments and quartiles for numbers."""
    kinds = column_kinds(df, look_into_text=False)
    text = [c for c, k in kinds.items() if k == CATEGORICAL]
    number = [c for c, k in kinds.items() if k == NUMERICAL]
    moment = [c for c, k in kinds.items() if k == DATETIME]
    nil_s, nil_d, nil_n = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("long")
    parts = []
    if number:
        parts.append(numeric_stats(df, number).select(
            "column_name", "n", nil_n.alias("distinct_count"), nil_s.alias("top_value"), nil_n.alias("top_freq"),
            "mean", "std", "min", "q25", "median", "q75", "max", nil_s.alias("first_date"), nil_s.alias("last_date")))
    blank = [nil_d.alias(a) for a in ("mean", "std", "min", "q25", "median", "q75", "max")]
    if text:
        parts.append(categorical_stats(df, text).select(
            "column_name", "n", "distinct_count", "top_value", "top_freq", *blank, nil_s.alias("first_date"), nil_s.alias("last_date")))
    if moment:
        wide = df.agg(*[F.struct(F.count(ref(c)).alias("n"), F.min(ref(c)).cast("string").alias("a"), F.max(ref(c)).cast("string").alias("b")).alias(f"m{i}") for i, c in enumerate(moment)])
        parts.append(rows_table(wide, [F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}.n").alias("n"), F.col(f"m{i}.a").alias("first_date"), F.col(f"m{i}.b").alias("last_date")) for i, c in enumerate(moment)])
                     .select("column_name", "n", nil_n.alias("distinct_count"), nil_s.alias("top_value"), nil_n.alias("top_freq"), *blank, "first_date", "last_date"))
    return reduce(DataFrame.unionByName, parts)


def sampled(df: DataFrame, rows: int, key: list[str] | None = None) -> DataFrame:
    """About ``rows`` rows chosen by a hash of the key (default: all columns), the same on every run."""
    total = df.count()
    if total <= rows:
        return df
    cut = int(rows / total * 2**31)
    return df.where(F.pmod(F.xxhash64(*[ref(c) for c in (key or df.columns)]), F.lit(2**31)) < cut)


# --- insight rules --------------------------------------------------------------------------------------

def _insight(table: DataFrame, category: str, severity, title, text, columns, metrics: dict) -> DataFrame:
    pairs = [x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))]
    return table.select(
        F.lit(category).alias("category"), severity.alias("severity"), title.alias("title"), text.alias("description"),
        columns.alias("affected_columns"), F.create_map(*pairs).alias("metrics"),
    )


def eda_insights(
    row_count: int, numeric: DataFrame, categorical: DataFrame, pairs: DataFrame, outliers: DataFrame,
    trends: DataFrame | None = None, target: str | None = None, target_corr: DataFrame | None = None,
) -> DataFrame:
    """Rules over the finished tables; each row is one finding."""
    col = F.col
    lacking = col("missing_count") * 100.0 / F.lit(max(1, row_count))
    outside = col("iqr_outliers") * 100.0 / F.lit(max(1, row_count))
    name = F.array("column_name")
    parts = [
        _insight(numeric.where(lacking >= 20), "MISSINGNESS", F.when(lacking >= 50, "HIGH").otherwise("MEDIUM"),
                 F.concat(F.lit("Gaps in "), col("column_name")), F.format_string("%.1f%% of %s is missing", lacking, col("column_name")),
                 name, {"missing_percentage": F.round(lacking, 2), "missing_count": col("missing_count")}),
        _insight(pairs.where("abs_pearson >= 0.75"), "CORRELATION", F.when(col("abs_pearson") >= 0.90, "HIGH").otherwise("MEDIUM"),
                 F.concat_ws(" ", col("feature1"), F.lit("moves with"), col("feature2")), F.format_string("r = %.3f", col("pearson")),
                 F.array("feature1", "feature2"), {"pearson": col("pearson"), "spearman": col("spearman")}),
        _insight(categorical.where("top_ratio >= 0.70 and distinct_count > 1"), "CATEGORICAL", F.when(col("top_ratio") >= 0.85, "MEDIUM").otherwise("INFO"),
                 F.concat(F.lit("One value dominates "), col("column_name")), F.format_string("%s fills %.1f%%", col("top_value"), col("top_ratio") * 100),
                 name, {"top_ratio": col("top_ratio")}),
        _insight(numeric.where("abs(skewness) >= 1.5"), "DISTRIBUTION", F.lit("MEDIUM"),
                 F.concat(F.lit("Skewed values in "), col("column_name")),
                 F.format_string("%s tail, skewness %.2f", F.when(col("skewness") > 0, "right").otherwise("left"), col("skewness")),
                 name, {"skewness": col("skewness"), "kurtosis": col("kurtosis")}),
        _insight(outliers.where(outside >= 5), "OUTLIER", F.when(outside >= 15, "HIGH").otherwise("MEDIUM"),
                 F.concat(F.lit("Many extreme values in "), col("column_name")), F.format_string("%d values (%.1f%% of rows) lie outside the IQR bounds", col("iqr_outliers"), outside),
                 name, {"outlier_count": col("iqr_outliers"), "outlier_percentage": F.round(outside, 2)}),
    ]
    if trends is not None:
        parts.append(_insight(
            trends.where("direction <> 'STABLE' and r_squared >= 0.40"), "TEMPORAL", F.when(col("r_squared") >= 0.70, "HIGH").otherwise("MEDIUM"),
            F.concat_ws(" ", F.lower("direction"), F.lit("trend in"), col("column_name")), F.format_string("slope %.4f per step, R2 %.2f", col("slope"), col("r_squared")),
            name, {"slope": col("slope"), "r_squared": col("r_squared")}))
    if target_corr is not None:
        best = target_corr.orderBy(F.desc(F.abs("correlation")), "column_name").limit(3)
        parts.append(_insight(
            best.where(F.abs("correlation") >= 0.40), "TARGET", F.lit("HIGH"),
            F.concat(col("column_name"), F.lit(f" goes with {target}")), F.format_string("r = %.3f", col("correlation")),
            F.array(col("column_name"), F.lit(target)), {"target_correlation": col("correlation")}))
    return reduce(DataFrame.unionByName, parts)


def explore(df: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """Every exploratory table that the columns allow."""
    if df.isEmpty():
        return {"summary": cell_summary(df), "duplicates": duplicate_summary(df)}
    kinds = column_kinds(df)
    numbers = [c for c, k in kinds.items() if k == NUMERICAL]
    dates = [c for c, k in kinds.items() if k == DATETIME]
    cats = [c for c, k in kinds.items() if k == CATEGORICAL]
    summary = cell_summary(df)
    out = {"summary": summary, "duplicates": duplicate_summary(df), "missing": missing_by_column(df, True)}
    nil = {
        "numeric": "column_name string, n long, mean double, std double, min double, q25 double, median double, q75 double, max double, skewness double, kurtosis double, missing_count long, zero_count long",
        "categorical": "column_name string, n long, distinct_count long, top_value string, top_freq long, top_ratio double, missing_count long",
        "pairs": "feature1 string, feature2 string, pearson double, spearman double, abs_pearson double",
        "outliers": "column_name string, iqr_outliers long, zscore_outliers long, iqr_lower_bound double, iqr_upper_bound double, zscore_lower_bound double, zscore_upper_bound double",
    }
    spark = df.sparkSession
    out["numeric"] = numeric_stats(df, numbers) if numbers else literal_rows(spark, [], nil["numeric"])
    out["categorical"] = categorical_stats(df, cats) if cats else literal_rows(spark, [], nil["categorical"])
    out["outliers"] = outlier_analysis(df, numbers) if numbers else literal_rows(spark, [], nil["outliers"])
    if cats:
        out["categories"] = category_frequencies(df, cats)
    if len(numbers) > 1:
        out["pearson"], out["spearman"] = pearson_matrix(df, numbers), spearman_matrix(df, numbers)
        out["pairs"] = top_correlation_pairs(out["pearson"], out["spearman"])
    else:
        out["pairs"] = literal_rows(spark, [], nil["pairs"])
    if numbers:
        out["histogram"] = histogram_bins(df, numbers[0])
    trends = corr = None
    if dates and numbers:
        out["daily"] = daily_means(df, dates[0], numbers)
        trends = out["trends"] = time_trends(df, dates[0], numbers)
    if target in df.columns:
        features = [c for c in numbers if c != target]
        if target_kind(df, target) == NUMERICAL:
            if features:
                corr = out["target_correlations"] = target_correlations(df, target, features)
        else:
            out["target_classes"] = target_class_distribution(df, target)
        if features:
            numeric_target = is_number(df.schema[target].dataType)
            out["target_relation"] = target_ols_line(df, features[0], target) if numeric_target else box_by_class(df, target, features[0])
    rows = summary.first()["row_count"]
    out["insights"] = eda_insights(rows, out["numeric"], out["categorical"], out["pairs"], out["outliers"], trends, target, corr)
    return out
