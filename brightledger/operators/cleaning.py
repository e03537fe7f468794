"""Cleaning and feature preparation: ``fit`` learns from one table, the model transforms any other.

The stages run in a fixed order: duplicates, column roles, numbers and dates from text, constant columns,
correlated columns, outliers, then gaps / scaling / encoding. Each stage is fitted by one bounded aggregate
over the prepared columns; only literals come back to the driver, and ``transform`` is a narrow projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import isfinite

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    CATEGORICAL, DATETIME, IDENTIFIER, NUMERICAL, as_moment, as_number, column_kinds, has_id_name, is_text, literal_rows, plain, ref,
)
from ..functions.counts import count_summary, value_counts
from ..functions.durable import durable
from ..functions.joins import lookup_join
from ..functions.moments import pair_correlations
from ..functions.quantiles import medians, quantiles
from ..functions.ranking import positions
from .profile import cell_summary, duplicate_summary

NUMERIC_TEXT_SHARE = 0.9
NEAR_CONSTANT_MIN_ROWS = 10
TRACKED_ITEMS = 1000


@dataclass(frozen=True)
class CleaningConfig:
    target: str | None = None
    id_columns: tuple[str, ...] = ()
    remove_duplicates: bool = True
    coerce_types: bool = True
    convert_dates: bool = True
    extract_dates: bool = True
    drop_constant: bool = True
    drop_near_constant: bool = True
    near_constant_threshold: float = 0.98
    drop_correlated: bool = True
    correlation_threshold: float = 0.95
    outlier_method: str = "iqr"        # iqr, zscore, none
    outlier_threshold: float = 1.5
    outlier_action: str = "clip"       # clip, impute, drop_rows, none
    numeric_fill: str = "median"       # median, mean, most_frequent, constant, drop
    numeric_fill_value: float | None = None
    scaling: str = "standard"          # standard, minmax, robust, none
    category_fill: str = "most_frequent"  # most_frequent, constant, drop
    category_fill_value: str = "Unknown"
    encoding: str = "onehot"           # onehot, ordinal, none
    onehot_form: str = "columns"       # columns (one per category), vector (one per column; for very many categories)
    max_columns: int = 10_000          # columns form: more categories in all raise, before any of them is read
    max_categories: int = 256          # ordinal codes of more categories are looked up in a table; the codes are the same


@dataclass
class CleaningModel:
    config: CleaningConfig
    roles: dict[str, str] = field(default_factory=dict)
    number_text: list[str] = field(default_factory=list)
    date_columns: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    outlier_fill: dict[str, float] = field(default_factory=dict)
    fills: dict[str, object] = field(default_factory=dict)
    shift: dict[str, float] = field(default_factory=dict)
    divide: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    dictionaries: dict[str, tuple[DataFrame, int, list]] = field(default_factory=dict)
    removed: dict[str, str] = field(default_factory=dict)
    log: list[tuple[str, str, list[str], dict[str, str]]] = field(default_factory=list)
    duplicates_removed: int = 0
    missing_fixed: int = 0
    outliers_found: int = 0
    rows_in: int = 0
    columns_in: int = 0
    rows_out: int = 0
    feature_names: list[str] = field(default_factory=list)

    def prepared(self, df: DataFrame) -> DataFrame:
        """Typed columns: numbers read from text, dates parsed and taken apart."""
        out = []
        for c in df.columns:
            if c in self.number_text:
                out.append(as_number(df, c).alias(c))
            elif c in self.date_columns:
                out.extend(date_parts(df, c) if self.config.extract_dates else [as_moment(df, c).alias(c)])
            elif self.roles.get(c) == NUMERICAL:
                out.append(as_number(df, c).alias(c))
            elif self.roles.get(c) == CATEGORICAL:
                nested = isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
                out.append((F.to_json(ref(c)) if nested else ref(c).cast("string")).alias(c))
            else:
                out.append(ref(c))
        return df.select(*out)

    def bounded(self, c: str) -> Column:
        """The column with its fitted outlier action."""
        x = ref(c)
        if c not in self.bounds or self.config.outlier_action not in ("clip", "impute"):
            return x
        lo, hi = map(F.lit, self.bounds[c])
        if self.config.outlier_action == "clip":
            return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)
        return F.when((x < lo) | (x > hi), F.lit(self.outlier_fill[c])).otherwise(x)

    def is_outlier(self, c: str) -> Column:
        lo, hi = map(F.lit, self.bounds[c])
        return F.coalesce((ref(c) < lo) | (ref(c) > hi), F.lit(False))

    def filled(self, c: str, clip: bool) -> Column:
        x = self.bounded(c) if clip and c in self.numbers else ref(c)
        return F.coalesce(x, F.lit(self.fills[c])) if self.fills.get(c) is not None else x

    def transform(self, df: DataFrame, clip: bool = False) -> DataFrame:
        """Applies the fitted state. Rows stay as they are unless a fill strategy is ``drop``."""
        cfg = self.config
        work = self.prepared(df)
        if cfg.numeric_fill == "drop" and self.numbers:
            work = work.na.drop("any", subset=self.numbers)
        if cfg.category_fill == "drop" and self.categories:
            work = work.na.drop("any", subset=self.categories)
        for c, (dictionary, _, hot) in self.dictionaries.items():
            key = f"_key_{c}"
            work = lookup_join(work.withColumn(key, self.filled(c, clip)), dictionary.withColumnRenamed("value", key).withColumnRenamed("code", f"_code_{c}"), key, hot)
        out = [((self.filled(c, clip) - F.lit(self.shift.get(c, 0.0))) / F.lit(self.divide.get(c, 1.0))).alias(c) for c in self.numbers]
        for c in self.categories:
            out.extend(self._encoded(c, clip))
        out.extend(ref(c) for c in self.kept if c in work.columns)
        done = work.select(*out)
        for c in self.dictionaries if cfg.encoding == "onehot" else ():
            from pyspark.ml.feature import OneHotEncoder
            # "keep" adds a slot for values that were not fitted, and dropLast leaves it out: they are all zeros.
            size = self.dictionaries[c][1]
            template = literal_rows(df.sparkSession, [(float(size - 1),)], f"`{c}_code` double")
            encoder = OneHotEncoder(inputCol=f"{c}_code", outputCol=f"{c}_onehot", dropLast=True, handleInvalid="keep").fit(template)
            done = encoder.transform(done).drop(f"{c}_code")
        return done

    def _encoded(self, c: str, clip: bool) -> list[Column]:
        value, how = self.filled(c, clip), self.config.encoding
        if how == "none":
            return [value.alias(c)]
        if c in self.dictionaries:
            if how == "ordinal":
                return [F.coalesce(F.col(f"`_code_{c}`"), F.lit(-1.0)).alias(c)]
            return [F.coalesce(F.col(f"`_code_{c}`"), F.lit(float(self.dictionaries[c][1]))).alias(f"{c}_code")]
        if how == "ordinal":
            if not self.levels[c]:
                return [F.lit(-1.0).alias(c)]
            at = F.create_map(*[x for i, v in enumerate(self.levels[c]) for x in (F.lit(v), F.lit(float(i)))])
            return [F.coalesce(F.try_element_at(at, value), F.lit(-1.0)).alias(c)]
        return [F.coalesce((value == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for v in self.levels[c]]

    def report(self, spark) -> dict[str, DataFrame]:
        """The transformation log, the removed columns and a one-row summary."""
        return {
            "log": literal_rows(spark, [(i, s, a, c, d) for i, (s, a, c, d) in enumerate(self.log)],
                                "position int, step string, action string, columns array<string>, details map<string,string>"),
            "removed": literal_rows(spark, list(self.removed.items()), "column_name string, reason string"),
            "roles": literal_rows(spark, list(self.roles.items()), "column_name string, role string"),
            "summary": literal_rows(spark, [(self.rows_in, self.columns_in, self.rows_out, len(self.feature_names), self.duplicates_removed, self.missing_fixed, self.outliers_found)],
                                    "rows_in long, columns_in int, rows_out long, columns_out int, duplicates_removed long, missing_fixed long, outliers_found long"),
        }


# --- single steps ---------------------------------------------------------------------------------------

DATE_PARTS = ("year", "month", "day", "dayofweek", "is_weekend")


def date_parts(df: DataFrame, c: str) -> list[Column]:
    """Year, month, day, weekday (Monday 0) and weekend flag; a date that is missing is no weekend."""
    t = as_moment(df, c)
    parts = (F.year(t), F.month(t), F.dayofmonth(t), F.weekday(t), F.coalesce((F.weekday(t) >= 5).cast("int"), F.lit(0)))
    return [p.cast("double").alias(f"{c}_{n}") for n, p in zip(DATE_PARTS, parts)]


def dedupe(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def numeric_text_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Text columns of which more than 90 % of the values read as numbers."""
    text = [c for c in columns if is_text(df.schema[c].dataType)]
    if not text:
        return []
    row = df.agg(*[F.struct(F.count(ref(c)).alias("n"), F.count(ref(c).try_cast("double")).alias("k")).alias(f"t{i}") for i, c in enumerate(text)]).first()
    return [c for i, c in enumerate(text) if row[i]["n"] and row[i]["k"] / row[i]["n"] > NUMERIC_TEXT_SHARE]


def dominant_values(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int, bool]]:
    """Per column: non-null rows, rows of its most frequent value, and whether it holds a single value.

    A frequent-items sketch of fixed size names the candidate and a second scan counts it exactly. A value
    above 1 / 1000 of the rows cannot be missed, so shares near 1 are exact; nothing is shuffled.
    """
    if not columns:
        return {}
    row = df.agg(*[F.struct(
        F.count(ref(c)).alias("n"), (F.min(ref(c)) == F.max(ref(c))).alias("one"), F.expr(f"approx_top_k(`{c}`, 1, {TRACKED_ITEMS})").alias("top"),
    ).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    candidate = {c: next((t["item"] for t in row[i]["top"] if t["item"] is not None), None) for i, c in enumerate(columns)}
    hits = df.agg(*[F.count_if(ref(c) == F.lit(candidate[c])).alias(f"h{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[i]["n"], hits[i] if candidate[c] is not None else 0, bool(row[i]["one"])) for i, c in enumerate(columns)}


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns with exactly one distinct non-null value."""
    found = dominant_values(df, columns or df.columns)
    return literal_rows(df.sparkSession, [(c,) for c, (n, _, one) in found.items() if n and one], "column_name string")


def near_constant_columns(df: DataFrame, threshold: float = 0.98, columns: list[str] | None = None) -> DataFrame:
    """Columns whose top value fills at least ``threshold`` of the non-null rows (tables of more than 10 rows)."""
    found = dominant_values(df, columns or df.columns)
    rows = [(c, round(h / n, 4)) for c, (n, h, one) in found.items() if n and not one and h / n >= threshold]
    return literal_rows(df.sparkSession, rows if df.limit(NEAR_CONSTANT_MIN_ROWS + 1).count() > NEAR_CONSTANT_MIN_ROWS else [], "column_name string, top_share double")


def correlated_columns(df: DataFrame, columns: list[str], threshold: float = 0.95) -> list[tuple[str, str, float]]:
    """(column, first earlier column it repeats, |r|) by pairwise-complete Pearson values."""
    r = {p: None if v is None else abs(v) for p, v in pair_correlations(df, columns).items()}
    out = []
    for j, b in enumerate(columns):
        hit = next((a for a in columns[:j] if r[(a, b)] is not None and r[(a, b)] > threshold), None)
        if hit is not None:
            out.append((b, hit, r[(hit, b)]))
    return out


def _fences(quartiles: dict[str, list[float | None]], k: float) -> dict[str, tuple[float, float]]:
    """Bounds k quartile ranges outside the first and the last of a column's quartiles."""
    q = {c: (v[0], v[-1]) for c, v in quartiles.items() if v[0] is not None}
    return {c: (a - k * (b - a), b + k * (b - a)) for c, (a, b) in q.items() if b != a}


def outlier_bounds(df: DataFrame, columns: list[str], method: str = "iqr", k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Lower and upper bound per column; columns without spread are left out."""
    if not columns:
        return {}
    views = {c: as_number(df, c) for c in columns}
    if method == "iqr":
        return _fences(quantiles(df, views, [0.25, 0.75]), k)
    row = df.agg(*[F.struct(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).alias(f"s{i}") for i, x in enumerate(views.values())]).first()
    return {c: (row[i]["m"] - k * row[i]["s"], row[i]["m"] + k * row[i]["s"]) for i, c in enumerate(columns) if row[i]["s"]}


def bounds_table(df: DataFrame, columns: list[str], method: str = "iqr", k: float = 1.5) -> DataFrame:
    found = outlier_bounds(df, columns, method, k)
    rows = [(c, lo, hi) for c, (lo, hi) in found.items()]
    return literal_rows(df.sparkSession, rows, "column_name string, lower_bound double, upper_bound double").select(
        "column_name", F.round("lower_bound", 4).alias("lower_bound"), F.round("upper_bound", 4).alias("upper_bound"))


# --- fit ------------------------------------------------------------------------------------------------

def _classify(df: DataFrame, cfg: CleaningConfig) -> dict[str, str]:
    kinds = column_kinds(df, look_into_text=cfg.convert_dates)
    named = [c for c in df.columns if has_id_name(c)]
    ids = set(cfg.id_columns)
    if named:
        row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(ref(c)).alias(f"f{i}") for i, c in enumerate(named)]).first()
        full = [c for i, c in enumerate(named) if row["n"] > 1 and row[f"f{i}"] == row["n"]]
        # A sketch rules out columns far from unique before anything is counted exactly.
        if full:
            rough = df.agg(*[F.approx_count_distinct(ref(c), 0.02) for c in full]).first()
            for i, c in enumerate(full):
                if rough[i] > 0.8 * row["n"] and df.select(ref(c)).distinct().count() == row["n"]:
                    ids.add(c)
    roles = {}
    for c in df.columns:
        roles[c] = "target" if c == cfg.target else IDENTIFIER if c in ids else kinds[c]
    return roles


def fit(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> tuple[CleaningModel, DataFrame]:
    """The fitted model and the cleaned training table."""
    cfg, model = config, CleaningModel(config)
    df = plain(df)
    cells = cell_summary(df).first()
    model.rows_in, model.columns_in, model.missing_fixed = cells["row_count"], len(df.columns), cells["missing_cells"]
    rows = model.rows_in
    if cfg.remove_duplicates and rows:
        model.duplicates_removed = duplicate_summary(df).first()["duplicate_rows"]
        if model.duplicates_removed:
            # Written once: every later stage reads the distinct rows instead of shuffling the table again.
            df = durable(dedupe(df))
            rows -= model.duplicates_removed
            model.log.append(("remove_duplicates", "drop_rows", list(df.columns), {"removed": str(model.duplicates_removed), "remaining": str(rows)}))

    model.roles = _classify(df, cfg)
    texts = [c for c, r in model.roles.items() if r == CATEGORICAL]
    model.number_text = numeric_text_columns(df, texts) if cfg.coerce_types else []
    for c in model.number_text:
        model.roles[c] = NUMERICAL
    model.date_columns = [c for c, r in model.roles.items() if r == DATETIME] if cfg.convert_dates else []
    numbers = [c for c, r in model.roles.items() if r == NUMERICAL and c not in model.number_text] + model.number_text
    categories = [c for c in texts if c not in model.number_text]
    parts = [f"{c}_{p}" for c in model.date_columns for p in DATE_PARTS] if cfg.extract_dates else []
    if parts:
        model.log.append(("date_parts", "extract", parts, {"count": str(len(parts))}))
        for c in model.date_columns:
            model.removed[c] = "taken apart into calendar columns"
    numbers += parts
    work = model.prepared(df)

    candidates = [c for c in work.columns if model.roles.get(c) not in (IDENTIFIER, "target")]
    dropped = []
    if (cfg.drop_constant or cfg.drop_near_constant) and rows:
        for c, (n, hits, one) in dominant_values(work, candidates).items():
            if not n:
                continue
            if cfg.drop_constant and one:
                model.removed[c] = "constant: a single distinct value"
            elif cfg.drop_near_constant and rows > NEAR_CONSTANT_MIN_ROWS and hits / n >= cfg.near_constant_threshold:
                model.removed[c] = f"near-constant: one value fills {hits / n:.2%}"
            else:
                continue
            dropped.append(c)
        if dropped:
            model.log.append(("constant_columns", "drop_column", dropped, {"count": str(len(dropped))}))
    numbers, categories = [c for c in numbers if c not in dropped], [c for c in categories if c not in dropped]

    if cfg.drop_correlated and len(numbers) > 1:
        twins = correlated_columns(work, numbers, cfg.correlation_threshold)
        for c, other, r in twins:
            model.removed[c] = f"repeats {other} (|r| = {r:.3f})"
        if twins:
            model.log.append(("correlated_columns", "drop_column", [t[0] for t in twins], {"count": str(len(twins))}))
        numbers = [c for c in numbers if c not in {t[0] for t in twins}]

    model.numbers, model.categories = numbers, categories
    middle: dict[str, float | None] = {}
    if cfg.outlier_method != "none" and cfg.outlier_action != "none" and numbers:
        # Clipping at half a quartile range or more outside the quartiles moves no median, so it comes from the same passes.
        if cfg.outlier_method == "iqr" and cfg.outlier_action == "clip" and cfg.outlier_threshold >= 0.5 and cfg.numeric_fill == "median" and cfg.category_fill != "drop":
            q = quantiles(work, {c: as_number(work, c) for c in numbers}, [0.25, 0.5, 0.75])
            model.bounds = _fences(q, cfg.outlier_threshold)
            if all(v is None or isfinite(v) for three in q.values() for v in three):
                middle = {c: v[1] for c, v in q.items()}
        else:
            model.bounds = outlier_bounds(work, numbers, cfg.outlier_method, cfg.outlier_threshold)
        if model.bounds:
            hit = work.agg(*[F.count_if(model.is_outlier(c)).alias(f"o{i}") for i, c in enumerate(model.bounds)]).first()
            touched = [c for i, c in enumerate(model.bounds) if hit[i]]
            model.outliers_found = sum(hit)
            if cfg.outlier_action == "impute":
                model.outlier_fill = medians(work, {c: ref(c) for c in model.bounds})
            if cfg.outlier_action == "drop_rows" and touched:
                inside = ~reduce(lambda a, b: a | b, [model.is_outlier(c) for c in touched])
                df = _filter_raw(df, model, inside)
                work = model.prepared(df)
            if model.outliers_found:
                model.log.append(("outliers", cfg.outlier_action, touched, {"method": cfg.outlier_method, "threshold": str(cfg.outlier_threshold), "found": str(model.outliers_found)}))

    if cfg.numeric_fill == "drop" and numbers:
        work = work.na.drop("any", subset=numbers)
    if cfg.category_fill == "drop" and categories:
        work = work.na.drop("any", subset=categories)
    _fit_numbers(work, model, middle)
    _fit_categories(work, model)
    model.kept = [c for c in work.columns if c not in numbers and c not in categories and c not in model.removed]
    if numbers or categories:
        model.log.append(("fill_scale_encode", "transform", numbers + categories, {"numeric_fill": cfg.numeric_fill, "scaling": cfg.scaling, "category_fill": cfg.category_fill, "encoding": cfg.encoding}))
    cleaned = model.transform(df, clip=True)
    model.feature_names = cleaned.columns
    narrowed = cfg.outlier_action == "drop_rows" or "drop" in (cfg.numeric_fill, cfg.category_fill)
    model.rows_out = work.count() if narrowed else rows
    return model, cleaned


def _filter_raw(df: DataFrame, model: CleaningModel, condition: Column) -> DataFrame:
    """Raw rows whose prepared columns meet a condition."""
    packed = df.select(F.struct(*[ref(c) for c in df.columns]).alias("_raw"), *[ref(c) for c in df.columns])
    prepared = model.prepared(packed)
    return prepared.where(condition).select("_raw.*")


def _fit_numbers(work: DataFrame, model: CleaningModel, middle: dict[str, float | None] | None = None) -> None:
    """``middle``: the medians, if they are known already."""
    cfg, numbers = model.config, model.numbers
    if not numbers:
        return
    seen = {c: model.bounded(c).cast("double") for c in numbers}
    if cfg.numeric_fill == "constant":
        model.fills.update({c: float(cfg.numeric_fill_value or 0.0) for c in numbers})
    elif cfg.numeric_fill == "mean":
        row = work.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(seen.values())]).first()
        model.fills.update({c: row[i] for i, c in enumerate(numbers)})
    elif cfg.numeric_fill == "most_frequent":
        for c in numbers:
            best = work.groupBy(seen[c].alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v is not null").agg(F.min_by("v", F.struct((-F.col("n")).alias("a"), F.col("v").alias("b"))))
            model.fills[c] = best.first()[0]
    elif cfg.numeric_fill == "median":
        model.fills.update(middle or medians(work, seen))
    full = {c: F.coalesce(x, F.lit(model.fills[c])) if model.fills.get(c) is not None else x for c, x in seen.items()}
    if cfg.scaling == "standard":
        row = work.agg(*[F.struct(F.avg(x).alias("a"), F.stddev_pop(x).alias("b")).alias(f"s{i}") for i, x in enumerate(full.values())]).first()
    elif cfg.scaling == "minmax":
        row = work.agg(*[F.struct(F.min(x).alias("a"), (F.max(x) - F.min(x)).alias("b")).alias(f"s{i}") for i, x in enumerate(full.values())]).first()
    elif cfg.scaling == "robust":
        q = quantiles(work, full, [0.25, 0.5, 0.75])
        for c, (a, m, b) in q.items():
            if m is not None:
                model.shift[c], model.divide[c] = m, (b - a) or 1.0
        return
    else:
        return
    for i, c in enumerate(numbers):
        if row[i]["a"] is not None:
            model.shift[c], model.divide[c] = float(row[i]["a"]), float(row[i]["b"] or 1.0)


def _fit_categories(work: DataFrame, model: CleaningModel) -> None:
    cfg, categories = model.config, model.categories
    if not categories:
        return
    # Read once per category column below, so the counted values (not the rows) are kept.
    counts = value_counts(work, categories).persist(StorageLevel.MEMORY_AND_DISK)
    summary = {r["column_name"]: r for r in count_summary(counts).collect()}
    for c in categories:
        if cfg.category_fill == "constant":
            model.fills[c] = cfg.category_fill_value
        elif cfg.category_fill == "most_frequent":
            model.fills[c] = summary[c]["top_value"] if c in summary else None
    if cfg.encoding == "none":
        counts.unpersist()
        return
    distinct = {c: summary[c]["distinct_count"] if c in summary else 0 for c in categories}
    if cfg.encoding == "onehot":
        small = categories if cfg.onehot_form == "columns" else []
        wide = sum(distinct[c] for c in small)
        if wide > cfg.max_columns:
            counts.unpersist()
            most = max(small, key=lambda c: distinct[c])
            raise ValueError(f"{wide} categories ({distinct[most]} of them in {most}) are too many columns; use onehot_form='vector' or raise max_columns")
    else:
        small = [c for c in categories if distinct[c] <= cfg.max_categories]
    for c in small:
        model.levels[c] = []
    for r in counts.where(F.col("column_name").isin(small)).select("column_name", "value").collect() if small else []:
        model.levels[r[0]].append(r[1])
    gaps = {}
    if cfg.category_fill == "constant" and small:
        row = work.agg(*[F.count_if(ref(c).isNull()).alias(f"g{i}") for i, c in enumerate(small)]).first()
        gaps = {c: row[i] for i, c in enumerate(small)}
    for c in small:
        if gaps.get(c) and cfg.category_fill_value not in model.levels[c]:
            model.levels[c].append(cfg.category_fill_value)
        model.levels[c].sort()
    for c in categories:
        if c in small:
            continue
        # A dictionary table with codes in sorted order.
        values = counts.where(F.col("column_name") == c).select("value", "n")
        if cfg.category_fill == "constant":
            filler = literal_rows(work.sparkSession, [(cfg.category_fill_value, 0)], "value string, n long")
            values = values.unionByName(filler).groupBy("value").agg(F.sum("n").alias("n"))
        n = values.count()
        total = summary[c]["filled"]
        hot = [r[0] for r in values.where(F.col("n") > total / 200).select("value").collect()]
        coded = positions(values.select("value"), ["value"], "code", n)
        model.dictionaries[c] = (durable(coded.withColumn("code", F.col("code").cast("double"))), n, hot)
    counts.unpersist()


def impute(df: DataFrame, columns: list[str], strategy: str = "median", value: float | None = None) -> DataFrame:
    """Numeric columns with their gaps filled; other columns unchanged."""
    cfg = CleaningConfig(numeric_fill=strategy, numeric_fill_value=value, scaling="none", outlier_action="none")
    model = CleaningModel(cfg, numbers=list(columns))
    _fit_numbers(df, model)
    return df.select(*[F.coalesce(as_number(df, c), F.lit(model.fills[c])).alias(c) if c in columns else ref(c) for c in df.columns])


def impute_categories(df: DataFrame, columns: list[str], strategy: str = "most_frequent", value: str = "Unknown") -> DataFrame:
    cfg = CleaningConfig(category_fill=strategy, category_fill_value=value, encoding="none")
    model = CleaningModel(cfg, categories=list(columns))
    _fit_categories(df, model)
    return df.select(*[F.coalesce(ref(c), F.lit(model.fills[c])).alias(c) if c in columns else ref(c) for c in df.columns])


def scale(df: DataFrame, columns: list[str], how: str = "standard") -> DataFrame:
    """Scaled numeric columns; a column without spread is only shifted."""
    model = CleaningModel(CleaningConfig(numeric_fill="none", scaling=how, outlier_action="none"), numbers=list(columns))
    _fit_numbers(df, model)
    return df.select(*[((as_number(df, c) - F.lit(model.shift[c])) / F.lit(model.divide[c])).alias(c) if c in columns else ref(c) for c in df.columns])


def encode(df: DataFrame, columns: list[str], how: str = "onehot") -> DataFrame:
    """Encoded categorical columns after the other columns."""
    model = CleaningModel(CleaningConfig(encoding=how, outlier_action="none"), categories=list(columns), roles={c: CATEGORICAL for c in columns})
    _fit_categories(df, model)
    model.fills = {}
    model.kept = [c for c in df.columns if c not in columns]
    return model.transform(df)


def handle_outliers(df: DataFrame, columns: list[str], method: str = "iqr", k: float = 1.5, action: str = "clip") -> DataFrame:
    """One outlier action on the given columns; nulls are never outliers."""
    model = CleaningModel(CleaningConfig(outlier_action=action), numbers=list(columns), bounds=outlier_bounds(df, columns, method, k))
    if action == "drop_rows":
        tests = [model.is_outlier(c) for c in model.bounds]
        return df.where(~reduce(lambda a, b: a | b, tests)) if tests else df
    if action == "impute":
        model.outlier_fill = medians(df, {c: as_number(df, c) for c in model.bounds})
    return df.select(*[model.bounded(c).alias(c) if c in columns else ref(c) for c in df.columns])
