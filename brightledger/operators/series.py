"""Forecasting of many time series at once, and of single series of any length.

Input points become one row per grid step (hour, day, week, month) and series. A step's place in its series is computed
from its time, so it needs no window. Whatever looks at neighbouring steps runs on (series, chunk): a chunk is GRID_CHUNK
consecutive steps, and it either gets the first point after it from a table of one row per chunk, or the last steps before it
as copies. Smoothing folds chunks into linear maps. So one long series keeps all cores busy.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import as_moment, as_number, ref
from ..functions.durable import durable
from ..functions.joins import join_few
from ..functions.layout import compact

MIN_POINTS = 10
HOUR, DAY = 3600, 86400
# Largest median gap in seconds for hourly, daily and weekly data.
GAP_LIMITS = (("h", HOUR), ("D", 2 * DAY), ("W", 10 * DAY))
ALPHA, BETA = 0.3, 0.1
SPREAD = {"baseline": 0.05, "seasonal": 0.08, "boosted": 0.10}
MODEL_ORDER = ("baseline", "seasonal", "boosted")
PERIOD = 7.0
FOLD_CHUNK = 4096
GRID_CHUNK = 10_000
#: Seconds of the windows in which gaps between raw times are looked up (64 hours).
TIME_CHUNK = 64 * HOUR
FEATURES = ["year", "month", "day", "dayofweek", "quarter", "is_weekend", "lag_1", "lag_2", "lag_7", "rolling_mean_7", "rolling_std_7"]


@dataclass(frozen=True)
class ForecastConfig:
    date: str
    value: str
    keys: tuple[str, ...] = ()
    horizon: int = 30
    frequency: str = "auto"
    models: tuple[str, ...] = ("baseline", "boosted")
    test_ratio: float = 0.2
    confidence: float = 0.95
    trees: int = 100
    depth: int = 5


def _z(confidence: float) -> float:
    from statistics import NormalDist
    return 1.96 if confidence == 0.95 else NormalDist().inv_cdf(0.5 + confidence / 2)


def clean_series(df: DataFrame, date: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(series, ts, value): parsed points without bad rows, of series with at least ten points."""
    name = F.concat_ws("|", *[ref(k).cast("string") for k in keys]) if keys else F.lit("all")
    points = df.select(name.alias("series"), as_moment(df, date).alias("ts"), as_number(df, value).alias("value")).na.drop("any")
    sizes = points.groupBy("series").agg(F.count(F.lit(1)).alias("_n"))
    return join_few(points, durable(sizes.where(F.col("_n") >= MIN_POINTS).select("series")), "series", "left_semi")


def _seconds(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def infer_frequency(points: DataFrame, frequency: str = "auto") -> DataFrame:
    """One row per series: frequency code, step in seconds (null for months), first / last / number of distinct times.

    The median gap is only compared with three limits, which counts below and above each limit decide; nothing
    is sorted per series. Gaps come from windows over (series, 64 hours); the step into such a stretch looks at the last
    time of the stretch before. The result is written, since every later step joins it.
    """
    stretch = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / TIME_CHUNK)
    times = points.groupBy("series", "ts").agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", stretch)
    inside = times.withColumn("prev", F.lag("ts").over(W.partitionBy("series", "bucket").orderBy("ts")))
    ends = times.groupBy("series", "bucket").agg(F.max("ts").alias("end"))
    before = ends.select("series", "bucket", F.lag("end").over(W.partitionBy("series").orderBy("bucket")).alias("end_before"))
    gaps = inside.join(before, ["series", "bucket"]).withColumn("gap", _seconds(F.coalesce("prev", "end_before"), F.col("ts")))
    month_start = (F.date_trunc("month", "ts").cast("timestamp_ntz") == F.col("ts"))
    month_no = F.year("ts") * 12 + F.month("ts")
    tally = []
    for code, limit in GAP_LIMITS:
        low, high = F.col("gap") <= limit, F.col("gap") > limit
        tally += [F.count_if(low).alias(f"n_{code}"), F.max(F.when(low, F.col("gap"))).alias(f"lo_{code}"), F.min(F.when(high, F.col("gap"))).alias(f"hi_{code}")]
    facts = gaps.groupBy("series").agg(
        F.sum("copies").alias("points"), F.count(F.lit(1)).alias("times"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"), F.bool_and(month_start).alias("all_month_starts"),
        (F.max(month_no) - F.min(month_no) + 1).alias("months"), *tally,
    )
    if frequency != "auto":
        code = {"H": "h"}.get(frequency, frequency)
        named = facts.withColumn("frequency", F.lit(code)).withColumn("regular", F.lit(False))
    else:
        same = F.col("points") - F.col("times")
        m = F.col("points") - 1
        label = F.lit("MS")
        for code, limit in reversed(GAP_LIMITS):
            at_most = F.col(f"n_{code}") + same
            half = F.floor(m / 2)
            tie_low = F.coalesce(F.col(f"lo_{code}"), F.lit(0.0))
            middle = (tie_low + F.coalesce(F.col(f"hi_{code}"), tie_low)) / 2
            within = F.when(m % 2 == 1, at_most >= half + 1).otherwise((at_most >= half + 1) | ((at_most == half) & (middle <= limit)))
            label = F.when(within, code).otherwise(label)
        g = F.col("gap_min").cast("long")
        even = (same == 0) & (F.col("times") >= 3) & (F.col("gap_min") == F.col("gap_max")) & (F.col("gap_min") == g)
        monthly = (same == 0) & (F.col("times") >= 3) & F.col("all_month_starts") & (F.col("months") == F.col("times"))
        def steps(size, unit):
            return F.concat(F.when(g == size, "").otherwise((g / size).cast("long").cast("string")), F.lit(unit))
        regular = (
            F.when(g % (7 * DAY) == 0, steps(7 * DAY, "W")).when(g % DAY == 0, steps(DAY, "D")).when(g % HOUR == 0, steps(HOUR, "h"))
            .when(g % 60 == 0, steps(60, "min")).otherwise(steps(1, "s"))
        )
        named = facts.withColumn("frequency", F.when(monthly, "MS").when(even, regular).otherwise(label)).withColumn("regular", even & ~monthly)
    step = (
        F.when(F.col("frequency").isin("MS", "M"), F.lit(None)).when(F.col("regular"), F.col("gap_min"))
        .when(F.col("frequency") == "h", F.lit(HOUR)).when(F.col("frequency") == "W", F.lit(7 * DAY)).otherwise(F.lit(DAY))
    ).cast("long")
    return durable(named.select("series", "frequency", step.alias("step_seconds"), "regular", "points", "times", "first_ts", "last_ts"))


def _bucket(ts: Column) -> Column:
    """Grid label of a time: start of hour / day / month, end of month, the Sunday closing the week, or the step."""
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    shifted = F.timestamp_add("DAY", (6 - F.weekday(ts)).cast("int"), day)
    # Adding seconds as an int would overflow after 68 years, so whole days and the rest are added apart.
    whole = F.floor(_seconds(F.col("first_ts"), ts) / F.col("step_seconds")) * F.col("step_seconds")
    stepped = F.timestamp_add("SECOND", F.pmod(whole, F.lit(DAY)).cast("int"), F.timestamp_add("DAY", F.floor(whole / DAY).cast("int"), F.col("first_ts")))
    return (
        F.when(F.col("regular"), stepped)
        .when(F.col("frequency") == "h", F.date_trunc("hour", ts).cast("timestamp_ntz"))
        .when(F.col("frequency") == "W", shifted)
        .when(F.col("frequency") == "MS", F.date_trunc("month", ts).cast("timestamp_ntz"))
        .when(F.col("frequency") == "M", F.last_day(ts).cast("timestamp_ntz"))
        .otherwise(day)
    )


def _advance(start: Column, i: Column) -> Column:
    """The grid time ``i`` steps after ``start``."""
    total = i * F.col("step_seconds")
    fixed = F.timestamp_add("SECOND", F.pmod(total, F.lit(DAY)).cast("int"), F.timestamp_add("DAY", F.floor(total / DAY).cast("int"), start))
    by_month = F.timestamp_add("MONTH", i.cast("int"), start)
    month_end = F.last_day(F.timestamp_add("MONTH", i.cast("int"), F.date_trunc("month", start).cast("timestamp_ntz"))).cast("timestamp_ntz")
    return F.when(F.col("frequency") == "MS", by_month).when(F.col("frequency") == "M", month_end).otherwise(fixed)


def _steps_between(a: Column, b: Column) -> Column:
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return F.when(F.col("frequency").isin("MS", "M"), months).otherwise(F.floor(_seconds(a, b) / F.col("step_seconds"))).cast("long")


def missing_steps(frequency: DataFrame) -> DataFrame:
    """Grid size between the first and the last time of each series, and how many steps have no point."""
    day0 = F.date_trunc("day", "first_ts").cast("timestamp_ntz")
    sunday = F.timestamp_add("DAY", (6 - F.weekday("first_ts")).cast("int"), day0)
    sundays = F.greatest(F.floor(F.datediff(F.col("last_ts").cast("date"), sunday.cast("date")) / 7) + 1, F.lit(0))
    month0 = F.date_trunc("month", "first_ts").cast("timestamp_ntz")
    months = (F.year("last_ts") - F.year("first_ts")) * 12 + F.month("last_ts") - F.month("first_ts")
    size = (
        F.when(F.col("frequency") == "MS", months + F.when(month0 == F.col("first_ts"), 1).otherwise(0))
        .when(F.col("frequency") == "M", months + F.when(F.last_day("last_ts") == F.col("last_ts").cast("date"), 1).otherwise(0))
        .when((F.col("frequency") == "W") & ~F.col("regular"), sundays)
        .otherwise(F.floor(_seconds(F.col("first_ts"), F.col("last_ts")) / F.col("step_seconds")) + 1)
    ).cast("long")
    return frequency.select("series", "frequency", "times", size.alias("grid_steps"), F.greatest(size - F.col("times"), F.lit(0)).cast("long").alias("missing_steps"))


def resample(points: DataFrame, frequency: DataFrame, how: str = "mean") -> DataFrame:
    """(series, ts, value, observed, at, size): every grid step of each series, gaps filled linearly in time.

    The frequency table has one row per series. ``at`` counts the steps from 0, ``size`` is their number. A gap is made
    by the step before it, which looks up the next step that has points; the first and the last step always have some.
    """
    spans = frequency.select("series", "frequency", "step_seconds", "regular", "first_ts", _bucket(F.col("first_ts")).alias("start"), _bucket(F.col("last_ts")).alias("stop"))
    spans = spans.withColumn("size", (_steps_between(F.col("start"), F.col("stop")) + 1).cast("int")).drop("stop")
    named = join_few(points, spans, "series").withColumn("at", _steps_between(F.col("start"), _bucket(F.col("ts"))).cast("int"))
    agg = F.sum("value") if how == "sum" else F.avg("value")
    steps = named.groupBy("series", "at", "size", "start", "frequency", "step_seconds").agg(agg.alias("value"))
    steps = steps.withColumn("chunk", F.floor(F.col("at") / GRID_CHUNK))
    firsts = steps.groupBy("series", "chunk").agg(F.min("at").alias("at"), F.min_by("value", "at").alias("value"))
    after = firsts.select("series", "chunk", F.lead(F.struct("at", "value")).over(W.partitionBy("series").orderBy("chunk")).alias("after"))
    inside = F.lead(F.struct("at", "value")).over(W.partitionBy("series", "chunk").orderBy("at"))
    ahead = steps.withColumn("inside", inside).join(after, ["series", "chunk"]).withColumn("q", F.coalesce("inside", "after"))
    filled = ahead.withColumn("step", F.explode(F.sequence(F.col("at"), F.coalesce(F.col("q.at") - 1, F.col("at")))))
    t, t0, t1 = (_advance(F.col("start"), x.cast("long")) for x in (F.col("step"), F.col("at"), F.col("q.at")))
    between = F.col("value") + (F.col("q.value") - F.col("value")) * F.try_divide(_seconds(t0, t), _seconds(t0, t1))
    observed = F.col("step") == F.col("at")
    return filled.select("series", t.alias("ts"), F.when(observed, F.col("value")).otherwise(between).alias("value"), observed.alias("observed"), F.col("step").alias("at"), "size")


def numbered(grid: DataFrame) -> DataFrame:
    """The grid with ``at`` and ``size``; grids from elsewhere are numbered by a window over each series."""
    if "at" in grid.columns and "size" in grid.columns:
        return grid
    w = W.partitionBy("series")
    return grid.withColumn("at", F.row_number().over(w.orderBy("ts")) - 1).withColumn("size", F.count(F.lit(1)).over(w).cast("int"))


def with_steps_before(grid: DataFrame, chunk: int, steps: int) -> DataFrame:
    """Adds ``chunk`` and ``own``: each chunk of a series gets copies (not own) of the last steps of the chunk before."""
    here = F.floor(F.col("at") / chunk)
    both = F.when((F.pmod(F.col("at"), F.lit(chunk)) >= chunk - steps) & (F.col("at") + 1 < F.col("size")), F.array(here, here + 1)).otherwise(F.array(here))
    return grid.withColumn("chunk", F.explode(both)).withColumn("own", F.col("chunk") == here)


def calendar_columns(ts: str = "ts") -> list[Column]:
    c = F.col(ts)
    return [
        F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day"), F.weekday(c).alias("dayofweek"),
        F.quarter(c).alias("quarter"), (F.weekday(c) >= 5).cast("int").alias("is_weekend"),
    ]


def time_features(grid: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Calendar columns, lags 1 / 2 / 7 and mean and deviation of the seven values before each step."""
    w = W.partitionBy("series", "chunk").orderBy("at")
    past = w.rowsBetween(-7, -1)
    wide = with_steps_before(numbered(grid), GRID_CHUNK, 7).select(
        "series", "ts", "value", *keep, "own", *[F.lag("value", k).over(w).alias(f"lag_{k}") for k in (1, 2, 7)],
        F.avg("value").over(past).alias("rolling_mean_7"), F.coalesce(F.stddev_samp("value").over(past), F.lit(0.0)).alias("rolling_std_7"),
    )
    return wide.where("own").select("series", "ts", "value", *keep, *calendar_columns(), "lag_1", "lag_2", "lag_7", "rolling_mean_7", "rolling_std_7")


def chronological_split(grid: DataFrame, horizon: int = 30, ratio: float = 0.2) -> DataFrame:
    """Adds pos (from 1), n_total, n_train and the part; the last max(3, min(horizon, n x ratio)) steps are the test."""
    sized = numbered(grid).withColumn("pos", (F.col("at") + 1).cast("int")).withColumn("n_total", F.col("size").cast("int"))
    n_test = F.greatest(F.lit(3), F.least(F.lit(horizon), F.floor(F.col("n_total") * F.lit(ratio)).cast("int")))
    split = sized.withColumn("n_train", F.col("n_total") - n_test)
    return split.withColumn("part", F.when(F.col("pos") <= F.col("n_train"), "train").otherwise("test"))


def future_grid(grid: DataFrame, frequency: DataFrame, horizon: int = 30) -> DataFrame:
    """(series, step, ts): the steps that follow the last grid time of each series."""
    last = grid.groupBy("series").agg(F.max("ts").alias("end_ts")).join(frequency.select("series", "frequency", "step_seconds"), "series")
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select("series", "step", _advance(F.col("end_ts"), F.col("step")).alias("ts"))


def _outputs(fit: DataFrame, split: DataFrame, future: DataFrame, model: str, predicted: Column, confidence: float) -> DataFrame:
    """Test and future rows of a model whose prediction is an expression over its fitted row and the step number ``t``."""
    z, c = _z(confidence), SPREAD[model]
    test = split.where("part = 'test'").join(fit, "series").withColumn("t", F.col("pos") - F.col("f_train")).select(
        "series", F.lit(model).alias("model"), F.lit("test").alias("part"), F.col("t").alias("step"), "ts", "value",
        predicted.alias("predicted"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    margin = F.lit(z) * F.col("sigma") * F.sqrt(1 + c * F.col("step"))
    ahead = future.join(fit, "series").withColumn("t", F.col("step") + F.col("f_total") - F.col("f_train")).withColumn("predicted", predicted).select(
        "series", F.lit(model).alias("model"), F.lit("future").alias("part"), "step", "ts", F.lit(None).cast("double").alias("value"),
        "predicted", (F.col("predicted") - margin).alias("lower"), (F.col("predicted") + margin).alias("upper"))
    return test.unionByName(ahead)


def holt_fit(split: DataFrame) -> DataFrame:
    """Level, trend and one-step spread per series after smoothing its training steps.

    One smoothing step maps (level, trend) linearly, so a run of steps is a 2x2 matrix and an offset. Runs of
    4096 steps are folded in parallel, with the moments of their one-step differences, and the short list of
    runs is folded per series: no row or window ever holds a whole long series.
    """
    train = with_steps_before(numbered(split).where("part = 'train'"), FOLD_CHUNK, 1).withColumnRenamed("chunk", "run")
    step = F.col("value") - F.lag("value").over(W.partitionBy("series", "run").orderBy("pos"))
    # A copy at the end of the training part may open a run of its own without a step in it.
    runs = train.withColumn("d", F.coalesce(step, F.lit(0.0))).where("own").groupBy("series", "run").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("ys"),
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.var_pop("d").alias("spread"), F.max("n_total").alias("f_total"))

    def smooth(level, trend, y):
        new = ALPHA * y + (1 - ALPHA) * (level + trend)
        return new, BETA * (new - level) + (1 - BETA) * trend

    def along(state, y):
        a, b = smooth(state["a"], state["b"], y)
        return F.struct(a.alias("a"), b.alias("b"))

    def along_zero(state, _):
        return along(state, F.lit(0.0))

    def start(a, b):
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))

    folded = runs.select("series", "run", "n", "mean", "spread", "f_total", F.element_at("ys", 1).alias("y0"), F.element_at("ys", -1).alias("y1"), F.aggregate("ys", start(0.0, 0.0), along).alias("c"),
                         F.aggregate("ys", start(1.0, 0.0), along_zero).alias("u"), F.aggregate("ys", start(0.0, 1.0), along_zero).alias("v"))
    total = F.sum("n").cast("double")
    mean = F.sum(F.col("n") * F.col("mean")) / total
    square = F.sum(F.col("n") * (F.col("spread") + F.col("mean") * F.col("mean"))) / total
    done = folded.groupBy("series").agg(
        F.sort_array(F.collect_list(F.struct("run", "c", "u", "v"))).alias("runs"), F.min_by("y0", "run").alias("y0"), F.max_by("y1", "run").alias("y1"),
        F.sum("n").alias("f_train"), F.max("f_total").alias("f_total"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("sigma"))

    def apply_run(state, r):
        return F.struct((r["u"]["a"] * state["a"] + r["v"]["a"] * state["b"] + r["c"]["a"]).alias("a"),
                        (r["u"]["b"] * state["a"] + r["v"]["b"] * state["b"] + r["c"]["b"]).alias("b"))

    slope = (F.col("y1") - F.col("y0")) / F.greatest(F.lit(1), F.col("f_train") - 1)
    first = F.struct(F.col("y0").alias("a"), slope.alias("b"))
    done = done.withColumn("s", F.aggregate("runs", first, apply_run))
    sigma = F.when(F.col("f_train") > 1, F.col("sigma")).otherwise(F.lit(1.0))
    return done.select("series", F.col("s.a").alias("level"), F.col("s.b").alias("trend"), sigma.alias("sigma"), "f_train", "f_total")


def holt_forecast(split: DataFrame, future: DataFrame, confidence: float = 0.95) -> DataFrame:
    return _outputs(holt_fit(split), split, future, "baseline", F.col("level") + F.col("t") * F.col("trend"), confidence)


def harmonic_sums(split: DataFrame) -> DataFrame:
    """Normal-equation sums per series for 1, t, sin and cos of a seven-step wave (t scaled by the length)."""
    train = split.where("part = 'train'").withColumn("k", (F.col("pos") - 1).cast("double"))
    x = [F.lit(1.0), F.col("k") / F.col("n_total"), F.sin(F.lit(2 * 3.141592653589793) * F.col("k") / PERIOD), F.cos(F.lit(2 * 3.141592653589793) * F.col("k") / PERIOD)]
    sums = [F.sum(x[i] * x[j]).alias(f"x{i}{j}") for i in range(4) for j in range(i, 4)] + [F.sum(x[i] * F.col("value")).alias(f"y{i}") for i in range(4)]
    return train.groupBy("series").agg(F.count(F.lit(1)).alias("f_train"), F.max("n_total").alias("f_total"), *sums)


def harmonic_fit(split: DataFrame) -> DataFrame:
    """Coefficients and residual spread per series; the 4x4 systems are solved in batches of series."""
    def solve(batches):
        import numpy as np
        import pandas as pd
        for b in batches:
            n = len(b)
            gram, rhs = np.zeros((n, 4, 4)), np.zeros((n, 4))
            for i in range(4):
                rhs[:, i] = b[f"y{i}"]
                for j in range(i, 4):
                    gram[:, i, j] = gram[:, j, i] = b[f"x{i}{j}"]
            coef = np.einsum("nij,nj->ni", np.linalg.pinv(gram, hermitian=True), rhs)
            yield pd.DataFrame({"series": b["series"], "f_train": b["f_train"], "f_total": b["f_total"], **{f"c{i}": coef[:, i] for i in range(4)}})

    coef = harmonic_sums(split).mapInPandas(solve, "series string, f_train long, f_total long, c0 double, c1 double, c2 double, c3 double")
    train = split.where("part = 'train'").select("series", "pos", "value").join(coef, "series").withColumn("t", F.col("pos") - F.col("f_train"))
    spread = train.groupBy("series").agg(F.stddev_pop(F.col("value") - _wave()).alias("sigma"))
    return coef.join(spread, "series")


def _wave() -> Column:
    k = (F.col("t") + F.col("f_train") - 1).cast("double")
    angle = F.lit(2 * 3.141592653589793) * k / PERIOD
    return F.col("c0") + F.col("c1") * k / F.col("f_total") + F.col("c2") * F.sin(angle) + F.col("c3") * F.cos(angle)


def harmonic_forecast(split: DataFrame, future: DataFrame, confidence: float = 0.95) -> DataFrame:
    return _outputs(harmonic_fit(split), split, future, "seasonal", _wave(), confidence)


def boosted_forecast(split: DataFrame, frequency: DataFrame, horizon: int, confidence: float = 0.95, trees: int = 100, depth: int = 5, seed: int = 42) -> DataFrame:
    """Boosted trees on calendar, lag and rolling features, one model over all series.

    Future steps feed predictions back. Each task holds the last values of its series and walks the horizon
    for all of them together, so the recursion costs no shuffle and no growing plan.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from ..functions.trees import model_trees, predict

    spark = split.sparkSession
    feats = time_features(split, ("pos", "n_train", "n_total", "part"))
    train = feats.where("part = 'train'").na.drop("any", subset=FEATURES)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    vectors = assemble.transform(train).select("series", "value", "features")
    packed = compact(vectors).persist(StorageLevel.MEMORY_AND_DISK)
    model = GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, labelCol="value", featuresCol="features").fit(packed)
    fitted = model.transform(packed)
    spread = fitted.groupBy("series").agg(F.stddev_pop(F.col("value") - F.col("prediction")).alias("sigma"))
    test = model.transform(assemble.transform(feats.where("part = 'test'").na.fill(0.0, FEATURES)))
    test_rows = test.select(
        "series", F.lit("boosted").alias("model"), F.lit("test").alias("part"), (F.col("pos") - F.col("n_train")).alias("step"), "ts", "value",
        F.col("prediction").alias("predicted"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))

    arrays = spark.sparkContext.broadcast(model_trees(model, spark))
    tail = split.where(F.col("pos") > F.col("n_total") - 7).groupBy("series").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("tail"))
    calendar = future_grid(split, frequency, horizon).select("series", "step", "ts", *[c.cast("double") for c in calendar_columns()])
    ahead = calendar.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("step", "ts", "year", "month", "day", "dayofweek", "quarter", "is_weekend"))).alias("steps"))
    state = tail.join(ahead, "series").select(
        "series", "tail", F.transform("steps", lambda s: s["ts"]).alias("ts"),
        *[F.transform("steps", _field(c)).alias(c) for c in FEATURES[:6]])

    def walk(batches):
        import numpy as np
        import pandas as pd
        forest = arrays.value
        for b in batches:
            if b.empty:
                continue
            # Short series repeat their first value on the left so that every lag exists.
            recent = np.array([np.r_[np.full(7 - len(v), v[-1] if len(v) else 0.0), v] for v in b["tail"]])
            known = np.array([len(v) for v in b["tail"]])
            cal = np.stack([np.stack(b[c].to_numpy()) for c in FEATURES[:6]], axis=-1)
            series, times = b["series"].to_numpy(), b["ts"].to_numpy()
            for h in range(cal.shape[1]):
                count = np.minimum(known + h, 7)
                mask = np.arange(7) >= (7 - count)[:, None]
                mean = (recent * mask).sum(1) / count
                var = (((recent - mean[:, None]) ** 2) * mask).sum(1) / np.maximum(count - 1, 1)
                one = recent[:, -1]
                two, seven = np.where(count >= 2, recent[:, -2], one), np.where(count >= 7, recent[:, 0], one)
                x = np.column_stack([cal[:, h, :], one, two, seven, mean, np.where(count >= 2, np.sqrt(var), 0.0)])
                y = predict(forest, x)
                recent = np.column_stack([recent[:, 1:], y])
                yield pd.DataFrame({"series": series, "step": np.full(len(b), h + 1, dtype="int32"), "ts": [t[h] for t in times], "predicted": y})

    z, c = _z(confidence), SPREAD["boosted"]
    margin = F.lit(z) * F.col("sigma") * F.sqrt(1 + c * F.col("step"))
    ahead_rows = state.mapInPandas(walk, "series string, step int, ts timestamp_ntz, predicted double")
    # A short series has no complete training row and so no residuals: its spread is 1.
    future_rows = ahead_rows.join(spread, "series", "left").withColumn("sigma", F.coalesce("sigma", F.lit(1.0))).select(
        "series", F.lit("boosted").alias("model"), F.lit("future").alias("part"), "step", "ts", F.lit(None).cast("double").alias("value"),
        "predicted", (F.col("predicted") - margin).alias("lower"), (F.col("predicted") + margin).alias("upper"))
    return test_rows.unionByName(future_rows)


def _field(name: str):
    return lambda s: s[name]


def forecast_metrics(rows: DataFrame, actual: str = "value", predicted: str = "predicted", by: tuple[str, ...] = ("series", "model")) -> DataFrame:
    """MAE, MSE, RMSE, MAPE % and sMAPE % (4 decimals)."""
    y, p = F.col(actual), F.col(predicted)
    err = y - p
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
        F.avg(F.abs(err / F.greatest(F.abs(y), F.lit(1e-8)))).alias("mape"), F.avg(2.0 * F.abs(err) / (F.abs(y) + F.abs(p) + 1e-8)).alias("smape"),
    )
    return out.select(*by, "n", F.round("mae", 4).alias("mae"), F.round("mse", 4).alias("mse"), F.round(F.sqrt("mse"), 4).alias("rmse"),
                      F.round(F.col("mape") * 100, 4).alias("mape"), F.round(F.col("smape") * 100, 4).alias("smape"))


def best_models(metrics: DataFrame) -> DataFrame:
    """The model with the lowest RMSE per series; the earlier model wins ties."""
    order = reduce(lambda acc, m: acc.when(F.col("model") == m[1], m[0]), enumerate(MODEL_ORDER), F.when(F.lit(False), F.lit(-1))).otherwise(len(MODEL_ORDER))
    return metrics.groupBy("series").agg(F.min_by("model", F.struct("rmse", order.alias("o"))).alias("best_model"), F.min("rmse").alias("rmse"))


def forecast(df: DataFrame, config: ForecastConfig) -> dict[str, DataFrame]:
    """Grid, forecasts of the chosen models, metrics, best model and a summary row per series."""
    for c in (config.date, config.value, *config.keys):
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    points = clean_series(df, config.date, config.value, config.keys)
    if not config.keys and points.isEmpty():
        raise ValueError(f"a series needs at least {MIN_POINTS} valid points")
    frequency = infer_frequency(points, config.frequency)
    grid = resample(points, frequency)
    # Written once: every model, its test part and the summary read it.
    split = durable(chronological_split(grid, config.horizon, config.test_ratio))
    future = future_grid(split, frequency, config.horizon)
    makers = {
        "baseline": lambda: holt_forecast(split, future, config.confidence),
        "seasonal": lambda: harmonic_forecast(split, future, config.confidence),
        "boosted": lambda: boosted_forecast(split, frequency, config.horizon, config.confidence, config.trees, config.depth),
    }
    chosen = [m for m in MODEL_ORDER if m in config.models] or ["baseline"]
    rows = reduce(DataFrame.unionByName, [makers[m]() for m in chosen])
    metrics = forecast_metrics(rows.where("part = 'test'"))
    best = best_models(metrics)
    summary = split.groupBy("series").agg(F.max("n_total").alias("total_records"), F.max("n_train").alias("train_records"), (F.max("n_total") - F.max("n_train")).alias("test_records"))
    summary = summary.join(missing_steps(frequency).select("series", "frequency", "missing_steps"), "series").join(best, "series")
    return {"series": split, "forecast": rows, "metrics": metrics, "best": best, "summary": summary, "frequency": frequency}
