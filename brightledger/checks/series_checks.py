"""Time-series queries: daily revenue (in thousands) per order priority with some days left out, and raw event values."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import series as S
from .views import table

HORIZON = 14

DAILY_SQL = """dl AS (SELECT o_orderpriority AS series, o_orderdate AS ts, round(sum(o_totalprice) / 1000, 0) AS value FROM orders GROUP BY 1, 2)"""
GRID_SQL = f"""{DAILY_SQL}, sp AS (SELECT series, min(ts) AS a, max(ts) AS b FROM dl GROUP BY 1),
  g AS (SELECT series, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM sp),
  f AS (SELECT g.series, g.ts, dl.value FROM g LEFT JOIN dl ON dl.series = g.series AND dl.ts = g.ts),
  nb AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER p AS pt, last_value(value IGNORE NULLS) OVER p AS pv,
           first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER q AS qt, first_value(value IGNORE NULLS) OVER q AS qv FROM f
         WINDOW p AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  r AS (SELECT series, ts, coalesce(value, pv + (qv - pv) * ((epoch(ts) - epoch(pt)) / (epoch(qt) - epoch(pt)))) AS value, value IS NOT NULL AS observed FROM nb)"""
SPLIT_SQL = f"""{GRID_SQL}, c AS (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY ts) AS INTEGER) AS pos, CAST(count(*) OVER (PARTITION BY series) AS INTEGER) AS n_total FROM r),
  s AS (SELECT *, n_total - CAST(greatest(3, least({HORIZON}, floor(n_total * 0.2::DOUBLE))) AS INTEGER) AS n_train FROM c)"""
_PART = "CASE WHEN pos <= n_train THEN 'train' ELSE 'test' END AS part"
FEATURE_SQL = f"""{GRID_SQL}, ft AS (SELECT *, lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2, lag(value, 7) OVER w AS lag_7,
    avg(value) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7,
    coalesce(stddev_samp(value) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS rolling_std_7 FROM r WINDOW w AS (PARTITION BY series ORDER BY ts))"""


def _gapped(sql: str) -> str:
    """The same over a daily series with days left out."""
    return sql.replace("FROM orders GROUP BY", "FROM orders WHERE day(o_orderdate) % 7 <> 3 GROUP BY")


def daily(s, d, gaps=False):
    """Daily revenue; gaps: without some days of each month, for the operators that find and fill gaps."""
    o = table(s, d, "orders")
    return (
        (o.where(F.dayofmonth("o_orderdate") % 7 != 3) if gaps else o).groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"))
        .agg(F.round(F.sum("o_totalprice") / 1000, 0).alias("value"))
    )


def _points(s, d, gaps=False):
    return S.clean_series(daily(s, d, gaps), "ts", "value", ("series",))


def _frequency(s, d, gaps=False):
    return S.infer_frequency(_points(s, d, gaps), "D")


def _grid(s, d, gaps=False):
    points = _points(s, d, gaps)
    return S.resample(points, S.infer_frequency(points, "D"))


def _split(s, d):
    return S.chronological_split(_grid(s, d), HORIZON)


def _future(s, d):
    points = _points(s, d)
    frequency = S.infer_frequency(points, "D")
    return S.future_grid(S.resample(points, frequency), frequency, HORIZON)


def _mixed_points(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("series"), "ts", "value")
    o = table(s, d, "orders")
    month = o.groupBy(F.lit("monthly").alias("series"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    raw = o.select(F.lit("orders").alias("series"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    return S.clean_series(e.unionByName(month).unionByName(daily(s, d)).unionByName(raw), "ts", "value", ("series",))


def _rounded(df, *columns, places=2):
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


def _forecast_rows(rows):
    return _rounded(rows, "value", "predicted", "lower", "upper", places=6)


def _naive(s, d):
    """Two naive forecasts of the test part: the value one step and seven steps before."""
    w = W.partitionBy("series").orderBy("ts")
    lagged = _split(s, d).withColumn("l1", F.lag("value", 1).over(w)).withColumn("l7", F.lag("value", 7).over(w)).where("part = 'test'")
    return lagged.select("series", F.lit("baseline").alias("model"), "value", F.col("l1").alias("predicted")).unionByName(
        lagged.select("series", F.lit("seasonal").alias("model"), "value", F.col("l7").alias("predicted")))


def _run(s, d, models, **extra):
    return S.forecast(daily(s, d), S.ForecastConfig("ts", "value", ("series",), HORIZON, "D", models, **extra))


def _boosted(s, d):
    return _forecast_rows(_run(s, d, ("boosted",))["forecast"])


def _summary(s, d):
    return _run(s, d, ("baseline", "seasonal"))["summary"]


QUERIES = {
    "series_clean": lambda s, d: S.clean_series(table(s, d, "events"), "ts", "value", ("event_type",)),
    "infer_frequency": lambda s, d: S.infer_frequency(_mixed_points(s, d)).select("series", "frequency", "points", "times"),
    "missing_steps": lambda s, d: S.missing_steps(_frequency(s, d, True)).select("series", "grid_steps", "missing_steps"),
    "resample_interpolate": lambda s, d: _rounded(_grid(s, d, True).select("series", "ts", "value", "observed"), "value", places=8),
    "calendar_features": lambda s, d: _grid(s, d).select("series", "ts", *S.calendar_columns()),
    "lag_features": lambda s, d: _rounded(S.time_features(_grid(s, d)).select("series", "ts", "lag_1", "lag_2", "lag_7"), "lag_1", "lag_2", "lag_7", places=8),
    "rolling_features": lambda s, d: _rounded(S.time_features(_grid(s, d)).select("series", "ts", "rolling_mean_7", "rolling_std_7"), "rolling_mean_7", "rolling_std_7", places=6),
    "chronological_split": lambda s, d: _split(s, d).select("series", "ts", "pos", "n_total", "n_train", "part"),
    "future_grid": _future,
    "holt_forecast": lambda s, d: _forecast_rows(_run(s, d, ("baseline",))["forecast"]),
    "harmonic_sums": lambda s, d: (lambda t: t.select(*[F.round(c, 3).alias(c) if c[0] in "xy" else F.col(c) for c in t.columns]))(S.harmonic_sums(_split(s, d))),
    "harmonic_forecast": lambda s, d: _forecast_rows(_run(s, d, ("seasonal",))["forecast"]),
    "gbt_forecast": _boosted,
    "forecast_metrics": lambda s, d: S.forecast_metrics(_naive(s, d)),
    "forecast_best_model": lambda s, d: S.best_models(S.forecast_metrics(_naive(s, d))).select("series", "best_model"),
    "forecast_summary": _summary,
    "forecast_counts": lambda s, d: _summary(s, d).select("series", "total_records", "train_records", "test_records", "frequency", "missing_steps"),
}

_DAILY_POINTS = "SELECT * FROM dl"
_MIXED = f"""{DAILY_SQL}, pts AS (SELECT event_type AS series, ts FROM events UNION ALL SELECT 'monthly', date_trunc('month', o_orderdate) FROM orders GROUP BY 2
  UNION ALL SELECT series, ts FROM dl UNION ALL SELECT 'orders', o_orderdate FROM orders),
  gp AS (SELECT series, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series ORDER BY ts)) AS gap FROM pts),
  st AS (SELECT series, count(*) AS points, count(DISTINCT ts) AS times, median(gap) AS mid, min(gap) AS g0, max(gap) AS g1, bool_and(day(ts) = 1) AS starts,
     date_diff('month', min(ts), max(ts)) + 1 AS months FROM gp GROUP BY 1 HAVING count(*) >= 10)"""
_X = ["1.0::DOUBLE", "(k / n_total)", "sin(2 * pi() * k / 7)", "cos(2 * pi() * k / 7)"]
_SUMS = ", ".join([f"round(sum({_X[i]} * {_X[j]}), 3) AS x{i}{j}" for i in range(4) for j in range(i, 4)] + [f"round(sum({_X[i]} * value), 3) AS y{i}" for i in range(4)])
_NAIVE = f"""{SPLIT_SQL}, lg AS (SELECT *, lag(value, 1) OVER (PARTITION BY series ORDER BY ts) AS l1, lag(value, 7) OVER (PARTITION BY series ORDER BY ts) AS l7 FROM s),
  nv AS (SELECT series, 'baseline' AS model, value AS y, l1 AS p FROM lg WHERE pos > n_train UNION ALL SELECT series, 'seasonal', value, l7 FROM lg WHERE pos > n_train),
  mt AS (SELECT series, model, count(*) AS n, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse,
     avg(abs((y - p) / greatest(abs(y), 1e-8))) * 100 AS mape, avg(2 * abs(y - p) / (abs(y) + abs(p) + 1e-8)) * 100 AS smape FROM nv GROUP BY 1, 2)"""

ORACLES = {
    "forecast_counts": f"""WITH {SPLIT_SQL}, m AS (SELECT series, greatest(date_diff('day', min(ts), max(ts)) + 1 - count(DISTINCT ts), 0) AS missing_steps FROM dl GROUP BY 1)
        SELECT s.series, max(n_total) AS total_records, max(n_train) AS train_records, max(n_total) - max(n_train) AS test_records, 'D' AS frequency, max(missing_steps) AS missing_steps FROM s JOIN m ON m.series = s.series GROUP BY 1""",
    "series_clean": "SELECT event_type AS series, ts, value FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) >= 10)",
    "infer_frequency": f"""WITH {_MIXED} SELECT series, CASE WHEN points = times AND starts AND months = times THEN 'MS' WHEN points = times AND g0 = g1 AND g0 = 86400 THEN 'D'
        WHEN mid <= 3600 THEN 'h' WHEN mid <= 172800 THEN 'D' WHEN mid <= 864000 THEN 'W' ELSE 'MS' END AS frequency, points, times FROM st""",
    "missing_steps": f"WITH {_gapped(DAILY_SQL)} SELECT series, date_diff('day', min(ts), max(ts)) + 1 AS grid_steps, greatest(date_diff('day', min(ts), max(ts)) + 1 - count(DISTINCT ts), 0) AS missing_steps FROM dl GROUP BY 1",
    "resample_interpolate": f"WITH {_gapped(GRID_SQL)} SELECT series, ts, round(value, 8) AS value, observed FROM r",
    "calendar_features": f"""WITH {GRID_SQL} SELECT series, ts, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, (isodow(ts) - 1)::INTEGER AS dayofweek,
        quarter(ts)::INTEGER AS quarter, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM r""",
    "lag_features": f"WITH {FEATURE_SQL} SELECT series, ts, round(lag_1, 8) AS lag_1, round(lag_2, 8) AS lag_2, round(lag_7, 8) AS lag_7 FROM ft",
    "rolling_features": f"WITH {FEATURE_SQL} SELECT series, ts, round(rolling_mean_7, 6) AS rolling_mean_7, round(rolling_std_7, 6) AS rolling_std_7 FROM ft",
    "chronological_split": f"WITH {SPLIT_SQL} SELECT series, ts, pos, n_total, n_train, {_PART} FROM s",
    "future_grid": f"WITH {GRID_SQL}, e AS (SELECT series, max(ts) AS b FROM r GROUP BY 1) SELECT series, i::INTEGER AS step, b + to_days(i::INTEGER) AS ts FROM e, (SELECT unnest(range(1, {HORIZON + 1})) AS i) z",
    "holt_forecast": f"""WITH RECURSIVE {SPLIT_SQL}, tr AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY series ORDER BY pos), value) AS d FROM s WHERE pos <= n_train),
        en AS (SELECT series, arg_min(value, pos) AS y0, arg_max(value, pos) AS y1, count(*) AS n, stddev_pop(d) AS sigma, max(n_total) AS n_total FROM tr GROUP BY 1),
        h AS (SELECT series, 0 AS pos, y0 AS lev, (y1 - y0) / greatest(1, n - 1) AS trd FROM en
              UNION ALL SELECT h.series, h.pos + 1, 0.3::DOUBLE * tr.value + 0.7::DOUBLE * (lev + trd), 0.1::DOUBLE * (0.3::DOUBLE * tr.value + 0.7::DOUBLE * (lev + trd) - lev) + 0.9::DOUBLE * trd
              FROM h JOIN tr ON tr.series = h.series AND tr.pos = h.pos + 1),
        z AS (SELECT h.*, n, sigma, n_total FROM h JOIN en ON en.series = h.series AND h.pos = n)
        SELECT s.series, 'baseline' AS model, 'test' AS part, CAST(s.pos - n AS BIGINT) AS step, s.ts, round(s.value, 6) AS value, round(lev + (s.pos - n) * trd, 6) AS predicted, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper
          FROM s JOIN z ON z.series = s.series WHERE s.pos > s.n_train
        UNION ALL SELECT z.series, 'baseline', 'future', CAST(i AS BIGINT), (SELECT max(ts) FROM s WHERE s.series = z.series) + to_days(i::INTEGER), NULL, round(lev + (z.n_total - n + i) * trd, 6),
          round(lev + (z.n_total - n + i) * trd - 1.96::DOUBLE * sigma * sqrt(1 + 0.05::DOUBLE * i), 6), round(lev + (z.n_total - n + i) * trd + 1.96::DOUBLE * sigma * sqrt(1 + 0.05::DOUBLE * i), 6)
          FROM z, (SELECT unnest(range(1, {HORIZON + 1})) AS i) y""",
    "harmonic_sums": f"WITH {SPLIT_SQL}, k AS (SELECT *, (pos - 1)::DOUBLE AS k FROM s WHERE pos <= n_train) SELECT series, count(*) AS f_train, max(n_total) AS f_total, {_SUMS} FROM k GROUP BY 1",
    "forecast_metrics": f"WITH {_NAIVE} SELECT series, model, n, round(mae, 4) AS mae, round(mse, 4) AS mse, round(rmse, 4) AS rmse, round(mape, 4) AS mape, round(smape, 4) AS smape FROM mt",
    "forecast_best_model": f"WITH {_NAIVE} SELECT series, arg_min(model, round(rmse, 4)) AS best_model FROM mt GROUP BY 1",
}
