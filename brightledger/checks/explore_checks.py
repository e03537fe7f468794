"""Exploratory analysis queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import explore as E
from .views import DIRTY_SQL, ITEMS_SQL, dirty_orders, items, table

NUMBERS = ["quantity", "price", "price_twin", "discount", "tax"]
CATS = ["priority", "status", "flag", "near_flag", "code_text"]


def _stats_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(coalesce(stddev_samp({c}), 0), 4) AS std, round(min({c})::DOUBLE, 4) AS min,"
        f" round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75,"
        f" round(max({c})::DOUBLE, 4) AS max, round(coalesce(skewness({c}), 0), 4) AS skewness, round(coalesce(kurtosis({c}), 0), 4) AS kurtosis,"
        f" count(*) - count({c}) AS missing_count, count(*) FILTER (WHERE {c} = 0) AS zero_count FROM d"
    )


def _cat_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, CAST(sum(n) FILTER (WHERE value IS NOT NULL) AS BIGINT) AS n, count(value) AS distinct_count,"
        f" (SELECT value FROM v_{c} WHERE value IS NOT NULL ORDER BY n DESC, value LIMIT 1) AS top_value,"
        f" max(n) FILTER (WHERE value IS NOT NULL) AS top_freq,"
        f" round((max(n) FILTER (WHERE value IS NOT NULL))::DOUBLE / sum(n) FILTER (WHERE value IS NOT NULL), 4) AS top_ratio,"
        f" CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS missing_count FROM v_{c}"
    )


_CAT_WITH = f"WITH d AS {DIRTY_SQL}, " + ", ".join(f"v_{c} AS (SELECT {c} AS value, count(*) AS n FROM d GROUP BY 1)" for c in CATS)
_ITEM_WITH = f"WITH d AS {ITEMS_SQL}"
_FULL = f"{_ITEM_WITH}, full_rows AS (SELECT * FROM d WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in NUMBERS) + ")"
_RANKED = _FULL + ", k AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in NUMBERS) + " FROM full_rows)"


def _matrix_sql(source: str, name: str) -> str:
    one = [f"SELECT '{c}' AS feature1, '{c}' AS feature2, 1.0::DOUBLE AS {name}" for c in NUMBERS]
    for a, b in combinations(NUMBERS, 2):
        one.append(f"SELECT '{a}', '{b}', round(corr({a}, {b}), 4) FROM {source}")
        one.append(f"SELECT '{b}', '{a}', round(corr({a}, {b}), 4) FROM {source}")
    return " UNION ALL ".join(one)


def _outlier_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, (SELECT count(*) FROM d WHERE {c} < lo OR {c} > hi) AS iqr_outliers,"
        f" (SELECT count(*) FROM d WHERE abs(({c} - m) / s) > 3.0) AS zscore_outliers, round(lo, 4) AS iqr_lower_bound, round(hi, 4) AS iqr_upper_bound,"
        f" round(m - 3 * s, 4) AS zscore_lower_bound, round(m + 3 * s, 4) AS zscore_upper_bound FROM ("
        f"SELECT quantile_cont({c}::DOUBLE, 0.25) - 1.5::DOUBLE * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) AS lo,"
        f" quantile_cont({c}::DOUBLE, 0.75) + 1.5::DOUBLE * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) AS hi, avg({c}) AS m, stddev_samp({c}) AS s FROM d) z"
    )


_TREND_COLS = ["quantity", "price", "discount"]
_DAILY = f"""{_ITEM_WITH}, days AS (SELECT CAST(shipdate AS DATE) AS bucket, {', '.join(f'avg({c}) AS {c}' for c in _TREND_COLS)} FROM d GROUP BY 1),
  kept AS (SELECT * FROM days WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _TREND_COLS)})"""
_TREND_BODY = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS points, CASE WHEN regr_slope({c}, x) > 0.01 THEN 'UPWARD' WHEN regr_slope({c}, x) < -0.01 THEN 'DOWNWARD' ELSE 'STABLE' END AS direction,"
    f" round(regr_slope({c}, x), 4) AS slope, round(regr_r2({c}, x), 4) AS r_squared, min(bucket) AS min_date, max(bucket) AS max_date FROM ix" for c in _TREND_COLS)
_TRENDS = f"{_DAILY}, ix AS (SELECT *, CAST(row_number() OVER (ORDER BY bucket) - 1 AS DOUBLE) AS x FROM kept)"
_FEATURES = [c for c in NUMBERS if c != "price"]


def _insights(s, d):
    t, o = items(s, d), dirty_orders(s, d)
    numeric = E.numeric_stats(t, NUMBERS).unionByName(E.numeric_stats(o, ["customer", "amount"]))
    pairs = E.top_correlation_pairs(E.pearson_matrix(t, NUMBERS), E.spearman_matrix(t, NUMBERS))
    rows = t.count()
    found = E.eda_insights(rows, numeric, E.categorical_stats(o, CATS), pairs, E.outlier_analysis(t, NUMBERS),
                           E.time_trends(t, "shipdate", _TREND_COLS), "price", E.target_correlations(t, "price", NUMBERS))
    return found.select("category", "severity", F.concat_ws(",", "affected_columns").alias("affected_columns"))


def _pairs(s, d):
    t = items(s, d)
    return E.top_correlation_pairs(E.pearson_matrix(t, NUMBERS), E.spearman_matrix(t, NUMBERS))


_PAIR_SQL = f"""p AS ({_matrix_sql('full_rows', 'pearson')}), sp AS ({_matrix_sql('k', 'spearman')}),
  tp AS (SELECT p.feature1, p.feature2, pearson, spearman, round(abs(pearson), 4) AS abs_pearson FROM p JOIN sp ON p.feature1 = sp.feature1 AND p.feature2 = sp.feature2
         WHERE p.feature1 < p.feature2 ORDER BY abs_pearson DESC, 1, 2 LIMIT 15)"""

QUERIES = {
    "numeric_stats": lambda s, d: E.numeric_stats(items(s, d), NUMBERS),
    "categorical_stats": lambda s, d: E.categorical_stats(dirty_orders(s, d), CATS),
    "category_frequencies": lambda s, d: E.category_frequencies(dirty_orders(s, d), CATS),
    "pearson_matrix": lambda s, d: E.pearson_matrix(items(s, d), NUMBERS),
    "spearman_matrix": lambda s, d: E.spearman_matrix(items(s, d), NUMBERS),
    "top_correlation_pairs": _pairs,
    "outlier_analysis": lambda s, d: E.outlier_analysis(items(s, d), NUMBERS),
    "daily_means": lambda s, d: E.daily_means(items(s, d), "shipdate", _TREND_COLS).select("bucket", *[F.round(c, 7).alias(c) for c in _TREND_COLS]),
    "time_trends": lambda s, d: E.time_trends(items(s, d), "shipdate", _TREND_COLS),
    "target_class_distribution": lambda s, d: E.target_class_distribution(dirty_orders(s, d), "priority"),
    "target_correlations": lambda s, d: E.target_correlations(items(s, d), "price", NUMBERS),
    "histogram_bins": lambda s, d: E.histogram_bins(items(s, d), "price"),
    "box_by_class": lambda s, d: E.box_by_class(items(s, d), "returnflag", "price"),
    "target_ols_line": lambda s, d: E.target_ols_line(items(s, d), "quantity", "price"),
    "describe_all": lambda s, d: E.describe_all(dirty_orders(s, d).select("amount", "status", "ordered_at")),
    "eda_insights": _insights,
}

ORACLES = {
    "numeric_stats": f"{_ITEM_WITH} " + " UNION ALL ".join(_stats_sql(c) for c in NUMBERS),
    "categorical_stats": f"{_CAT_WITH} " + " UNION ALL ".join(_cat_sql(c) for c in CATS),
    "category_frequencies": f"{_CAT_WITH} SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank FROM v_{c} WHERE value IS NOT NULL" for c in CATS) + ") z WHERE rank <= 10",
    "pearson_matrix": f"{_FULL} {_matrix_sql('full_rows', 'pearson')}",
    "spearman_matrix": f"{_RANKED} {_matrix_sql('k', 'spearman')}",
    "top_correlation_pairs": f"{_RANKED}, {_PAIR_SQL} SELECT * FROM tp",
    "outlier_analysis": f"{_ITEM_WITH} " + " UNION ALL ".join(_outlier_sql(c) for c in NUMBERS),
    "daily_means": f"{_DAILY} SELECT bucket, {', '.join(f'round({c}, 7) AS {c}' for c in _TREND_COLS)} FROM kept",
    "time_trends": f"{_TRENDS} {_TREND_BODY}",
    "target_class_distribution": f"WITH d AS {DIRTY_SQL} SELECT priority AS class, count(*) AS n FROM d WHERE priority IS NOT NULL GROUP BY 1",
    "target_correlations": f"{_ITEM_WITH} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(corr({c}, price), 4) AS correlation FROM d" for c in _FEATURES),
    "histogram_bins": f"""{_ITEM_WITH}, b AS (SELECT min(price) AS lo, (max(price) - min(price)) / 20 AS w FROM d),
        h AS (SELECT CAST(least(floor((price - lo) / w), 19) AS INTEGER) AS bin, count(*) AS n FROM d, b WHERE price IS NOT NULL GROUP BY 1)
        SELECT bin, round(lo + bin * w, 4) AS lower, round(lo + (bin + 1) * w, 4) AS upper, n FROM h, b""",
    "box_by_class": f"""{_ITEM_WITH}, q AS (SELECT returnflag AS class, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q75 FROM d GROUP BY 1)
        SELECT class, count(*) AS n, round(min(price) FILTER (WHERE price >= q25 - 1.5::DOUBLE * (q75 - q25) AND price <= q75 + 1.5::DOUBLE * (q75 - q25)), 4) AS lower_whisker, round(q25, 4) AS q25, round(median, 4) AS median, round(q75, 4) AS q75,
               round(max(price) FILTER (WHERE price >= q25 - 1.5::DOUBLE * (q75 - q25) AND price <= q75 + 1.5::DOUBLE * (q75 - q25)), 4) AS upper_whisker
        FROM d JOIN q ON q.class = d.returnflag GROUP BY class, q25, median, q75""",
    "target_ols_line": f"""{_ITEM_WITH} SELECT round(regr_slope(price, quantity), 4) AS slope, round(regr_intercept(price, quantity), 4) AS intercept, round(regr_r2(price, quantity), 4) AS r_squared,
        CAST(regr_count(price, quantity) AS BIGINT) AS n FROM d""",
    "describe_all": f"""WITH d AS {DIRTY_SQL}, a AS ({_stats_sql('amount')})
        SELECT column_name, n, NULL::BIGINT AS distinct_count, NULL::VARCHAR AS top_value, NULL::BIGINT AS top_freq, mean, std, min, q25, median, q75, max, NULL::VARCHAR AS first_date, NULL::VARCHAR AS last_date FROM a
        UNION ALL SELECT 'status', count(status), count(DISTINCT status), (SELECT status FROM d GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), (SELECT max(n) FROM (SELECT count(*) AS n FROM d GROUP BY status) z),
          NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM d
        UNION ALL SELECT 'ordered_at', count(ordered_at), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CAST(min(ordered_at) AS VARCHAR), CAST(max(ordered_at) AS VARCHAR) FROM d""",
    "eda_insights": f"""{_RANKED}, {_PAIR_SQL}, o AS {DIRTY_SQL}, n AS (SELECT count(*) AS rows FROM d),
        num AS ({' UNION ALL '.join(_stats_sql(c) for c in NUMBERS)} UNION ALL {' UNION ALL '.join(_stats_sql(c).replace('FROM d', 'FROM o') for c in ('customer', 'amount'))}),
        {', '.join(f"v_{c} AS (SELECT {c} AS value, count(*) AS n FROM o GROUP BY 1)" for c in CATS)}, cat AS ({' UNION ALL '.join(_cat_sql(c) for c in CATS)}),
        outl AS ({' UNION ALL '.join(_outlier_sql(c) for c in NUMBERS)}),
        days AS (SELECT CAST(shipdate AS DATE) AS bucket, {', '.join(f'avg({c}) AS {c}' for c in _TREND_COLS)} FROM d GROUP BY 1),
        ix AS (SELECT *, CAST(row_number() OVER (ORDER BY bucket) - 1 AS DOUBLE) AS x FROM days WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _TREND_COLS)}),
        tr AS ({_TREND_BODY}), tc AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, round(corr({c}, price), 4) AS r FROM d" for c in _FEATURES)})
        SELECT 'MISSINGNESS' AS category, CASE WHEN missing_count * 100.0::DOUBLE / rows >= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, column_name AS affected_columns FROM num, n WHERE missing_count * 100.0::DOUBLE / rows >= 20
        UNION ALL SELECT 'CORRELATION', CASE WHEN abs_pearson >= 0.90 THEN 'HIGH' ELSE 'MEDIUM' END, feature1 || ',' || feature2 FROM tp WHERE abs_pearson >= 0.75
        UNION ALL SELECT 'CATEGORICAL', CASE WHEN top_ratio >= 0.85 THEN 'MEDIUM' ELSE 'INFO' END, column_name FROM cat WHERE top_ratio >= 0.70 AND distinct_count > 1
        UNION ALL SELECT 'DISTRIBUTION', 'MEDIUM', column_name FROM num WHERE abs(skewness) >= 1.5
        UNION ALL SELECT 'OUTLIER', CASE WHEN iqr_outliers * 100.0::DOUBLE / rows >= 15 THEN 'HIGH' ELSE 'MEDIUM' END, column_name FROM outl, n WHERE iqr_outliers * 100.0::DOUBLE / rows >= 5
        UNION ALL SELECT 'TEMPORAL', CASE WHEN r_squared >= 0.70 THEN 'HIGH' ELSE 'MEDIUM' END, column_name FROM tr WHERE direction <> 'STABLE' AND r_squared >= 0.40
        UNION ALL SELECT 'TARGET', 'HIGH', column_name || ',price' FROM (SELECT * FROM tc ORDER BY abs(r) DESC, column_name LIMIT 3) z WHERE abs(r) >= 0.40""",
}
