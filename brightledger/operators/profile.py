"""Table profile, quality warnings and quality score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import (
    CATEGORICAL, DATETIME, IDENTIFIER, NUMERICAL, column_kinds, has_id_name, plain, ref, rows_table,
)
from ..functions.counts import count_summary, value_counts

HIGH_MISSING_PCT, SEVERE_MISSING_PCT = 20.0, 50.0
DUPLICATE_CRITICAL_PCT = 10.0
HIGH_CARDINALITY = 50
SAMPLE_VALUES = 5

WARNING_SCHEMA = "severity string, code string, column_name string, message string"


def cell_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, missing cells and their share in percent. One scan, no row shuffle."""
    width = len(df.columns)
    missing = F.lit(0)
    for c in df.columns:
        missing = missing + F.sum(ref(c).isNull().cast("long"))
    base = df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(missing, F.lit(0)).cast("long").alias("missing_cells"))
    cells = F.col("row_count") * width
    return base.select(
        "row_count", F.lit(width).alias("column_count"), cells.alias("total_cells"), "missing_cells",
        F.coalesce(F.round(F.try_divide(F.col("missing_cells") * 100.0, cells), 2), F.lit(0.0)).alias("missing_pct"),
    )


def duplicate_summary(df: DataFrame) -> DataFrame:
    """One row: copies beyond the first of each distinct row (nulls equal) and their share in percent."""
    flat = plain(df)
    groups = flat.groupBy(*[ref(c) for c in flat.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    rows, extra = F.coalesce(F.sum("_copies"), F.lit(0)), F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0))
    return groups.agg(rows.alias("row_count"), extra.alias("duplicate_rows")).select(
        "row_count", "duplicate_rows",
        F.coalesce(F.round(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("row_count")), 2), F.lit(0.0)).alias("duplicate_pct"),
    )


def missing_by_column(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Missing count and percentage of every column, from one wide aggregate."""
    wide = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count(ref(c)).alias(f"f{i}") for i, c in enumerate(df.columns)])
    out = rows_table(wide, [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col("row_count"),
            (F.col("row_count") - F.col(f"f{i}")).alias("missing_count"),
            F.coalesce(F.round(F.try_divide((F.col("row_count") - F.col(f"f{i}")) * 100.0, F.col("row_count")), 2), F.lit(0.0)).alias("missing_pct"),
        )
        for i, c in enumerate(df.columns)
    ])
    return out.where("missing_count > 0") if only_missing else out


def distinct_by_column(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column and their ratio to the rows (4 decimals).

    Exact counts shuffle each column's distinct values once. ``approximate=True`` answers from fixed-size
    sketches in a single scan instead.
    """
    if approximate:
        flat = plain(df)
        wide = flat.agg(F.count(F.lit(1)).alias("row_count"), *[F.approx_count_distinct(ref(c)).alias(f"d{i}") for i, c in enumerate(flat.columns)])
        counted = rows_table(wide, [
            F.struct(F.lit(c).alias("column_name"), F.col("row_count"), F.col(f"d{i}").alias("distinct_count"))
            for i, c in enumerate(flat.columns)
        ])
    else:
        found = count_summary(value_counts(df, df.columns)).select("column_name", "distinct_count")
        counted = (
            missing_by_column(df).select("column_name", "row_count").join(found, "column_name", "left")
            .withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("long")))
        )
    return counted.select(
        "column_name", "distinct_count",
        F.coalesce(F.round(F.try_divide(F.col("distinct_count"), F.col("row_count")), 4), F.lit(0.0)).alias("distinct_ratio"),
    )


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, kind, missing, distinct, constant flag, identifier flag."""
    kinds = column_kinds(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    named = df.sparkSession.createDataFrame(
        [(c, types[c], kinds[c], has_id_name(c)) for c in df.columns],
        "column_name string, data_type string, kind string, id_name boolean",
    )
    base = (
        missing_by_column(df)
        .join(distinct_by_column(df, approximate), "column_name")
        .join(named, "column_name")
    )
    unique = (F.col("row_count") > 1) & (F.col("missing_count") == 0) & (F.col("distinct_count") == F.col("row_count"))
    return base.select(
        "position", "column_name", "data_type",
        F.when(unique & F.col("id_name"), IDENTIFIER).otherwise(F.col("kind")).alias("inferred_type"),
        "row_count", "missing_count", "missing_pct", "distinct_count", "distinct_ratio",
        (F.col("distinct_count") <= 1).alias("is_constant"),
        (unique & F.col("id_name")).alias("is_potential_id"),
    )


def sample_values(df: DataFrame, k: int = SAMPLE_VALUES) -> DataFrame:
    """Up to ``k`` smallest distinct values of each column, as text.

    The ``row_number`` filter is applied per map task before the shuffle (window group limit).
    """
    w = W.partitionBy("column_name").orderBy("value")
    return (
        value_counts(df, df.columns)
        .select("column_name", "value", F.row_number().over(w).alias("position"))
        .where(F.col("position") <= k)
    )


def columns_by_kind(profile: DataFrame) -> DataFrame:
    """One row: the column names of each kind and the constant ones, in table order."""
    def listed(cond):
        ordered = F.sort_array(F.collect_list(F.when(cond, F.struct("position", "column_name"))))
        return F.transform(ordered, lambda s: s["column_name"])
    kind = F.col("inferred_type")
    return profile.agg(
        listed(kind == NUMERICAL).alias("numerical_columns"),
        listed(kind.isin(CATEGORICAL, "boolean")).alias("categorical_columns"),
        listed(kind == DATETIME).alias("datetime_columns"),
        listed(kind == IDENTIFIER).alias("potential_id_columns"),
        listed(F.col("is_constant")).alias("constant_columns"),
    )


def quality_warnings(df: DataFrame, profile: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """Warning rows (severity, code, column, message)."""
    profile = column_profile(df) if profile is None else profile
    duplicates = duplicate_summary(df) if duplicates is None else duplicates
    name = F.col("column_name")
    rules = F.array(
        F.when(F.col("row_count") > 0, F.when(F.col("is_constant"), F.struct(
            F.lit("WARNING").alias("severity"), F.lit("CONSTANT_COLUMN").alias("code"), name.alias("column_name"),
            F.format_string("%s holds %d distinct value(s)", name, F.col("distinct_count")).alias("message"),
        ))),
        F.when(F.col("row_count") > 0, F.when(F.col("missing_pct") >= HIGH_MISSING_PCT, F.struct(
            F.when(F.col("missing_pct") >= SEVERE_MISSING_PCT, "CRITICAL").otherwise("WARNING").alias("severity"),
            F.lit("HIGH_MISSINGNESS").alias("code"), name.alias("column_name"),
            F.format_string("%s lacks %.2f%% of its values", name, F.col("missing_pct")).alias("message"),
        ))),
        F.when((F.col("inferred_type") == CATEGORICAL) & (F.col("distinct_count") > HIGH_CARDINALITY), F.struct(
            F.lit("INFO").alias("severity"), F.lit("HIGH_CARDINALITY").alias("code"), name.alias("column_name"),
            F.format_string("%s has %d categories", name, F.col("distinct_count")).alias("message"),
        )),
    )
    by_column = profile.select(F.inline(F.filter(rules, lambda r: r.isNotNull())))
    whole = duplicates.select(F.inline(F.filter(F.array(
        F.when(F.col("row_count") == 0, F.struct(
            F.lit("CRITICAL").alias("severity"), F.lit("EMPTY_DATASET").alias("code"), F.lit(None).cast("string").alias("column_name"),
            F.lit("the table has no rows").alias("message"),
        )),
        F.when(F.col("duplicate_rows") > 0, F.struct(
            F.when(F.col("duplicate_pct") < DUPLICATE_CRITICAL_PCT, "WARNING").otherwise("CRITICAL").alias("severity"),
            F.lit("DUPLICATE_ROWS").alias("code"), F.lit(None).cast("string").alias("column_name"),
            F.format_string("%d rows repeat another row (%.2f%%)", F.col("duplicate_rows"), F.col("duplicate_pct")).alias("message"),
        )),
    ), lambda r: r.isNotNull())))
    return whole.unionByName(by_column)


def quality_score(df: DataFrame, profile: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """One row with the score (0-100) and what it was built from; an empty table scores 0."""
    profile = column_profile(df) if profile is None else profile
    duplicates = duplicate_summary(df) if duplicates is None else duplicates
    is_warning = (F.col("missing_pct") >= HIGH_MISSING_PCT) & (F.col("missing_pct") < SEVERE_MISSING_PCT)
    parts = profile.agg(
        F.count(F.lit(1)).alias("column_count"),
        F.sum("row_count").alias("total_cells"),
        F.sum("missing_count").alias("missing_cells"),
        F.count_if("is_constant").alias("constant_columns"),
        F.count_if(F.col("missing_pct") >= SEVERE_MISSING_PCT).alias("column_critical"),
        (F.count_if("is_constant") + F.count_if(is_warning)).alias("column_warnings"),
    )
    # Two one-row tables side by side, without a join.
    stacked = parts.unionByName(duplicates, allowMissingColumns=True)
    both = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    repeated = F.col("duplicate_rows") > 0
    severe = repeated & (F.col("duplicate_pct") >= DUPLICATE_CRITICAL_PCT)
    critical = F.col("column_critical") + F.when(severe, 1).otherwise(0)
    warnings = F.col("column_warnings") + F.when(repeated & ~severe, 1).otherwise(0)
    score = (
        F.lit(100.0)
        - F.least(F.lit(40.0), F.try_divide(F.col("missing_cells") * 150.0, F.col("total_cells")))
        - F.least(F.lit(25.0), F.col("duplicate_pct"))
        - F.least(F.lit(15.0), F.try_divide(F.col("constant_columns") * 50.0, F.col("column_count")))
        - critical * 10.0 - warnings * 3.0
    )
    return both.select(
        "row_count", F.col("column_count"), "missing_cells", "duplicate_rows", "constant_columns",
        critical.cast("long").alias("critical_count"), warnings.cast("long").alias("warning_count"),
        F.when(F.col("row_count") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.round(score, 1))).alias("quality_score"),
    )


def validate(df: DataFrame) -> dict[str, DataFrame]:
    """All profile tables of one input."""
    profile, duplicates = column_profile(df), duplicate_summary(df)
    return {
        "summary": cell_summary(df),
        "duplicates": duplicates,
        "profile": profile,
        "samples": sample_values(df),
        "kinds": columns_by_kind(profile),
        "warnings": quality_warnings(df, profile, duplicates),
        "score": quality_score(df, profile, duplicates),
    }
