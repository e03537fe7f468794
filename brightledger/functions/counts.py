"""Value counts of many columns in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import plain, ref


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return dtype.simpleString()
    return "string"


def value_counts(df: DataFrame, columns: list[str], nulls: bool = False) -> DataFrame:
    """(column_name, value as text, n): one row per distinct value of each column.

    Columns of one type family share one scan and one shuffle; the counts are combined on the map side, so a
    value that fills a third of the table travels as one row per map task. Values turn into text only after
    they have been counted.
    """
    flat = plain(df.select(*[ref(c) for c in columns]))
    families: dict[str, list[str]] = {}
    for c in columns:
        families.setdefault(_family(flat.schema[c].dataType), []).append(c)
    parts = []
    for family, names in families.items():
        long = flat.select(F.inline(F.array(*[
            F.struct(F.lit(n).alias("column_name"), ref(n).cast(family).alias("value")) for n in names
        ])))
        if not nulls:
            long = long.where(F.col("value").isNotNull())
        parts.append(
            long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
            .select("column_name", F.col("value").cast("string").alias("value"), "n")
        )
    return reduce(DataFrame.unionAll, parts)


def count_summary(counts: DataFrame) -> DataFrame:
    """Per column: distinct values, non-null rows, the most frequent value (ties: smallest) and its count."""
    return counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_count"),
        F.sum("n").alias("filled"),
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("top_value"),
        F.max("n").alias("top_freq"),
    )
