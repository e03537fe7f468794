"""Joins that stay even when one key fills a large part of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import ref

HOT_SHARE = 0.005
TASK_ROWS = 2_000_000
SALTS = 64
#: Narrow tables of up to so many rows are broadcast (tens of MB at most).
FEW_ROWS = 100_000


def frequent_values(counts: DataFrame, key: str, n: str, rows: int, share: float = HOT_SHARE) -> list:
    """Values that hold more than ``share`` of the rows: at most 1 / share of them.

    What a rarer value holds fits one task: more than ``TASK_ROWS`` rows under a smaller share still count as frequent,
    down to a thousandth of the usual share, which bounds the list whatever the table holds.
    """
    least = max(min(rows * share, TASK_ROWS), rows * share / 1000)
    return [r[0] for r in counts.where((F.col(n) > least) & F.col(key).isNotNull()).select(key).collect()]


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, hot: list, salts: int = SALTS) -> DataFrame:
    """Left join to a lookup with unique keys.

    Rows of frequent (or null) keys are spread over salts and the few matching lookup rows are repeated per
    salt. Small lookups are broadcast by adaptive execution, which knows their size.
    """
    spread = F.col(key).isNull() | F.col(key).isin(hot) if hot else F.col(key).isNull()
    left = df.withColumn("_salt", F.when(spread, F.pmod(F.xxhash64(*[ref(c) for c in df.columns]), F.lit(salts)).cast("int")).otherwise(0))
    once = F.array(F.lit(0))
    repeat = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(once) if hot else once
    right = lookup.withColumn("_salt", F.explode(repeat))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def join_few(df: DataFrame, facts: DataFrame, on: str, how: str = "inner", few: int = FEW_ROWS) -> DataFrame:
    """Join to a narrow written table with unique keys: rows are not moved while it is counted to be small.

    Beyond that adaptive execution splits the partitions of a frequent key; facts should be cheap to read twice.
    """
    small = facts.limit(few + 1).count() <= few
    return df.join(F.broadcast(facts) if small else facts, on, how)
