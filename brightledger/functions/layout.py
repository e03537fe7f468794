"""How many partitions a step should run on."""

from __future__ import annotations

from pyspark.sql import DataFrame


def compact(df: DataFrame, rows: int | None = None, rows_per_task: int = 50_000) -> DataFrame:
    """Partitions by the number of rows for iterative fits; a table that has no more than that keeps its own.

    Every task of every iteration tells the driver about itself and hands on statistics of its own, so a table in many
    small partitions costs more than in a few large ones. Where there are several for each core, they grow to ten times the rows.
    """
    rows = df.count() if rows is None else rows
    parts, busy = rows // rows_per_task + 1, 3 * df.sparkSession.sparkContext.defaultParallelism
    if parts > busy:
        parts = max(busy, rows // (10 * rows_per_task) + 1)
    return df.coalesce(int(parts))


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core before a CPU-bound step.

    Only an input with fewer partitions than cores is redistributed; a large input already has many and is
    left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
