"""Positions in a total order over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .durable import durable

ONE_TASK_ROWS = 500_000


def positions(df: DataFrame, order: list[str], out: str, rows: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Adds the 0-based position of each row in the order of the given columns (which must be unique).

    ``rows`` is the known size. Small tables take one window. Larger ones are range-partitioned, which splits
    any value that many rows share, numbered inside their partition, written once, and shifted by the sizes
    of the partitions before (one row per partition, so a bounded broadcast).
    """
    if rows <= one_task_rows:
        return df.withColumn(out, (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = durable(
        spread.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    )
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first")).orderBy("_part").collect()
    before, start = {}, 0
    for r in sizes:
        before[r["_part"]] = start - r["_first"]
        start += r["_n"]
    shift = df.sparkSession.createDataFrame(list(before.items()), "_part int, _shift long")
    return (
        numbered.join(F.broadcast(shift), "_part")
        .withColumn(out, F.col("_seq") + F.col("_shift"))
        .drop("_part", "_seq", "_shift")
    )


def hash_positions(df: DataFrame, group: list[str], digest: Column, out: str, tie: list[str]) -> DataFrame:
    """Adds position and group size in the order of a hex digest inside each group.

    A digest is evenly spread, so its first characters cut even the largest group into equal buckets: the
    window sorts one bucket, and the sizes of the buckets before it come from a small count table.
    """
    d = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 3))
    counts = d.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(g).alias(f"_o_{g}") for g in group], F.col("_bucket").alias("_o_bucket"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(*group)).alias(f"{out}_size"),
    )
    inner = W.partitionBy(*group, "_bucket").orderBy("_digest", *tie)
    numbered = d.withColumn("_row", F.row_number().over(inner))
    match = [F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in group] + [F.col("_bucket") == F.col("_o_bucket")]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return (
        numbered.join(offsets, cond)
        .withColumn(out, (F.col("_before") + F.col("_row") - 1).cast("long"))
        .drop("_digest", "_bucket", "_row", "_before", "_o_bucket", *[f"_o_{g}" for g in group])
    )


def ranked_counts(counts: DataFrame, value: str, n: str, cuts: list[float]) -> DataFrame:
    """Adds ``avg_rank`` (1-based, ties share their mean) to a table of distinct numeric values and counts.

    ``cuts`` split the value range; cumulative counts run inside one slice and the slices before it add a
    bounded broadcast offset.
    """
    from pyspark.ml.feature import Bucketizer

    inner = sorted(set(c for c in cuts if c is not None))
    if not inner:
        w = W.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum(n).over(w), F.lit(0))
        return counts.withColumn("avg_rank", ahead + (F.col(n) + 1) / 2.0)
    splits = [float("-inf"), *inner, float("inf")]
    sliced = Bucketizer(splits=splits, inputCol=value, outputCol="_slice").transform(counts)
    sums = sliced.groupBy("_slice").agg(F.sum(n).alias("_in"))
    offsets = sums.select("_slice", F.coalesce(F.sum("_in").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = W.partitionBy("_slice").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(n).over(w), F.lit(0))
    return (
        sliced.withColumn("_ahead", ahead).join(F.broadcast(offsets), "_slice")
        .withColumn("avg_rank", F.col("_before") + F.col("_ahead") + (F.col(n) + 1) / 2.0)
        .drop("_slice", "_ahead", "_before")
    )


def slice_cuts(df: DataFrame, columns: dict[str, Column], rows: int, per_slice: int = 1_000_000) -> dict[str, list[float]]:
    """Values that cut each column into slices of about ``per_slice`` rows; none for small tables."""
    slices = min(1000, rows // per_slice)
    if slices < 2:
        return {c: [] for c in columns}
    at = [i / slices for i in range(1, slices)]
    row = df.agg(*[F.percentile_approx(x, F.array(*map(F.lit, at)), 10_000).alias(f"c{i}") for i, x in enumerate(columns.values())]).first()
    return {c: list(row[i] or []) for i, c in enumerate(columns)}


def average_ranks(df: DataFrame, columns: list[str], rows: int, per_slice: int = 1_000_000) -> DataFrame:
    """Replaces each (non-null, numeric) column by its average rank.

    Ranks come from value counts, so ties are combined before any sort; they return to the rows by a join in
    which the few very frequent values are salted.
    """
    from .joins import frequent_values, lookup_join

    cuts = slice_cuts(df, {c: F.col(c) for c in columns}, rows, per_slice)
    out = df
    for c in columns:
        counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        ranks = ranked_counts(counts, c, "_n", cuts[c]).select(c, F.col("avg_rank").alias(f"_rank_{c}"))
        hot = frequent_values(counts, c, "_n", rows) if rows > per_slice else []
        out = lookup_join(out, ranks, c, hot)
    return out.select(*[F.col(f"_rank_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
