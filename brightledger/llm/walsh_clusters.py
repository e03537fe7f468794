"""Centroid clustering with exact integers, searched progressively in the Walsh-Hadamard domain.

A vector's components become integers, floor(SCALE * x). Vectors and centroids are transformed by the exact integer
Walsh-Hadamard transform, coefficients ordered by their number of sign changes: sums of squared differences over all 64
coefficients are 64 times the squared distance, and those over the first ones, coarse before fine, are lower bounds. For
every vector the centroid that looks nearest after the first step is finished at once; step by step the coefficients of the
others are added, and a centroid is left out as soon as its part alone exceeds the best distance known. What is
left gets all 64, so the nearest centroid is exact; ties go to the smaller number.

Centroids start as the vectors of smallest SHA-256 of `1:<key>`, move to the componentwise floor of their members' means,
and stay where they have no member. The driver holds centroids and their sums only, at most 16 x 64 numbers a round;
sums combine before they are shuffled, so it does not matter how many vectors a cluster has.

Only vectors of exactly 64 components are kept, none of them null, NaN or infinite, and none beyond the range in which
floor(SCALE * x) is below 2 ** 62. Vectors with integers above 2 ** 20 are compared with unbounded integers; a distance or
inertia that no long can hold is null. Repeated rows count each; a null key reads as an empty text. Fewer vectors than
centroids give fewer centroids, an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .durable import table

SIZE, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
STEPS = (4, 8, 16, 32, 64)
_NARROW, _WIDE = 1 << 20, 1 << 62


def transform(vectors: np.ndarray) -> np.ndarray:
    """Exact Walsh-Hadamard coefficients of rows of integers, those with fewer sign changes first."""
    out, n = vectors, vectors.shape[1]
    width = 1
    while width < n:
        pairs = out.reshape(len(out), n // (2 * width), 2, width)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), n)
        width *= 2
    return out[:, sequency(n)]


def sequency(n: int) -> np.ndarray:
    """Natural indices of the Walsh functions by their number of sign changes: bit-reversed Gray code."""
    bits = n.bit_length() - 1
    return np.array([int(format(i ^ i >> 1, f"0{bits}b")[::-1], 2) if bits else 0 for i in range(n)])


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of every row; both are exact integers."""
    n = len(vectors)
    size = vectors.shape[1]
    v, c = transform(vectors), transform(centroids)
    first = STEPS[0]
    part = ((v[:, None, :first] - c[None, :, :first]) ** 2).sum(2)
    guess = part.argmin(1)
    best = part[np.arange(n), guess] + ((v[:, first:] - c[guess, first:]) ** 2).sum(1)
    row, number = np.nonzero(part <= best[:, None])
    part = part[row, number]
    for low, high in zip(STEPS, STEPS[1:]):
        part = part + ((v[row, low:high] - c[number, low:high]) ** 2).sum(1)
        alive = part <= best[row]
        row, number, part = row[alive], number[alive], part[alive]
    # The guess itself is never left out, so every row has a centroid; rows and numbers ascend.
    start = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(part, start)
    at = np.flatnonzero(part == least[row])
    chosen = at[np.searchsorted(row[at], np.arange(n))]
    return number[chosen], part[chosen] // size


def _exact(values: np.ndarray) -> np.ndarray:
    return values if not values.size or max(int(values.max()), -int(values.min())) <= _NARROW else values.astype(object)


def _assigned(batch: pa.RecordBatch, centroids: list[list[int]]):
    rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, SIZE)
    wide = any(abs(x) > _NARROW for c in centroids for x in c)
    rows, fixed = _exact(rows), np.array(centroids, object)
    if wide or rows.dtype == object:
        return rows.astype(object), *nearest(rows.astype(object), fixed)
    return rows, *nearest(rows, fixed.astype(np.int64))


def integer_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key and v, the integers, of the vectors that are kept."""
    scaled = F.transform(F.col(column), lambda x: SCALE * x.cast("double"))
    fits = (F.size(column) == SIZE) & F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < _WIDE), F.lit(False)))
    return vectors.where(fits).select(F.col(key).alias("key"), F.transform(scaled, lambda x: F.floor(x)).alias("v"))


def first_centroids(kept: DataFrame, count: int = CENTROIDS) -> list[list[int]]:
    """The vectors whose keys have the smallest digests; ties by components."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return [r["v"] for r in kept.select(digest.alias("h"), "v").orderBy("h", "v").limit(count).collect()]


def next_centroids(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the means of every centroid's members."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                rows, number, _ = _assigned(b, centroids)
                some = np.unique(number)
                sums = [int(s) for k in some for s in rows[number == k].sum(0)]
                columns = [np.repeat(some, SIZE), np.tile(np.arange(SIZE), len(some)), np.repeat([int((number == k).sum()) for k in some], SIZE)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(sums, pa.decimal128(38))], ["k", "i", "n", "s"])

    parts = kept.mapInArrow(run, "k long, i long, n long, s decimal(38,0)").groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [list(c) for c in centroids]
    for r in parts.collect():
        out[r["k"]][r["i"]] = int(r["s"]) // r["n"]
    return out


def assign(kept: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """key, cluster and distance (decimal) of every vector."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                _, number, apart = _assigned(b, centroids)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(number.astype(np.int32)), pa.array([int(x) for x in apart], pa.decimal128(38))], ["key", "cluster", "distance"])

    return kept.mapInArrow(run, f"key {kept.schema['key'].dataType.simpleString()}, cluster int, distance decimal(38,0)")


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    kept = table(integer_vectors(vectors, key, column))
    centroids = first_centroids(kept, count)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(kept, centroids)
    members = table(assign(kept, centroids))
    spread = {r["cluster"]: int(r["s"]) for r in members.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per_cluster = lambda values, kind: F.element_at(F.array(*(F.lit(x) for x in values) if values else [F.lit(None)]).cast(f"array<{kind}>"), F.col("cluster") + 1)
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    return members.select(
        F.col("key").alias(key), "cluster", F.expr("try_cast(distance AS bigint)").alias("distance"),
        per_cluster([fits(spread.get(k)) for k in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(fits(sum(spread.values()))).cast("bigint").alias("inertia"),
        per_cluster(digests, "string").alias("centroid_sha256"),
    )
