"""Agglomerative clustering by Ward's criterion, over mergeable clustering features.

Rows become features (number of rows and their mean) by equal points, or, if these are more than MAX_FEATURES, by cells of
a grid whose width doubles until there are few enough. That is the only difference that the number of rows makes: the
features, and so the one task that merges them, are bounded, and with few points the tree is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .joins import join_few

MAX_FEATURES = 4000
#: Narrowest cells that are tried, in units of the columns.
FIRST_WIDTH = 1e-3


def merge_tree(centres: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (member of one cluster, member of the other, height) of the whole tree, found along chains of nearest neighbours.

    Ward's distance never falls when clusters merge, so two clusters that are each other's nearest may merge at once.
    """
    c, w, alive = centres.astype(float).copy(), weights.astype(float).copy(), np.ones(len(weights), bool)
    merges, chain, left = [], [], len(w)
    while left > 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            i = chain[-1]
            apart = w[i] * w / (w[i] + w) * ((c - c[i]) ** 2).sum(1)
            apart[~alive] = np.inf
            apart[i] = np.inf
            j = int(np.argmin(apart))
            if len(chain) > 1 and apart[chain[-2]] <= apart[j]:
                break
            chain.append(j)
        i, j = chain.pop(), chain.pop()
        a, b = min(i, j), max(i, j)
        merges.append((a, b, float(apart[j])))
        c[a] = (w[a] * c[a] + w[b] * c[b]) / (w[a] + w[b])
        w[a] += w[b]
        alive[b] = False
        left -= 1
    return merges


def cut_tree(merges: list[tuple[int, int, float]], size: int, k: int) -> np.ndarray:
    """Labels 0 to k - 1 of the features, numbered by their first member."""
    root = np.arange(size)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, _ in sorted(merges, key=lambda m: m[2])[: max(0, size - k)]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    roots = np.array([find(i) for i in range(size)])
    return np.unique(roots, return_inverse=True)[1]


def _cell(columns: list[str], width: float) -> Column:
    values = [F.col(c).cast("double") + F.lit(0.0) for c in columns]
    return F.array(*[F.floor(v / width).cast("double") if width else v for v in values])


def ward_labels(points: DataFrame, columns: list[str], ks: list[int], most: int = MAX_FEATURES) -> tuple[DataFrame, float]:
    """points with ``_labels``, the label of every row for each number of clusters, and the width of the cells (0: equal points)."""
    widths = [0.0, *(FIRST_WIDTH * 2**i for i in range(40))]
    # Cells of one width lie in those of the next, so their number only falls: halving finds the first that may do, at one
    # sketch a pass.
    low, high = 0, len(widths)
    while low < high:
        middle = (low + high) // 2
        rough = points.agg(F.approx_count_distinct(F.xxhash64(_cell(columns, widths[middle])), 0.02)).first()[0]
        low, high = (middle + 1, high) if rough > 1.1 * most else (low, middle)
    for width in widths[low:]:
        features = durable(points.groupBy(_cell(columns, width).alias("_cell")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in columns]).alias("centre")))
        if features.count() <= most:
            break
    else:
        raise ValueError(f"the points do not fit {most} cells")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=[tuple(x) for x in pdf["_cell"]]).sort_values("key")
        merges = merge_tree(np.stack(pdf["centre"].to_numpy()), pdf["n"].to_numpy())
        labels = np.stack([cut_tree(merges, len(pdf), k) for k in ks], axis=1)
        return pd.DataFrame({"_cell": pdf["_cell"].to_numpy(), "_labels": list(labels.astype("int32"))})

    named = durable(features.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(merged, "_cell array<double>, _labels array<int>"))
    return join_few(points.withColumn("_cell", _cell(columns, width)), named, "_cell").drop("_cell"), width
