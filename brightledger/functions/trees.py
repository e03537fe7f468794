"""Fitted tree models as small arrays, and per-batch NumPy helpers that walk them.

A model of at most some hundred trees has a bounded number of nodes, so the arrays travel to the tasks by
broadcast; the rows stay where they are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np

from .durable import ensure_checkpoint_dir


@dataclass
class Tree:
    feature: np.ndarray    # -1 at a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    weight: float
    gain: np.ndarray | None = None    # impurity taken away by each split, times the rows it had
    values: np.ndarray | None = None  # class shares, or the mean, of every node
    pure: np.ndarray | None = None

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf index of every row."""
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            r = rows[inner]
            go_left = x[r, f[inner]] <= self.threshold[at[inner]]
            at[inner] = np.where(go_left, self.left[at[inner]], self.right[at[inner]])


def model_trees(model, spark, with_stats: bool = False):
    """Node arrays of a fitted forest or boosted model, read from its saved form in the shared folder.

    With stats also the impurity statistics of every node.
    """
    path = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    rows = spark.read.load(f"{path}/data").select("treeID", "nodeData.*").collect()
    weights = list(model.treeWeights)
    boosted = type(model).__name__.startswith("GBT")
    classes = getattr(model, "numClasses", 0) and not boosted
    total = 1.0 if boosted else float(sum(weights))
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    out, stats_of = [], []
    for t in sorted(by_tree):
        nodes = sorted(by_tree[t], key=lambda r: r["id"])
        n = len(nodes)
        tree = Tree(np.full(n, -1), np.zeros(n), np.full(n, -1), np.full(n, -1), np.zeros(n), np.zeros(n), weights[t] / total, np.zeros(n))
        stats_of.append([list(r["impurityStats"]) for r in nodes])
        for r in nodes:
            i = r["id"]
            stats = r["impurityStats"]
            tree.cover[i], tree.gain[i] = r["rawCount"], max(r["gain"], 0.0) * r["rawCount"]
            tree.value[i] = stats[1] / sum(stats) if classes else r["prediction"]
            if r["leftChild"] >= 0:
                tree.feature[i], tree.threshold[i] = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
                tree.left[i], tree.right[i] = r["leftChild"], r["rightChild"]
        out.append(tree)
    return (out, stats_of) if with_stats else out


def predict(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Weighted sum of leaf values (class-1 probability for forests of classifiers)."""
    out = np.zeros(len(x))
    for t in trees:
        out += t.weight * t.value[t.leaves_of(x)]
    return out


# --- Shapley values of tree models (path-dependent, Lundberg et al. 2018) -------------------------------
#
# On the way to a leaf every feature has an interval its value must lie in (met m = 0 or 1) and a share r of the training
# rows that stay on the way when the feature is unknown. The weights of all subsets of the other features are the values of
# an integral: a feature's share of the leaf's value v is v (m - r) times the integral over t in (0, 1) of the
# product of (1 - t) r' + t m' over the other features. That polynomial of degree k - 1 is integrated exactly by
# Gauss's rule with k / 2 points, so the whole product is extended once along the path and each feature is divided
# out of it again. Nothing is tabulated by subsets: a task holds the node arrays and one block of rows.


@dataclass
class LeafPaths:
    """All root-to-leaf paths of one tree; features by row, leaves by column."""

    features: np.ndarray
    thresholds: list[np.ndarray]  # of each feature, ascending; bin b lies between the thresholds b - 1 and b
    low: np.ndarray               # first and last bin with which a value stays on the path
    high: np.ndarray
    ratio: np.ndarray
    value: np.ndarray
    longest: int                  # distinct features of the longest path


def leaf_paths(trees: list[Tree]) -> list[LeafPaths]:
    out = []
    for t in trees:
        inner = t.feature >= 0
        features = np.unique(t.feature[inner])
        thresholds = [np.unique(t.threshold[t.feature == f]) for f in features]
        place = {int(f): i for i, f in enumerate(features)}
        low, high, ratio, value, longest = [], [], [], [], 0
        stack = [(0, np.zeros(len(features), int), np.array([len(x) for x in thresholds], int), np.ones(len(features)), 0)]
        while stack:
            node, lo, hi, share, met = stack.pop()
            if not inner[node]:
                low.append(lo), high.append(hi), ratio.append(share), value.append(t.weight * t.value[node])
                longest = max(longest, met.bit_count())
                continue
            i = place[int(t.feature[node])]
            at = int(np.searchsorted(thresholds[i], t.threshold[node]))
            for child, is_left in ((t.left[node], True), (t.right[node], False)):
                lo2, hi2, share2 = lo.copy(), hi.copy(), share.copy()
                lo2[i], hi2[i] = (lo[i], min(hi[i], at)) if is_left else (max(lo[i], at + 1), hi[i])
                share2[i] *= t.cover[child] / t.cover[node]
                stack.append((child, lo2, hi2, share2, met | 1 << i))
        out.append(LeafPaths(features, thresholds, np.array(low).T, np.array(high).T, np.array(ratio).T, np.array(value), longest))
    return out


#: Numbers of a block of rows by leaves and points that are worked on at once.
BLOCK = 1 << 20


def _tree_shap(p: LeafPaths, x: np.ndarray, out: np.ndarray) -> None:
    points, weights = np.polynomial.legendre.leggauss((p.longest + 1) // 2)
    points, weights = (points + 1) / 2, weights / 2
    bins = [np.searchsorted(thr, x[:, f], side="left") for f, thr in zip(p.features, p.thresholds)]
    factors, parts = [], []
    for i, thr in enumerate(p.thresholds):
        b = np.arange(len(thr) + 1)[:, None]
        met = ((b >= p.low[i]) & (b <= p.high[i])).astype(float)
        factor = (1 - points) * p.ratio[i][:, None] + points * met[:, :, None]
        part = weights * ((met - p.ratio[i]) * p.value)[:, :, None] / np.where(factor == 0, 1, factor)
        factors.append(factor.reshape(len(b), -1))
        parts.append(part.reshape(len(b), -1))
    size = max(1, BLOCK // (len(p.value) * len(points)))
    for at in range(0, len(x), size):
        rows = slice(at, at + size)
        product = factors[0][bins[0][rows]]
        for factor, b in zip(factors[1:], bins[1:]):
            product *= factor[b[rows]]
        for f, part, b in zip(p.features, parts, bins):
            out[rows, f] += np.einsum("ij,ij->i", product, part[b[rows]])


def shap_values(paths: list[LeafPaths], x: np.ndarray) -> np.ndarray:
    """Shapley values of a batch of rows; rows between the same thresholds are worked out once."""
    if not len(x):
        return np.zeros(x.shape)
    codes = np.zeros(x.shape, np.int32)
    for f in range(x.shape[1]):
        thr = [t for p in paths for g, t in zip(p.features, p.thresholds) if g == f]
        codes[:, f] = np.searchsorted(np.unique(np.concatenate(thr)), x[:, f], side="left") if thr else 0
    _, first, inverse = np.unique(codes, axis=0, return_index=True, return_inverse=True)
    cells = x[first]
    out = np.zeros(cells.shape)
    for p in paths:
        if p.longest:
            _tree_shap(p, cells, out)
    return out[inverse.ravel()]


def expected_value(paths: list[LeafPaths]) -> float:
    return float(sum((p.value * p.ratio.prod(0)).sum() for p in paths))
