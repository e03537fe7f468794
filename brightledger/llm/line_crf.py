"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. Its features are shares of symbols, capitals, digits, repetition and the
like, of itself and of its two neighbours; transitions link the labels of neighbours. Lines of a labelled document carry
its label for learning. Forward-backward gives each line's chance to be good, and the mean of these, weighted by line
length, is the document's quality, put on the scale of the labels by a logistic curve.

The model is a handful of weights, fitted on a bounded sample: at most SAMPLE labelled documents of each class, those with
the smallest hash of their id, up to SAMPLE_LINES lines each. Scoring is one narrow pass over whole texts.

Null and empty texts and texts without words count as one line without content. Repeated rows each get the same score. A
label that is null or neither 0 nor 1, or without a document, is ignored; repeated labels count once. Without labels of
both classes every score is the share of good ones (1.0 without labels). An empty table gives no rows. Labels and ids
never enter a score, and other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import tokens, words

SAMPLE, SAMPLE_LINES = 2_000, 300
STEPS, RATE, RIDGE = 200, 0.1, 1e-3
OWN = 11
SIZE = 1 + 3 * OWN
_KINDS = {"symbol": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digit": b"0123456789", "mark": b"!\"'(),-./:;=?@[\\]^_`{}~+"}
_MASKS = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _KINDS.items()}


def _repeats(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (owner, value): whether an equal one comes earlier, and whether there is another one at all."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    o, v = owner[order], values[order]
    same = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    earlier, other = np.zeros(len(values), bool), np.zeros(len(values), bool)
    earlier[order[1:]] = same
    other[order[1:]] = same
    other[order[:-1]] |= same
    return earlier, other


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature matrix of all lines with a word, the text of each, and its length in bytes; lines in order."""
    w = words.find_words(column)
    end = np.flatnonzero(w.buffer == 10)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    line = np.searchsorted(start, w.start, side="right") - 1  # of each word
    used, line = np.unique(line, return_inverse=True)
    start, end = start[used], end[used]
    text = np.searchsorted(w.text_start, start, side="right") - 1
    n = np.bincount(line, minlength=len(used)).astype(float)
    size = np.maximum(end - start, 1).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[w.buffer])])
        return (sums[end] - sums[start]) / size

    h = w.hashes()
    by_word = lambda flags: np.bincount(line, flags, len(used)) / np.maximum(n, 1)
    after_same = np.concatenate([[False], (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])]) if len(h) else np.zeros(0, bool)
    at, three = w.windows(h, 3)
    _, twice = _repeats(w.text[at], three)
    covered = np.zeros(len(h) + 3)
    for k in range(3):
        covered[at + k] += twice
    line_hash = words.hash_ranges(w.buffer, start, end)
    own = np.column_stack([
        np.log1p(n) / 4, size / np.maximum(n, 1) / 10, share(_MASKS["symbol"]) * 4, share(_MASKS["upper"]) * 2, share(_MASKS["digit"]) * 4, share(_MASKS["mark"]) * 4,
        by_word(after_same), by_word(covered[: len(h)] > 0), _repeats(text, line_hash)[0], by_word(_repeats(line, h)[0]), n < 3,
    ]).astype(float).reshape(len(used), OWN)
    out = np.zeros((len(used), SIZE))
    out[:, 0] = 1
    out[:, 1 : 1 + OWN] = own
    inside = text[1:] == text[:-1]
    out[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1] * inside[:, None]
    out[:-1, 1 + 2 * OWN :] = own[1:] * inside[:, None]
    return out, text, end - start


@dataclass
class Model:
    weights: np.ndarray  # of a line's features for the label good
    links: np.ndarray  # 2 x 2, from label to label
    slope: float
    shift: float

    def marginals(self, x: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Every line's chance to be good."""
        return _forward_backward(x @ self.weights, text, self.links)[0]

    def scores(self, column: pa.Array) -> np.ndarray:
        x, text, size = line_features(column)
        n = len(column)
        good = np.bincount(text, self.marginals(x, text) * size, n) if len(text) else np.zeros(n)
        total = np.bincount(text, size, n) if len(text) else np.zeros(n)
        blank = np.zeros((1, SIZE))
        blank[0, 0] = 1
        quality = np.where(total > 0, good / np.maximum(total, 1), self.marginals(blank, np.zeros(1, int))[0])
        return _sigmoid(self.slope * _logit(quality) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _forward_backward(lift: np.ndarray, text: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chances of good by line, expected counts of label pairs, and the logarithm of all paths' weight.

    All texts take a step together, longest first; messages are scaled to sum to one.
    """
    if not len(lift):
        return lift, np.zeros((2, 2)), 0.0
    _, first, n = np.unique(text, return_index=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    active = np.searchsorted(-n, -np.arange(int(n[0])), side="left")  # texts with more than t lines
    top = np.maximum(lift, 0)
    emit = np.column_stack([np.exp(-top), np.exp(lift - top)])
    move = np.exp(links - links.max())
    forward, backward = np.empty_like(emit), np.ones_like(emit)
    log_weight = float(top.sum()) + float(links.max()) * (len(lift) - len(n))
    for t, k in enumerate(active):
        at = first[:k] + t
        message = emit[at] if t == 0 else (forward[at - 1] @ move) * emit[at]
        scale = message.sum(1, keepdims=True)
        log_weight += float(np.log(scale).sum())
        forward[at] = message / scale
    for t in range(len(active) - 2, -1, -1):
        at = first[: active[t + 1]] + t
        message = (backward[at + 1] * emit[at + 1]) @ move.T
        backward[at] = message / message.sum(1, keepdims=True)
    both = forward * backward
    both /= both.sum(1, keepdims=True)
    inner = np.flatnonzero(text[1:] == text[:-1])
    pairs = forward[inner][:, :, None] * move[None] * (emit[inner + 1] * backward[inner + 1])[:, None, :]
    pairs /= pairs.sum((1, 2), keepdims=True)
    return both[:, 1], pairs.sum(0), log_weight


def fit(x: np.ndarray, text: np.ndarray, size: np.ndarray, label: np.ndarray, prior: float) -> Model:
    """Weights by gradient steps on the likelihood of line labels, both classes with equal total weight by sampling.

    label: of each line's text; prior: the share of good documents among all labelled ones.
    """
    weights, links = np.zeros(SIZE), np.zeros((2, 2))
    inner = np.flatnonzero(text[1:] == text[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner], label[inner + 1]), 1)
    n, moment, square = len(x), np.zeros(SIZE + 4), np.zeros(SIZE + 4)
    for step in range(1, STEPS + 1):
        good, pairs, _ = _forward_backward(x @ weights, text, links)
        gradient = np.concatenate([x.T @ (label - good), (seen - pairs).ravel()]) / n - RIDGE * np.concatenate([weights, links.ravel()])
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weights, links = weights + move[:SIZE], links + move[SIZE:].reshape(2, 2)
    model = Model(weights, links, 1.0, 0.0)
    good = model.marginals(x, text)
    ids, at = np.unique(text, return_inverse=True)
    quality = np.bincount(at, good * size) / np.maximum(np.bincount(at, size), 1)
    of_text = label[np.unique(text, return_index=True)[1]]
    share = of_text.mean()
    importance = np.where(of_text == 1, prior / share, (1 - prior) / (1 - share))
    z, slope, shift = _logit(quality), 1.0, 0.0
    for _ in range(30):  # Newton steps of the logistic curve, slightly damped towards slope 1
        p = _sigmoid(slope * z + shift)
        r, v = importance * (of_text - p), importance * p * (1 - p)
        hessian = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 1]])
        ds, db = np.linalg.solve(hessian, [(r * z).sum() - (slope - 1), r.sum() - shift])
        slope, shift = slope + float(np.clip(ds, -1, 1)), shift + float(np.clip(db, -1, 1))
    return Model(weights, links, max(slope, 1e-3), shift)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether CRC-32 of the id's text is a multiple of five; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Model | float:
    """A model from the labels that are not held out; the share of good ones where a class is missing."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    n = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    prior = n.get(1, 0) / sum(n.values()) if n else 1.0
    if len(n) < 2:
        return prior
    picks = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    picked = docs.select("doc_id", "text").join(F.broadcast(picks[0].union(picks[1])), "doc_id")  # 2 * sample ids at most

    def run(batches):
        for b in tokens.slices(batches):
            x, text, size = line_features(b.column("text"))
            cuts = np.searchsorted(text, np.arange(b.num_rows + 1))
            keep = [i for i in range(b.num_rows) if 0 < cuts[i + 1] - cuts[i] <= sample_lines]
            part = lambda a, i: a[cuts[i] : cuts[i + 1]]
            ids = [b.column("doc_id")[i] for i in keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i.as_py() for i in ids], pa.int64()), pa.array([b.column("quality")[i].as_py() for i in keep], pa.int32()), pa.array([part(x, i).ravel() for i in keep], pa.list_(pa.float64())), pa.array([part(size, i) for i in keep], pa.list_(pa.int64()))],
                ["doc_id", "quality", "x", "size"],
            )

    lines = picked.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x array<double>, size array<long>")
    rows = lines.orderBy("doc_id", "quality").limit(4 * sample).collect()  # bounded by the sample, in one order whatever the layout
    if len({r["quality"] for r in rows}) < 2:
        return prior
    x = np.concatenate([np.array(r["x"]).reshape(-1, SIZE) for r in rows])
    n_lines = [len(r["size"]) for r in rows]
    return fit(x, np.repeat(np.arange(len(rows)), n_lines), np.concatenate([r["size"] for r in rows]), np.repeat([r["quality"] for r in rows], n_lines), prior)


def score_documents(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score of every text."""

    def run(batches):
        for b in tokens.slices(batches):
            scores = np.full(b.num_rows, model) if isinstance(model, float) else model.scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
