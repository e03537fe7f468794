"""Near copies: SimHash links, confirmed by the exact similarity of word shingles, and prefix filtering for what they miss.

Two texts are linked if they share at least PERCENT of the shingles of either (Jaccard), shingles being SIZE consecutive
words with A-Z in lower case. Texts are first linked by SimHash (`simhash`: fingerprints of these shingles, covering hashing
within its radius), and every such link is confirmed on the whole sets. SimHash alone cannot decide this: pairs at 80 %
differ in up to 20 of its 64 bits. So prefix filtering goes on from the groups found, between texts of different groups: all
shingles have one order, and a text of n shingles is found under its first n - ceil(PERCENT * n) + 1: two linked texts
share at least one of these, so no link is missed. Any order will do. Shingles that a sample of the texts (1 in SAMPLE)
shows in many of them come last, which keeps common passages from making large buckets; the sample decides nothing else.

Texts of the same shingles are one node. In a bucket every node is held against two pivots that the bucket draws, which
joins a large group of near copies without all of its pairs; then nodes of a bucket that are not connected yet are held
against each other, and pairs whose parities differ in more bits than linked sets can differ in shingles go at once. Every
link is confirmed on the whole sets, so groups are those that all links would give.

A text of fewer words than SIZE is one shingle. Null and empty texts and texts without words are one group. Repeated rows
and null doc_ids are dealt with as `representatives` says. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import simhash, tokens, words
from .components import components
from .durable import cut, release, table

SIZE, PERCENT = 5, 80
#: Shingles met in OFTEN texts of the sample are common; at most COMMON of them, the most frequent ones, come last.
SAMPLE, OFTEN, COMMON = 4, 4, 200_000
#: Words of 64 bits of the parities of a set.
PARITY = 8


def shingles_of(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every distinct shingle, by text and hash."""
    w = words.find_words(column)
    h = words.hash_ranges(simhash._LOWER[w.buffer], w.start, w.end)
    at, hashes = w.windows(h, size)
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < size))
    hashes = np.concatenate([hashes, words.hash_ranges(h, w.first[short], w.first[short + 1])])
    owner = np.concatenate([w.text[at], short]).astype(np.int64)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of its n first shingles a text is found under."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def parities(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every set of hashes, PARITY words: whether an odd number of them falls on each bit.

    A shingle that only one of two sets holds changes one bit, so sets differ in at least as many shingles as bits.
    """
    bit, word = np.uint64(1) << (h >> np.uint64(58)), (h >> np.uint64(50)) % np.uint64(PARITY)
    out = np.empty((len(first) - 1, PARITY), np.uint64)
    for k in range(PARITY):
        odd = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(word == k, bit, np.uint64(0)))])
        out[:, k] = odd[first[1:]] ^ odd[first[:-1]]
    return out


def common_shingles(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """Hashes of shingles that many texts hold, the rarest first."""

    def run(batches):
        for b in tokens.slices(batches, words.SLICE):
            h, n = np.unique(shingles_of(b.column("text"), size)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    counts = table(counts)
    # Histogram of powers of the eighth root of two: the classes of highest counts that hold at most COMMON shingles.
    level = F.floor(8 * F.log2("n"))
    least, total = None, 0
    for k, n in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("k")).count().collect()), reverse=True):
        total += n
        if total > COMMON:
            break
        least = k
    if least is None:
        return np.zeros(0, np.uint64)
    found = counts.where(level >= least).toArrow()
    token, n = (found[c].to_numpy().astype(np.int64) for c in ("token", "n"))
    return token[np.lexsort((token, n))].view(np.uint64)


def _nodes(docs: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """g (hash of the set), least (smallest id and a hash of its text), n, prefix, SimHash and parities of every distinct set of shingles.

    Texts of one set may repeat its shingles differently; the smallest of their fingerprints stands for them.
    """
    by_hash = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[by_hash], by_hash + 1))

    def run(batches):
        known, rank = shared.value
        for b in tokens.slices(batches, words.SLICE):
            owner, h = shingles_of(b.column("text"), size)
            n = np.bincount(owner, minlength=b.num_rows)
            first = np.concatenate([[0], np.cumsum(n)])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(h ^ np.uint64(simhash.SEED)), dtype=np.uint64)])
            g = words.mix(sums[first[1:]] - sums[first[:-1]])
            odd = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * PARITY), pa.array(parities(h, first).view(np.int64).ravel()))
            late = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                late = np.where(known[at] == h, rank[at], 0)
            h = h[np.lexsort((h, late, owner))]
            length = prefix_length(n, percent)
            keep = np.arange(len(h)) - first[owner] < length[owner]
            bounds = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
            prefix = pa.ListArray.from_arrays(bounds, pa.array(h[keep].view(np.int64)))
            fp = pa.array(simhash.fingerprints_of(b.column("text"), size).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64)), fp, prefix, odd], ["id", "h", "g", "n", "fp", "prefix", "odd"])

    rows = docs.select("id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "id long, h long, g long, n long, fp long, prefix array<long>, odd array<long>")
    of_set = [F.first(c).alias(c) for c in ("n", "prefix", "odd")]
    return table(rows.groupBy("g").agg(F.min(F.struct("id", "h")).alias("least"), F.min("fp").alias("fp"), *of_set))


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that SimHash links: of equal fingerprints with the first of them, and these firsts within the radius."""
    firsts = nodes.groupBy("fp").agg(F.min("g").alias("first"))
    equal = nodes.join(firsts, "fp").select(F.col("g").alias("a"), F.col("first").alias("b")).where("a <> b")
    near = simhash.links(cut(nodes.select("fp").distinct()))
    for end in "ab":
        near = near.join(firsts.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_g")), end)
    return table(equal.union(near.select("a_g", "b_g")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _sets(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """g and set, all shingles, of the nodes in pairs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("g")).distinct().join(nodes.select("g", "least.*"), "g")

    def run(batches):
        for b in tokens.slices(batches, words.SLICE):
            owner, h = shingles_of(b.column("text"), size)
            bounds = pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("g"), pa.ListArray.from_arrays(bounds, pa.array(h.view(np.int64)))], ["g", "set"])

    texts = docs.select("id", F.xxhash64("text").alias("h"), "text").join(wanted, ["id", "h"]).select("g", "text")
    return table(texts.mapInArrow(run, "g long, set array<long>").dropDuplicates(["g"]))


def _may_link(x: Column, y: Column, percent: int) -> Column:
    """Whether sizes, and what follows the shared shingle in the order, allow a link."""
    fits = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    return (x["g"] != y["g"]) & fits & ((100 + percent) * (1 + F.least(x["rest"], y["rest"])) >= percent * (x["n"] + y["n"]))


def _odd_allow(x: Column, y: Column, total: Column, percent: int) -> Column:
    """Whether the parities of two sets of so many shingles together allow a link."""
    bits = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(PARITY)), F.lit(0))
    return (100 + percent) * bits <= (100 - percent) * total


def _pairs(x: Column, y: Column) -> list[Column]:
    return [F.least(x["g"], y["g"]).alias("a"), F.greatest(x["g"], y["g"]).alias("b")]


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("g").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("g").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return table(both.where((100 + percent) * shared >= percent * (F.size("set_a") + F.size("set_b"))).select("a", "b"))


def grouped(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """least (id, h) and root of every distinct set of shingles of docs (id long, text); links connect nodes of one root."""
    nodes = _nodes(docs, common_shingles(docs, size), size, percent)
    linked = _simhash_pairs(nodes)
    copies = _confirmed(linked, _sets(docs, linked, nodes, size), percent)
    near = table(components(copies)).withColumnRenamed("node", "g")
    release()
    rest = (F.col("n") - F.col("pos") - 1).alias("rest")
    rows = nodes.join(near, "g", "left").select("g", "n", F.coalesce("root", "g").alias("root"), F.posexplode("prefix").alias("pos", "token"))
    rows = rows.select("token", "root", F.struct("g", "n", rest).alias("x"))
    # A bucket's pivots are its nodes of smallest and largest draw, kept as longs so that minima combine on the map side.
    # Buckets inside one group have nothing left to tell.
    rows = rows.withColumn("draw", F.col("x.g").bitwiseXOR(F.xxhash64("token")))
    pivots = rows.groupBy("token").agg(F.min("draw").alias("lo"), F.max("draw").alias("hi"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    buckets = table(rows.join(table(pivots.where("r0 <> r1").select("token", "lo", "hi")), "token"))
    least = table(nodes.select("g", "least", "odd"))
    release(nodes)  # and the shuffles of all prefixes, before texts are shuffled
    chosen = buckets.where("draw = lo OR draw = hi").select("token", F.col("root").alias("other"), F.col("x").alias("y")).distinct()
    held = buckets.select("token", "root", "x").join(chosen, "token").where((F.col("root") != F.col("other")) & _may_link(F.col("x"), F.col("y"), percent))
    first = table(held.select(*_pairs(F.col("x"), F.col("y"))).distinct())
    sets = _sets(docs, first, least, size)
    release()
    roots = table(components(copies.union(_confirmed(first, sets, percent))))
    release(sets)
    # Nodes of a bucket that are still apart.
    now = buckets.select("token", "x", F.col("x.g").alias("node")).join(roots, "node", "left").select("token", "x", "node", F.coalesce("root", "node").alias("root"))
    ends = now.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi AND n > 3")
    live = table(now.join(ends.select("token"), "token").join(least.select(F.col("g").alias("node"), "odd"), "node").drop("node"))
    other = live.select("token", F.col("x").alias("y"), F.col("root").alias("other"), F.col("odd").alias("odd_y"))
    alike = _may_link(F.col("x"), F.col("y"), percent) & _odd_allow(F.col("odd"), F.col("odd_y"), F.col("x.n") + F.col("y.n"), percent)
    apart = live.join(other, "token").where((F.col("x.g") < F.col("y.g")) & (F.col("root") != F.col("other")) & alike)
    second = table(apart.select(*_pairs(F.col("x"), F.col("y"))).distinct().join(first, ["a", "b"], "left_anti"))
    release(buckets, live)
    # What these links join are the groups found so far, so the contraction goes on from their roots.
    later = _confirmed(second, _sets(docs, second, least, size), percent)
    for end in "ab":
        named = roots.select(F.col("node").alias(end), F.col("root").alias("_r"))
        later = later.join(named, end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    joined = table(components(later))
    step = joined.select(F.col("node").alias("root"), F.col("root").alias("next"))
    all_roots = roots.join(step, "root", "left").select(F.col("node").alias("g"), F.coalesce("next", "root").alias("root"))
    single = joined.join(roots, "node", "left_anti").select(F.col("node").alias("g"), "root")
    return least.join(all_roots.union(single), "g", "left").select("least", F.coalesce("root", "g").alias("root"))


def representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row of every group of near copies, with all columns: the smallest doc_id's, and the text of least hash under that id.

    A null doc_id counts as the smallest. Different texts under one id, null or not, are judged each for itself; of rows
    that repeat id and text one stays, chosen by a hash of the row.
    """
    id_ = F.coalesce("doc_id", F.lit(-(1 << 63)))
    text = F.coalesce("text", F.lit(""))
    named = grouped(docs.select(id_.alias("id"), text.alias("text")), size, percent)
    kept = named.groupBy("root").agg(F.min("least").alias("_kept")).select("_kept.*")
    packed = docs.select(F.struct("*").alias("_row"), id_.alias("_id"), F.xxhash64(text).alias("_h"))
    chosen = packed.join(kept, (F.col("_id") == F.col("id")) & (F.col("_h") == F.col("h")), "left_semi")
    return chosen.groupBy("_id", "_h").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
