"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets one of the 31 non-zero vectors of five bits. A table is one such vector v, and its mask holds the
bits whose vector has an odd product with v, about half of them. The vectors of at most four differing bits span no
more than four dimensions, so some v is orthogonal to all of them: that table's mask sees no difference, and every pair
within the radius meets in one of the 31 tables. A table's bucket is searched from node to node among those not reached
yet, which gives a spanning forest of its links, never all of its pairs. A bucket over BUCKET fingerprints is hashed
again by the same construction over the bits that its mask leaves free; what then agrees has at most 16 free bits, so a
task's share is bounded whatever a bucket holds. Equal fingerprints are one node throughout.

Null and empty texts and texts without words have fingerprint zero and link like any other. Repeated rows give a row
each. A null doc_id keeps its row and takes its group's id (null if no member has one). An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import tokens, words
from .components import components
from .durable import cut

SEED, RADIUS = 42, 4
BUCKET = 2_000
_ALL = (1 << 64) - 1
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_VECTORIZED = 256
#: A-Z in lower case, white space as a space
_LOWER = np.array([b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256)], np.uint8)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _xxh64_rows(lanes: np.ndarray, raw: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """XXH64 of raw[start:start + length] for many starts of one length; lanes: the 8 bytes that begin at each byte."""
    n, at = len(start), start
    seed = np.uint64(SEED)
    if length >= 32:
        acc = [np.full(n, s, np.uint64) for s in (SEED + int(_P1) + int(_P2) & _ALL, SEED + int(_P2) & _ALL, SEED, SEED - int(_P1) & _ALL)]
        for _ in range(length // 32):
            for k in range(4):
                acc[k] = _rotl(acc[k] + lanes[at + 8 * k] * _P2, 31) * _P1
            at = at + 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ (_rotl(a * _P2, 31) * _P1)) * _P1 + _P4
    else:
        h = np.full(n, seed + _P5, np.uint64)
    h = h + np.uint64(length)
    rest = length % 32
    for _ in range(rest // 8):
        h = _rotl(h ^ (_rotl(lanes[at] * _P2, 31) * _P1), 27) * _P1 + _P4
        at = at + 8
    if rest & 4:
        h = _rotl(h ^ ((lanes[at] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at = at + 4
    for _ in range(rest & 3):
        h = _rotl(h ^ (raw[at].astype(np.uint64) * _P5), 11) * _P1
        at = at + 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 with the seed of this module of raw[start:end], many at once."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.zeros(len(raw) + 1, np.uint64)
    for k in range(8):
        lanes |= padded[k : k + len(lanes)].astype(np.uint64) << np.uint64(8 * k)
    size = end - start
    order = np.argsort(size, kind="stable")
    out = np.empty(len(start), np.uint64)
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
        n = int(size[group[0]])
        if n <= _VECTORIZED:
            out[group] = _xxh64_rows(lanes, padded, start[group], n)
        else:
            out[group] = [xxhash.xxh64_intdigest(raw[start[k] : end[k]].tobytes(), SEED) for k in group]
    return out


def fingerprints_of(column: pa.Array, size: int = 4) -> np.ndarray:
    """64-bit fingerprints of texts: the majority of every bit over the hashes of all shingles."""
    w = words.find_words(column)
    keep = ~w.space
    keep[w.start[w.start > 0] - 1] = True  # one space between two words
    text = _LOWER[w.buffer[keep]]
    lengths = w.end - w.start
    start = np.cumsum(lengths + 1) - lengths - (0 if len(w.start) and w.start[0] else 1)
    end = start + lengths
    n_words = np.diff(w.first)
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    first_shingle = np.concatenate([[0], np.cumsum(n_shingles)])
    owner = np.repeat(np.arange(len(n_words)), n_shingles)
    first = w.first[owner] + np.arange(len(owner)) - first_shingle[owner]
    last = np.minimum(first + size - 1, w.first[owner + 1] - 1)
    out = np.zeros(len(n_words), np.uint64)
    some = np.flatnonzero(n_shingles)
    if not len(some):
        return out
    hashes = xxh64(text, start[first], end[last])
    # Counts of eight bits at a time ride in the bytes of one 64-bit sum; a block of 255 shingles cannot overflow them.
    blocks = -(-n_shingles[some] // 255)
    first_block = np.cumsum(blocks) - blocks
    at = first_shingle[some].repeat(blocks) + 255 * (np.arange(blocks.sum()) - first_block.repeat(blocks))
    counts = np.empty((len(some), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), at)
        counts[:, k::8] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8), first_block, axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * counts > n_shingles[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for b in tokens.slices(batches, name=text_column):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(b.column(1)).view(np.int64))], ["doc_id", "fp"])

    d = docs.select(id_column, text_column)
    return d.mapInArrow(run, f"doc_id {d.schema[id_column].dataType.simpleString()}, fp long")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions such that any `radius` of these bits are all outside one of the masks."""
    vectors = (1 << (radius + 1)) - 1
    masks = {sum(1 << b for i, b in enumerate(bits) if ((1 + i % vectors) & v).bit_count() & 1) for v in range(1, vectors + 1)}
    return sorted(masks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left = np.sort(fps).view(np.uint64)
    out = []
    while len(left):
        root, front, left = int(left[:1].view(np.int64)[0]), left[:1], left[1:]
        while len(front) and len(left):
            step, front = front[:64], front[64:]
            near = (np.bitwise_count(step[:, None] ^ left[None, :]) <= radius).any(0)
            found = left[near]
            if len(found):
                out += [(root, x) for x in found.view(np.int64).tolist()]
                front, left = np.concatenate([front, found]), left[~near]
    return out


def _bucket_edges(lists: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            edges = [e for x in b.column(0) for e in forest(x.values.to_numpy(zero_copy_only=False).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    return lists.select("members").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges `a`, `b` that connect whatever links among the distinct longs of column fp connect."""
    masks = covering_masks(list(range(64)))
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)))
    rows = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.k")
    sizes = cut(rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    middle = rows.join(sizes.where((F.col("n") > 2) & (F.col("n") <= bucket)).select("t", "k"), ["t", "k"])
    middle = middle.groupBy("t", "k").agg(F.collect_list("fp").alias("members"))
    hot = rows.join(sizes.where(F.col("n") > bucket).select("t", "k"), ["t", "k"])
    again = F.lit(None).cast("array<struct<u:int,k:bigint>>")
    for t, m in enumerate(masks):
        inner = covering_masks([b for b in range(64) if not m >> b & 1])
        again = F.when(F.col("t") == t, F.array(*(F.struct(F.lit(u).alias("u"), F.col("fp").bitwiseAND(F.lit(_signed(m | x))).alias("k")) for u, x in enumerate(inner)))).otherwise(again)
    hot = hot.select("fp", "t", F.explode(again).alias("x")).groupBy("t", "x.u", "x.k").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return pairs.union(_bucket_edges(middle)).union(_bucket_edges(hot))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, for every row."""
    fps = cut(fingerprint_documents(docs, id_column, text_column))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    known = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(groups, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
