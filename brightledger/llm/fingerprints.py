"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so it grows with its document, sketches of
parts merge into the sketch of the whole by a union, and the share of one sketch's hashes found in another estimates
containment even between very unequal documents. Shingles are five consecutive words, hashed by content.

The neighbour of a document is found without a global sort: ids are cut into ranges of similar counts, each range is
sorted on its own, and the head of the next range is sent along as the last look-ahead row.

A text of one to four words is one shingle; null and empty texts and texts without words have the empty sketch. A short
text may keep no hash either: its likeness to another text is the share of equal code points at both ends (1.0 for equal
texts). Rows with equal or null doc_ids
are ordered by their text (null ids last); every row gives a row. An empty table gives no rows; a single row is its own
neighbour. Other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import tokens, words

SHINGLE = 5
#: The kept part of all hashes is 1 in 4.
SCALE = 4
_BITS = 32


def sketches_of(column: pa.Array, size: int = SHINGLE, scale: int = SCALE) -> list[np.ndarray]:
    """The sketch of every text: its distinct kept hashes, sorted."""
    w = words.find_words(column)
    h = w.hashes()
    at, shingles = w.windows(h, size)
    owner = w.text[at]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        shingles = np.concatenate([shingles, words.hash_ranges(h, w.first[short], w.first[short + 1])])
        owner = np.concatenate([owner, short])
    values = (shingles >> np.uint64(64 - _BITS)).astype(np.uint32)
    keep = values < np.uint32((1 << _BITS) // scale)
    pairs = np.unique(owner[keep].astype(np.uint64) << np.uint64(_BITS) | values[keep])
    cuts = np.searchsorted(pairs >> np.uint64(_BITS), np.arange(1, len(n)))
    return np.split((pairs & np.uint64((1 << _BITS) - 1)).astype(np.uint32), cuts)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of two documents together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else float(not len(b))


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of either that both have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def as_text(sketch: np.ndarray) -> str:
    """Fixed-width hex, eight digits a hash."""
    return sketch.astype(">u4").tobytes().hex()


def _shared_ends(a: str, b: str) -> float:
    if a == b:
        return 1.0
    most, head, tail = min(len(a), len(b)), 0, 0
    while head < most and a[head] == b[head]:
        head += 1
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return (head + tail) / max(len(a), len(b))


def likeness(a: np.ndarray, b: np.ndarray, text_a: str, text_b: str) -> float:
    """Containment of a's shingles in b; texts decide only where a is so short that its sketch is empty."""
    return containment(a, b) if len(a) else _shared_ends(text_a, text_b)


def sketch_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """doc_id and its sketch as array<bigint>."""

    def run(batches):
        for b in tokens.slices(batches, name=text_column):
            out = [x.astype(np.int64) for x in sketches_of(b.column(1), size, scale)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "sketch"])

    d = docs.select(id_column, text_column)
    return d.mapInArrow(run, f"doc_id {d.schema[id_column].dataType.simpleString()}, sketch array<bigint>")


def _constant(values, kind: str) -> Column:
    """A constant array, whatever its length, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _position(value: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds are not below the value, by binary search."""
    if not bounds:
        return F.lit(0)
    array, n = _constant(bounds, "bigint"), len(bounds)

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = F.get(array, mid) >= value
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve, lambda acc: acc["lo"])


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, doc_id, text, ahead) sorted by descending doc_id within parts, each part ending with the first row of the next one."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = d.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(c) for c in cuts or []}, reverse=True)
    last = -(1 << 63)  # where null ids stand
    id_ = F.coalesce("doc_id", F.lit(last))
    d = d.withColumn("part", _position(id_, bounds))
    heads = d.groupBy("part").agg(F.max(F.struct(id_.alias("o"), F.xxhash64("text").alias("h"))).alias("head")).collect()  # a row a part
    heads.sort(key=lambda r: r["part"])
    if not heads:
        return d.select("part", "doc_id", "text", F.lit(False).alias("ahead"))
    keys, before = ["-"] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, r in enumerate(heads):
        keys[r["part"]] = f"{r['head']['o']}:{r['head']['h']}"
        before[r["part"]] = heads[i - 1]["part"]  # the head of the first part follows the last part
    is_head = F.get(_constant(keys, "string"), F.col("part")) == F.concat_ws(":", id_.cast("string"), F.xxhash64("text").cast("string"))
    own = F.struct(F.col("part").alias("p"), F.lit(False).alias("a"))
    places = F.when(is_head, F.array(own, F.struct(F.get(_constant(before, "int"), F.col("part")).alias("p"), F.lit(True).alias("a")))).otherwise(F.array(own))
    rows = d.select("doc_id", "text", F.explode(places).alias("x")).select(F.col("x.p").alias("part"), "doc_id", "text", F.col("x.a").alias("ahead"))
    return rows.repartition(len(heads), "part").sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())


def compare_with_edits(docs: DataFrame, parts: int) -> DataFrame:
    """Each document's sketch beside that of its edited text and of the next document.

    The edited text has its last third replaced by the beginning of the next document by descending doc_id.
    """

    def pairs(batches):
        """Rows (id, text, next text); the look-ahead row of a part only serves the row before."""
        held = None
        for b in batches:
            for part, doc, text, ahead in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held is not None and held[0] == part:
                    yield held[1], held[2], text
                held = None if ahead else (part, doc, text)

    def groups(batches, size=1 << 21):
        own, n = [], 0
        for row in pairs(batches):
            own.append(row)
            n += len(row[1])
            if n >= size:
                yield own
                own, n = [], 0
        if own:
            yield own

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        for rows in groups(batches):
            texts = [t for _, t, _ in rows]
            following = [t for _, _, t in rows]
            edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, following)]
            own = sketches_of(pa.array([*texts, following[-1]], pa.string()))
            # A part's rows follow one another, so the next sketch is the next row's; across a part's end it is not.
            changed = [i for i in range(len(rows) - 1) if following[i] is not texts[i + 1] and following[i] != texts[i + 1]]
            extra = dict(zip(changed, sketches_of(pa.array([following[i] for i in changed], pa.string())))) if changed else {}
            after = sketches_of(pa.array(edited, pa.string()))
            out = [
                (doc, len(t), sha256(e.encode()).hexdigest(), as_text(own[i]), as_text(after[i]), likeness(own[i], after[i], t, e), likeness(own[i], extra.get(i, own[i + 1]), t, following[i]))
                for i, ((doc, t, _), e) in enumerate(zip(rows, edited))
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, parts).mapInArrow(run, schema)
