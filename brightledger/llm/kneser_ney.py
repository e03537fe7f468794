"""Interpolated modified Kneser-Ney language model, counted in Spark and stored as sorted hash arrays.

A text is its words, A-Z in lower case, and one end; a mark before the first word is context only. An n-gram's key is a
64-bit hash of the keys of its first and its last n - 1 words; inside a shard 48 bits tell keys apart. Texts are first turned into chunks (CHUNK bytes of text, a
longer text alone): distinct words and the texts as numbers of them. From the highest order down, every chunk sends
its distinct keys with their counts to the shards, ranges of the key space of about SHARD tokens each. A shard adds them
up, writes its keys and values as sorted arrays in the shared folder, memory-maps them, and answers every chunk in the order of
its keys; a chunk's answers are put into one file, which the workers that score the chunk memory-map in turn. So a task holds one
chunk or one shard at any size of the corpus, only keys that differ within a chunk are shuffled, and nothing but
totals reaches the driver. What one key gathers in a shard is one entry a chunk at most.

Below the highest order an n-gram's count is the number of different words before it, or how often it was met if it begins
a text. For that, each n-gram of the next order is owned by one chunk that has it, which credits its last words, and
its context with what was met after it. Discounts follow from the numbers of n-grams met once to four times; where
these leave one undefined it is half the count. The lowest order is interpolated with an equal share for each word and
one unknown word, so that the probabilities of a context sum to one.

Null and empty texts are an end alone. Repeated rows count each and give a row each. A null id keeps its row. Without any training
text every token has the probability one (the unknown word's). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import io
import uuid
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import tokens, words
from .durable import release, shared_folder, table

ORDER = 2
CHUNK, SHARD = 10 << 20, 1 << 20
ADDED = 0.1
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Hashes of the marks, which no word has since they hold a space.
BEGIN, END = (words.hash_ranges(np.frombuffer(m, np.uint8), np.array([0]), np.array([2]))[0] for m in (b" b", b" e"))
_SALT = np.uint64(0xA0761D6478BD642F)


def join_keys(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their first and their last n - 1 words."""
    return words.mix(words.mix(first ^ _SALT) + last)


# Files in the shared folder


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    at = urlparse(path)
    return (pyarrow.fs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else pyarrow.fs.FileSystem.from_uri(path)


def write_array(path: str, values: np.ndarray) -> None:
    """The array in one file, there as a whole or not at all."""
    store, at = _place(path)
    store.create_dir(at.rsplit("/", 1)[0])
    data = io.BytesIO()
    np.save(data, values)
    part = f"{at}.{uuid.uuid4()}"
    with store.open_output_stream(part) as out:
        out.write(data.getbuffer())
    store.move(part, at)


def map_array(path: str) -> np.ndarray:
    """The array of a file: memory-mapped where the shared folder is mounted, read where it is a remote store."""
    store, at = _place(path)
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return np.load(at, mmap_mode="r")
    with store.open_input_file(at) as f:
        return np.load(io.BytesIO(f.read()))


class Counts:
    """Columns of counts in two mapped files: one byte each, and the few that need more by column and place."""

    LARGE = 255

    @staticmethod
    def write(path: str, columns: list[np.ndarray]) -> None:
        write_array(f"{path}.small.npy", np.stack([np.minimum(c, Counts.LARGE).astype(np.uint8) for c in columns]))
        places = [np.flatnonzero(c >= Counts.LARGE) for c in columns]
        large = [np.stack([np.full(len(at), i), at, c[at]]) for i, (c, at) in enumerate(zip(columns, places))]
        write_array(f"{path}.large.npy", np.concatenate(large, axis=1).astype(np.int64))

    def __init__(self, path: str):
        self.small, large = map_array(f"{path}.small.npy"), map_array(f"{path}.large.npy")
        edges = np.searchsorted(large[0], np.arange(len(self.small) + 1))
        self.large = [large[1:, lo:hi] for lo, hi in zip(edges, edges[1:])]

    def at(self, column: int, places: np.ndarray) -> np.ndarray:
        out = self.small[column][places].astype(np.int64)
        some = np.flatnonzero(out == self.LARGE)
        out[some] = self.large[column][1][np.searchsorted(self.large[column][0], places[some])]
        return out

    def __getitem__(self, column: int) -> np.ndarray:
        return self.at(column, np.arange(self.small.shape[1]))


def narrowest(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if values.size else 0))


def to_bytes(keys: np.ndarray, bits: int) -> bytes:
    """48 bits of every key below the first ones, which all keys of a shard share; first bytes before second ones."""
    rest = (keys << np.uint64(bits)) >> np.uint64(16)
    return np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes() if len(keys) else b""


def from_bytes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").reshape(-1)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of counts, each in as many bytes as its largest needs, first bytes before second ones, which compresses."""
    out = []
    for c in map(narrowest, columns):
        width = c.dtype.itemsize
        out += [bytes([width]), np.ascontiguousarray(c.view(np.uint8).reshape(-1, width).T).tobytes() if len(c) else b""]
    return b"".join(out)


def unpack(data: bytes, n: int, count: int) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(count):
        width = data[at]
        planes = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n).astype(np.int64))
        at += 1 + n * width
    return out


# Chunks


def word_hashes(texts: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of every text; a chunk's bytes are not looked at all together."""
    hashes, lengths = [], []
    for b in tokens.slices([texts], words.SLICE):
        w = words.find_words(b.column("text"))
        hashes.append(words.hash_ranges(_LOWER[w.buffer], w.start, w.end))
        lengths.append(np.diff(w.first).astype(np.int64))
    return np.concatenate(hashes), np.concatenate(lengths)


def chunked(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", size: int = CHUNK) -> DataFrame:
    """chunk, ids, held, lengths (words of each text), dictionary (hashes in order) and tokens (places in it) of runs of texts."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        made = 0
        for b in tokens.slices(batches, size):
            hashes, lengths = word_hashes(b)
            known, place = _distinct(hashes)
            # Frequent words first: small numbers take less room.
            order = np.argsort(-np.bincount(place, minlength=len(known)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            known, place = known[order], rank[place]
            bounds = pa.array([0, b.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(TaskContext.get().partitionId() << 32) + made]),
                    pa.ListArray.from_arrays(bounds, b.column("id")),
                    pa.ListArray.from_arrays(bounds, b.column("held")),
                    pa.ListArray.from_arrays(bounds, pa.array(lengths)),
                    pa.array([known.tobytes()]),
                    pa.array([pack([place])]),
                ],
                ["chunk", "ids", "held", "lengths", "dictionary", "tokens"],
            )
            made += 1

    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"chunk long, ids array<{id_type}>, held array<boolean>, lengths array<long>, dictionary binary, tokens binary")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the place of every key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place


@dataclass
class Grams:
    """N-grams of one order in a chunk."""

    keys: np.ndarray  # different ones, in order
    place: np.ndarray  # of the n-gram that ends at each position; -1 where none does
    begins: np.ndarray  # positions whose n-gram begins a text


class Chunk:
    """Positions of a chunk: the mark, the words and the end of every text."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda name: batch.column(name)[row]
        self.ids = get("ids").values
        lengths = get("lengths").values.to_numpy(zero_copy_only=False)
        known = np.frombuffer(get("dictionary").as_py(), np.uint64)
        places = unpack(get("tokens").as_py(), int(lengths.sum()), 1)[0]
        self.held = get("held").values.to_numpy(zero_copy_only=False).astype(bool)
        size = lengths + 2
        self.start = np.cumsum(size) - size
        self.words = np.empty(int(size.sum()), np.uint64)
        self.at = (np.arange(len(self.words)) - np.repeat(self.start, size)).astype(np.int32)
        end = self.start + size - 1
        inner = np.ones(len(self.words), bool)
        inner[self.start] = inner[end] = False
        self.words[inner] = known[places]
        self.words[self.start], self.words[end] = BEGIN, END
        self.train = np.repeat(~self.held, size)

    def grams(self, order: int) -> list[Grams]:
        """Those of order 1 to the given one."""
        out, keys = [], self.words
        for n in range(1, order + 1):
            if n > 1:
                keys = np.concatenate([keys[:1], join_keys(keys[:-1], keys[1:])])
            some = np.flatnonzero(self.at >= n - 1)
            different, place = _distinct(keys[some])
            everywhere = np.full(len(keys), -1, np.int32)
            everywhere[some] = place
            out.append(Grams(different, everywhere, np.flatnonzero(self.at == n - 1)))
        return out


# Columns of values. The highest order has the first two, lower ones all but the last; order 1 has all.
VALUE, OWNED, ONE, TWO, MORE, TOTAL, MET = range(7)


def n_columns(n: int, order: int) -> int:
    return 7 if n == 1 < order else 6 if n < order else 2


@dataclass
class Model:
    folder: str
    order: int
    bits: int
    totals: dict[int, dict[str, int]] = field(default_factory=dict)  # by order

    def discounts(self, n: int) -> np.ndarray:
        """What is taken from counts of 0, 1, 2, and 3 or more."""
        t = [self.totals[n][f"n{k}"] for k in (1, 2, 3, 4)]
        share = t[0] / (t[0] + 2 * t[1]) if t[0] else 0
        taken = [k - (k + 1) * share * t[k] / t[k - 1] if t[0] and t[k - 1] and t[k] else k / 2 for k in (1, 2, 3)]
        return np.clip([0, *taken], 0, [0, 1, 2, 3])

    def shard(self, n: int, shard: int) -> str:
        return f"{self.folder}/order-{n}/shard-{shard}"


def _counts(chunk: Chunk, grams: list[Grams], n: int, order: int, above: Counts | None) -> list[np.ndarray]:
    """What a chunk knows of its n-grams, by column without OWNED; above: the answers on the next order's n-grams."""
    g = grams[n - 1]
    size = len(g.keys)
    met = np.bincount(g.place[chunk.train & (chunk.at >= max(1, n - 1))], minlength=size)
    if n == order:
        return [met]
    up = grams[n]
    owned = above[OWNED].astype(bool)
    last = np.zeros(len(up.keys), np.int64)  # a position of each n-gram of the next order
    some = np.flatnonzero(up.place >= 0)
    last[up.place[some]] = some
    end = last[owned]
    value = np.bincount(g.place[end], minlength=size)
    if n > 1:
        begins = g.begins[chunk.train[g.begins]]
        value = value + np.bincount(g.place[begins], minlength=size)
    context, after = g.place[end - 1], above[VALUE][owned].astype(np.int64)
    out = [value, *(np.bincount(context[x], minlength=size) for x in (after == 1, after == 2, after > 2))]
    total = np.bincount(context, after, size).astype(np.int64)
    return [*out, total, met] if n == 1 else [*out, total]


def _answers_of(model: Model, n: int, chunk: int) -> str:
    return f"{model.folder}/answers-{n}/chunk-{chunk}"


def _to_shards(chunks: DataFrame, model: Model, n: int, learn: bool) -> DataFrame:
    """shard, chunk, keys and counts of every chunk's n-grams."""
    order, bits = model.order, model.bits

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                chunk, number = Chunk(b, i), b.column("chunk")[i].as_py()
                grams = chunk.grams(min(n + learn, order))
                keys = grams[n - 1].keys
                above = Counts(_answers_of(model, n + 1, number)) if learn and n < order else None
                counts = _counts(chunk, grams, n, order, above) if learn else []
                edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
                edges = [0, *edges.tolist(), len(keys)]
                parts = [(s, lo, hi) for s, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _, _ in parts], pa.int32()),
                        pa.array([number] * len(parts), pa.int64()),
                        pa.array([to_bytes(keys[lo:hi], bits) for _, lo, hi in parts], pa.binary()),
                        pa.array([pack([c[lo:hi] for c in counts]) for _, lo, hi in parts], pa.binary()),
                    ],
                    ["shard", "chunk", "keys", "counts"],
                )

    return chunks.mapInArrow(run, "shard int, chunk long, keys binary, counts binary")


def _merged(blocks: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Different keys of the blocks, the sums of their counts, and the block that owns each: the first that met it in training."""
    keys = np.concatenate([k for k, _ in blocks])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    columns = [np.concatenate(c)[order] for c in zip(*(c for _, c in blocks))]
    owner = np.repeat(np.arange(len(blocks)), [len(k) for k, _ in blocks])[order]
    owner = np.minimum.reduceat(np.where(columns[0] > 0, owner, len(blocks)), first)
    return ordered[first], [np.add.reduceat(c, first) for c in columns], owner


_TOTALS = ["n1", "n2", "n3", "n4", "different", "sum", "known", "met"]


def _write_keys(path: str, keys: np.ndarray) -> None:
    """48-bit keys in order, as two arrays of 32 and 16 bits."""
    write_array(f"{path}.high.npy", (keys >> np.uint64(16)).astype(np.uint32))
    write_array(f"{path}.low.npy", (keys & np.uint64(0xFFFF)).astype(np.uint16))


def map_keys(path: str) -> np.ndarray:
    """The keys of a shard, joined from the mapped arrays."""
    return map_array(f"{path}.high.npy").astype(np.uint64) << np.uint64(16) | map_array(f"{path}.low.npy")


def _shard(model: Model, n: int, shard: int, width: int) -> tuple[np.ndarray, "Counts | _Nothing"]:
    """The mapped keys and counts of a shard; no keys where the training texts have no n-gram of its range."""
    try:
        return map_keys(model.shard(n, shard)), Counts(model.shard(n, shard))
    except FileNotFoundError:
        return np.zeros(0, np.uint64), _Nothing()


class _Nothing:
    def at(self, column: int, places: np.ndarray) -> np.ndarray:
        return np.zeros(len(places), np.int64)


def _answered(blocks: DataFrame, model: Model, n: int, learn: bool) -> DataFrame:
    """chunk, shard, answers (and totals of the shard on one of its rows); learning writes the shard's arrays first."""
    width = n_columns(n, model.order)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("chunk")
        shard = rows["shard"][0].as_py()
        keys = [from_bytes(k) for k in rows["keys"].to_pylist()]
        totals = np.zeros(len(_TOTALS), np.int64)
        if learn:
            counts = [unpack(c, len(k), width - 1) for k, c in zip(keys, rows["counts"].to_pylist())]
            different, sums, owner = _merged(list(zip(keys, counts)))
            some = np.flatnonzero(np.any(sums, axis=0))
            _write_keys(model.shard(n, shard), different[some])
            Counts.write(model.shard(n, shard), [c[some] for c in sums])
            owner = owner[some]
            seen, met = sums[0], sums[-1] if n == 1 else np.zeros(1, np.int64)
            totals[:] = [*((seen == k).sum() for k in (1, 2, 3, 4)), (seen > 0).sum(), seen.sum(), (met > 0).sum(), met.sum()]
        known, values = _shard(model, n, shard, width - 1)
        out = []
        for block, k in enumerate(keys):
            at = np.searchsorted(known, k)
            found = np.flatnonzero(at < len(known))
            found = found[known[at[found]] == k[found]]
            answer = np.zeros((width, len(k)), np.int64)
            for c in range(width - 1):
                answer[c + (c > 0), found] = values.at(c, at[found])
            if learn:
                answer[OWNED, found] = (owner[at[found]] == block) & (answer[VALUE, found] > 0)
            out.append(pack(list(answer)))
        per_row = [totals.tolist(), *([[0] * len(_TOTALS)] * (len(out) - 1))]
        sizes = pa.array([len(k) for k in keys], pa.int64())
        return pa.table({"chunk": rows["chunk"], "shard": rows["shard"], "size": sizes, "answers": pa.array(out, pa.binary()), "totals": pa.array(per_row, pa.list_(pa.int64()))})

    return blocks.groupBy("shard").applyInArrow(run, "chunk long, shard int, size long, answers binary, totals array<long>")


def _ask(chunks: DataFrame, model: Model, n: int, learn: bool) -> None:
    """One file of answers for every chunk, in the order of its n-grams; learning adds up the totals of the order."""
    width = n_columns(n, model.order)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("shard")
        parts = [np.stack(unpack(a, k, width)) for a, k in zip(rows["answers"].to_pylist(), rows["size"].to_pylist())]
        Counts.write(_answers_of(model, n, rows["chunk"][0].as_py()), list(np.concatenate(parts, axis=1)))
        sums = np.array(rows["totals"].to_pylist(), np.int64).sum(0)
        return pa.table({name: pa.array([int(x)], pa.int64()) for name, x in zip(_TOTALS, sums)})

    answered = _answered(_to_shards(chunks, model, n, learn), model, n, learn)
    done = answered.groupBy("chunk").applyInArrow(run, ", ".join(f"{name} long" for name in _TOTALS))
    sums = done.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in _TOTALS)).first()
    if learn:
        model.totals[n] = sums.asDict()


def probabilities(chunk: Chunk, grams: list[Grams], answers: list[Counts], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all tokens, each one's probability, and how often it was met in training."""
    token = np.flatnonzero(chunk.at >= 1)
    met = answers[0].at(MET if model.order > 1 else VALUE, grams[0].place[token]).astype(np.float64)
    lowest, taken = model.totals[1], model.discounts(1)
    value = answers[0].at(VALUE, grams[0].place[token]).astype(np.float64)
    share = 1 / (lowest["known"] + 1)
    p = np.full(len(token), share)
    if lowest["sum"]:
        left = (taken[1] * lowest["n1"] + taken[2] * lowest["n2"] + taken[3] * (lowest["different"] - lowest["n1"] - lowest["n2"])) / lowest["sum"]
        p = np.maximum(value - taken[np.minimum(value, 3).astype(np.int64)], 0) / lowest["sum"] + left * share
    for n in range(2, model.order + 1):
        taken = model.discounts(n)
        some = np.flatnonzero(grams[n - 1].place[token] >= 0)
        value = answers[n - 1].at(VALUE, grams[n - 1].place[token[some]]).astype(np.float64)
        context = grams[n - 2].place[token[some] - 1]
        one, two, more, total = (answers[n - 2].at(c, context).astype(np.float64) for c in (ONE, TWO, MORE, TOTAL))
        seen = np.flatnonzero(total > 0)
        value, one, two, more, total = (x[seen] for x in (value, one, two, more, total))
        left = (taken[1] * one + taken[2] * two + taken[3] * more) / total
        p[some[seen]] = np.maximum(value - taken[np.minimum(value, 3).astype(np.int64)], 0) / total + left * p[some[seen]]
    return token, p, met


def _scored(chunks: DataFrame, model: Model) -> DataFrame:
    id_type = chunks.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        total, known = model.totals[1]["met"], model.totals[1]["known"]
        for b in batches:
            for i in range(b.num_rows):
                chunk, number = Chunk(b, i), b.column("chunk")[i].as_py()
                grams = chunk.grams(model.order)
                answers = [Counts(_answers_of(model, n, number)) for n in range(1, model.order + 1)]
                token, p, met = probabilities(chunk, grams, answers, model)
                first = np.searchsorted(token, chunk.start + 1)
                base = np.log10((met + ADDED) / (total + ADDED * (known + 1)))
                n_tokens = np.diff(np.concatenate([first, [len(token)]]))
                sums = [np.add.reduceat(x, first) for x in ((met > 0).astype(np.int64), base, np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [chunk.ids, pa.array(chunk.held), pa.array(n_tokens.astype(np.int64)), pa.array(sums[0]), pa.array(np.full(len(n_tokens), total, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return chunks.mapInArrow(run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def learn(chunks: DataFrame, order: int = ORDER, shard: int = SHARD) -> Model:
    """The model of the chunks' texts that are not held out; answers on the chunks themselves lie beside it."""
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x + 1)
    n = chunks.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]
    model = Model(f"{shared_folder(chunks.sparkSession)}/model-{uuid.uuid4()}", order, max(0, (n // shard).bit_length()))
    for level in range(order, 0, -1):
        _ask(chunks, model, level, True)
        release()  # the shuffles of this order are not read again
    return model


def score(model: Model, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = CHUNK) -> DataFrame:
    """The result of `learn_and_score` for other texts under a model that is kept in its folder."""
    chunks = table(chunked(docs, F.lit(True), id_column, text_column, size), "zstd")
    asked = Model(model.folder, model.order, model.bits, model.totals)
    for level in range(1, model.order + 1):
        _ask(chunks, asked, level, False)
        release()
    scored = table(_scored(chunks, asked))
    release(chunks, *(f"{model.folder}/answers-{n}" for n in range(1, model.order + 1)))
    return scored.withColumnRenamed("id", id_column)


def learn_and_score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER, size: int = CHUNK, shard: int = SHARD) -> tuple[Model, DataFrame]:
    """The model of the texts that are not held out, and for every text held_out, n_tokens, n_known, train_tokens, base_score, score."""
    chunks = table(chunked(docs, held_out, id_column, text_column, size), "zstd")
    model = learn(chunks, order, shard)
    scored = table(_scored(chunks, model))
    release(chunks, *(f"{model.folder}/answers-{n}" for n in range(1, order + 1)))
    return model, scored.withColumnRenamed("id", id_column)
