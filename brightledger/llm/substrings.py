"""Repeated passages: every window of consecutive words that an earlier document, or this one earlier, already has.

No text is compared with all others. A window's anchor is the smallest hash among its runs of ANCHOR words; equal windows
have equal anchors, and neighbouring windows share one, so a document is a short list of pieces: stretches of windows
with one anchor. Only anchors met twice can hold repeats. Their pieces are grouped into classes of equal content:

- in all members but a class's first every window is repeated;
- the first member of an anchor's only class is new;
- first members of an anchor with several classes may share some windows. These pieces are the reference, dealt into
  shards by anchor: pieces stream in order of their position past the suffix automaton of the anchor's earlier pieces,
  whose matching statistics give the maximal shared spans, and are then added to it.

Shards are dealt to the tasks rather than broadcast to all of them: the reference grows with the corpus, and a window
can only match in the shard of its anchor. An anchor with more than SHARD classes is not put into one automaton; its
windows are compared by hash, with minima combined on the map side.

Positions are word numbers. Null and empty texts have no words. A null doc_id counts as the smallest. Rows that repeat a
doc_id are one place: at the same start neither is earlier. Empty tables give no rows. `deduplicated` keeps all rows and
columns, also those whose names it uses itself.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import tokens, words
from .durable import table

WINDOW, ANCHOR = 20, 6
SHARD = 1_000
_ALL, _SOME, _HOT = 0, 1, 2


class SuffixAutomaton:
    """Of several sequences; every substring of one of them is a path from state 0."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state of the shorter strings of q that p reaches by c."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new

    def matching_statistics(self, sequence) -> list[int]:
        """For each end, the length of the longest match that ends there."""
        out, state, n = [], 0, 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            out.append(n)
        return out


def _anchors(w: words.Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of every piece."""
    at, _ = w.windows(h, window)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    runs = words.hash_ranges(h, np.arange(len(h) - ANCHOR + 1), np.arange(ANCHOR, len(h) + 1))
    least = np.lib.stride_tricks.sliding_window_view(runs, window - ANCHOR + 1)[at].argmin(1) + at
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)]))
    return at[new], np.diff(np.append(new, len(at))), runs[least[new]]


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """_d and _t: the place of a document in the order, and its text."""
    return docs.select(F.coalesce(F.col(id_column), F.lit(-(1 << 63))).cast("long").alias("_d"), F.coalesce(F.col(text_column), F.lit("")).alias("_t"))


def _tags(w: words.Words) -> np.ndarray:
    """24 bits of each text's hash, which tell rows with one doc_id apart."""
    return (words.hash_ranges(w.buffer, w.text_start[:-1], w.text_start[1:] - 1) & np.uint64(0xFFFFFF)).astype(np.int64)


def _place(start: np.ndarray, n: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """First window, number of windows and text tag in one long, which sorts by the first window."""
    return start.astype(np.int64) << 31 | n.astype(np.int64) << 24 | tag


def _start(place: Column) -> Column:
    return F.shiftright(place, 31)


def _pieces(keyed: DataFrame, window: int) -> DataFrame:
    """a (anchor), p (content), _d and the place at of every piece."""

    def run(batches):
        for b in tokens.slices(batches, words.SLICE, "_t"):
            w = words.find_words(b.column("_t"))
            h = w.hashes()
            start, n, anchor = _anchors(w, h, window)
            content = words.hash_ranges(h, start, start + n + window - 1)
            text = w.text[start] if len(start) else start
            d = b.column("_d").to_numpy(zero_copy_only=False)[text]
            at = _place(start - w.first[text], n, _tags(w)[text])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.view(np.int64), content.view(np.int64), d, at)], ["a", "p", "_d", "at"])

    return keyed.mapInArrow(run, "a long, p long, _d long, at long")


def _marked(keyed: DataFrame, window: int) -> DataFrame:
    """_d, at and kind of the pieces that are repeated (_ALL) or may be in part (_SOME, _HOT)."""
    pieces = _pieces(keyed, window)
    # Aggregates are written before they are joined: a join of two plain exchanges is one whose hot anchors Spark can split.
    twice = table(pieces.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a"))
    seen = table(pieces.join(twice, "a"))
    classes = table(seen.groupBy("a", "p").agg(F.min(F.struct("_d", "at")).alias("first")))
    several = classes.groupBy("a").agg(F.count(F.lit(1)).alias("classes"))
    known = table(classes.join(several, "a").select("a", "p", "first", "classes"))
    is_first = (F.col("_d") == F.col("first._d")) & (_start(F.col("at")) == _start(F.col("first.at")))
    kind = F.when(~is_first, _ALL).when((F.col("classes") > 1) & (F.col("classes") <= SHARD), _SOME).when(F.col("classes") > SHARD, _HOT)
    marked = seen.join(known, ["a", "p"]).select("_d", "at", kind.alias("kind"))
    return marked.where("kind IS NOT NULL")


def _unpacked(marks: list[int], tag: int) -> list[tuple[int, int]]:
    """(first window, windows) of the marks of the text with this tag."""
    return [(m >> 31, m >> 24 & 127) for m in marks if m & 0xFFFFFF == tag]


def _reference(open_docs: DataFrame, window: int) -> DataFrame:
    """a, _d, tag, s, hot and the word hashes of the pieces that are still undecided: 32 bits a word, many words a window."""

    def run(batches):
        for b in tokens.slices(batches, words.SLICE, "_t"):
            w = words.find_words(b.column("_t"))
            h, tags = w.hashes(), _tags(w).tolist()
            rows = []
            for i, d in enumerate(b.column("_d").to_pylist()):
                for hot, name in ((False, "some"), (True, "hot")):
                    for start, n in _unpacked(b.column(name)[i].as_py(), tags[i]):
                        own = h[w.first[i] + start : w.first[i] + start + n + window - 1]
                        runs = words.hash_ranges(own, np.arange(window - ANCHOR + 1), np.arange(ANCHOR, window + 1))
                        rows.append((int(runs.min().view(np.int64)), d, tags[i], start, hot, (own >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["a", "_d", "tag", "s", "hot", "w"])

    return open_docs.mapInArrow(run, "a long, _d long, tag long, s long, hot boolean, w array<int>")


def _shared_spans(reference: DataFrame, window: int) -> DataFrame:
    """_d and at of the stretches of windows that an earlier piece of the same anchor has.

    Of equal starts in rows with one doc_id none is earlier, so their pieces are matched before any of them is added.
    """

    def run(batches):
        anchor, automaton, waiting, place = None, None, [], None
        for b in batches:
            out = []
            for a, d, tag, s, w in zip(*(b.column(c).to_pylist() for c in ("a", "_d", "tag", "s", "w"))):
                if a != anchor:
                    anchor, automaton, waiting, place = a, SuffixAutomaton(), [], None
                if (d, s) != place:
                    for x in waiting:
                        automaton.add(x)
                    waiting, place = [], (d, s)
                hit = [i - window + 1 for i, n in enumerate(automaton.matching_statistics(w)) if n >= window]
                while hit:
                    n = next((k for k in range(1, len(hit)) if hit[k] != hit[0] + k), len(hit))
                    out.append((d, (s + hit[0]) << 31 | n << 24 | tag))
                    hit = hit[n:]
                waiting.append(w)
            columns = list(zip(*out)) if out else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_d", "at"])

    dealt = reference.repartition("a").sortWithinPartitions("a", "_d", "s", "tag")
    return dealt.mapInArrow(run, "_d long, at long")


def _shared_windows(reference: DataFrame, window: int) -> DataFrame:
    """The same by hashes of single windows."""
    at = F.sequence(F.lit(0), F.size("w") - window)
    each = reference.select("_d", "tag", "s", F.explode(F.transform(at, lambda i: F.struct(i.alias("i"), F.slice("w", i + 1, F.lit(window)).alias("w")))).alias("x"))
    each = each.select("_d", "tag", (F.col("s") + F.col("x.i")).alias("s"), F.xxhash64("x.w").alias("v"))
    first = each.groupBy("v").agg(F.min(F.struct("_d", "s")).alias("first"))
    late = each.join(first, "v").where((F.col("_d") != F.col("first._d")) | (F.col("s") != F.col("first.s")))
    return late.select("_d", (F.shiftleft("s", 31) + F.lit(1 << 24) + F.col("tag")).alias("at"))


def repeated_windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and by _d the packed stretches of windows that occur earlier."""
    if window - ANCHOR + 1 > 127 or window < ANCHOR:
        raise ValueError("a window has at least as many words as an anchor and at most 126 more")
    keyed = _keyed(docs, id_column, text_column)
    of_kind = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("at")))
    marks = table(_marked(keyed, window).groupBy("_d").agg(of_kind(_ALL).alias("all"), of_kind(_SOME).alias("some"), of_kind(_HOT).alias("hot")))
    # The texts are dealt by _d here and once more by the caller: one exchange, which Spark reuses.
    open_docs = keyed.join(marks.where(F.size("some") + F.size("hot") > 0), "_d")
    reference = _reference(open_docs.select("_d", "_t", "some", "hot"), window)
    shared = _shared_spans(reference.where(~F.col("hot")), window).union(_shared_windows(reference.where("hot"), window))
    shared = shared.groupBy("_d").agg(F.collect_list("at").alias("shared"))
    both = marks.join(shared, "_d", "left")
    repeats = F.concat("all", F.coalesce("shared", F.array().cast("array<bigint>")))
    return keyed, both.select("_d", repeats.alias("repeats")).where(F.size("repeats") > 0)


def _kept_words(w: words.Words, i: int, repeats: list[tuple[int, int]], window: int) -> np.ndarray:
    """Numbers, in the batch, of the words of text i that no repeated window covers."""
    first, last = int(w.first[i]), int(w.first[i + 1])
    if not repeats:
        return np.arange(first, last)
    cover = np.zeros(last - first + 1, np.int64)
    for start, n in repeats:
        cover[start] += 1
        cover[start + n + window - 1] -= 1
    return first + np.flatnonzero(np.cumsum(cover[:-1]) == 0)


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every document."""
    keyed, repeats = repeated_windows(docs, window=window)
    all_docs = keyed.join(repeats, "_d", "left")

    def run(batches):
        for b in tokens.slices(batches, words.SLICE, "_t"):
            w = words.find_words(b.column("_t"))
            raw, n, removed, digest = w.buffer.tobytes(), np.diff(w.first), [], []
            tags = _tags(w).tolist()
            for i, m in enumerate(b.column("repeats").to_pylist()):
                kept = _kept_words(w, i, _unpacked(m or [], tags[i]), window)
                removed.append(int(n[i]) - len(kept))
                digest.append(sha256(b" ".join([raw[s:e] for s, e in zip(w.start[kept].tolist(), w.end[kept].tolist())])).hexdigest())
            ids = [None if d == -(1 << 63) else d for d in b.column("_d").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return all_docs.select("_d", "_t", "repeats").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut_text(text: str, start: list[int], end: list[int], gone: set[int]) -> str:
    """The text without the given words and the white space before each; positions in bytes."""
    raw, out, at = text.encode(), [], 0
    for k, (s, e) in enumerate(zip(start, end)):
        if k in gone:
            out.append(b"" if k and k - 1 in gone else raw[at : start[k]].rstrip(b" "))
            at = e
    return b"".join([*out, raw[at:]]).decode().strip(" ")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same rows and columns, texts without their repeated words; a text without repeats is left as it is."""
    names = docs.columns
    _, repeats = repeated_windows(docs, window=window)
    packed = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_d"))
    both = packed.join(repeats, "_d", "left").select("_row.*", F.col("repeats").alias("_repeats"))
    at = names.index("text")

    def run(batches):
        for b in tokens.slices(batches, words.SLICE, at):
            texts = b.column(at).to_pylist()
            w = words.find_words(b.column(at))
            tags = _tags(w).tolist()
            for i, m in enumerate(b.column(len(names)).to_pylist()):
                m = _unpacked(m or [], tags[i])
                if m:
                    first, origin = int(w.first[i]), int(w.text_start[i])
                    own = slice(first, int(w.first[i + 1]))
                    gone = set(range(int(w.first[i + 1]) - first)) - set((_kept_words(w, i, m, window) - first).tolist())
                    texts[i] = _cut_text(texts[i], (w.start[own] - origin).tolist(), (w.end[own] - origin).tolist(), gone)
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, docs.schema)
