"""Personal data: fixed forms, and terms that give away who is meant.

Base spans are e-mail and IP addresses, card and phone numbers. Masking them may not be enough: a term that appears (almost)
only near one of these entities still reveals it. Over the whole corpus, texts are counted that hold a term, an entity,
and the term near the entity (REACH words on either side). The pointwise mutual information of term and entity, as a
share of the entity's own information content, is what the term discloses: near 1 if it is never met without the entity.
From GENERALISE on a term is generalised, from REMOVE on it is removed, wherever it stands in a document that holds the
entity: REACH says what is counted, not what is masked. Most personal
values stand in one text only, so no number of texts is asked for; instead every term counts as met in DOUBT more texts
without the entity, which lowers the share of what was seen once. Documents without an entity are never touched.

Positions count code points, ends are exclusive. Terms are words without punctuation at either end, A-Z in lower case,
known by a 64-bit hash. Counts combine on the map side. Copies of a text count once in every number: texts that have copies
are shuffled to them, and texts with an entity to their flagged terms; the rest is hashes and counts.

Null and empty texts have no spans. Repeated rows give a row each and count as one text. Null ids
keep their rows. Empty tables give no rows. Other columns are not read by `find_private` and kept by `sanitised`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens, words
from .durable import table

KINDS = ["email", "ip", "card", "phone", "general", "remove"]
REACH, DOUBT = 10, 1
GENERALISE, REMOVE = 0.7, 0.9
#: Two to this power bits mark hashes of repeated texts: at most a million rows of 64 bits are broadcast at any size.
FILTER = 26
#: The forms of base spans. The digits before an address cannot belong to it, so none start in a run of them.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_MARK = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses around each @, with the longest local part that no earlier address has taken."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, entity) by kind and start; the entity is the value in a normal form."""
    out = [(0, s, e, text[s:e].lower()) for s, e in emails(text)] if "@" in text else []
    if not text.isascii() or any(c in text for c in "0123456789"):
        out += [(1, m.start(), m.end(), m[0]) for m in IP.finditer(text) if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() >= 16 else ""
            if 16 <= len(digits) <= 19 and passes_luhn(digits):
                out.append((2, m.start(), m.end(), digits))
        if "+" in text:
            for m in PHONE.finditer(text):
                digits = NOT_DIGIT.sub("", m[0])
                if 8 <= len(digits) <= 15:
                    out.append((3, m.start(), m.end(), digits))
    return out


def _terms(w: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte and hash of every word's term; words of punctuation alone have an empty one."""
    start, end = w.start.copy(), w.end.copy()
    while True:
        cut_end = (end > start) & _MARK[w.buffer[np.maximum(end - 1, 0)]]
        end -= cut_end
        cut_start = (end > start) & _MARK[w.buffer[np.minimum(start, len(w.buffer) - 1)]]
        start += cut_start
        if not (cut_end.any() or cut_start.any()):
            break
    return start, end, words.hash_ranges(_LOWER[w.buffer], start, end)


def term_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """term (hash) and n_term, the number of different texts that hold it."""

    def run(batches):
        for b in tokens.slices(batches, words.SLICE, text_column):
            w = words.find_words(b.column(0))
            start, end, h = _terms(w)
            some = end > start
            text, h = w.text[some], h[some]
            order = np.lexsort((text, h))
            text, h = text[order], h[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, bool)
            term, n = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    texts = docs.select(F.coalesce(text_column, F.lit("")).alias(text_column)).withColumn("copy", F.xxhash64(text_column))
    # A table of FILTER bits marks the hashes of texts that stand in several rows. Texts without a mark stand once and are
    # counted where they lie; only the others are brought together with their copies.
    repeated = texts.groupBy("copy").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("copy")
    slot = lambda h: F.shiftrightunsigned(h, 64 - FILTER)
    marks = repeated.select(F.shiftright(slot(F.col("copy")), 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(copy, {64 - FILTER}) & 63 as int))").alias("bit"))
    marks = table(marks.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    seen = texts.withColumn("word", F.shiftright(slot(F.col("copy")), 6)).join(F.broadcast(marks), "word", "left")
    marked = F.expr(f"coalesce(shiftrightunsigned(bits, cast(shiftrightunsigned(copy, {64 - FILTER}) & 63 as int)) & 1, 0) = 1")
    once = seen.where(marked).groupBy("copy").agg(F.first(text_column).alias(text_column))
    parts = seen.where(~marked).select(text_column).union(once.select(text_column)).mapInArrow(run, "term long, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("n_term"))


_SPAN = "struct<k:int,s:bigint,e:bigint>"
_FOUND = f"doc_id {{}}, copy long, base array<{_SPAN}>, near array<struct<entity:bigint,term:bigint>>, entities array<bigint>, terms array<bigint>, text string"


def _hash(value: str) -> int:
    raw = np.frombuffer(value.encode(), np.uint8)
    return int(words.hash_ranges(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0])


def _free_terms(column: pa.Array, found: list[list[tuple[int, int]]]):
    """For each text: start, end (code points) and hash of its words' terms, which of them may be masked, and each span's word range.

    Words that a span touches are no terms, nor are words of punctuation alone.
    """
    w = words.find_words(column)
    start, end, h = _terms(w)
    points = words.code_point_offsets(w.buffer)
    for i, spans in enumerate(found):
        own = slice(w.first[i], w.first[i + 1])
        origin = points[w.text_start[i]]
        s, e = points[start[own]] - origin, points[end[own]] - origin
        whole_s, whole_e = points[w.start[own]] - origin, points[w.end[own]] - origin
        free = e > s
        ranges = []
        for a, b in spans:
            lo, hi = int(np.searchsorted(whole_e, a, side="right")), int(np.searchsorted(whole_s, b, side="left"))
            free[lo:hi] = False
            ranges.append((lo, hi))
        yield s, e, h[own].view(np.int64), free, ranges


def _base_and_context(docs: DataFrame) -> DataFrame:
    """doc_id, copy (a hash of the text), base spans, the terms near each entity; entities, terms and text where there are spans."""
    span_type = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
    near_type = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))
    longs = pa.list_(pa.int64())

    def run(batches):
        for b in tokens.slices(batches, words.SLICE):
            found = [base_spans(t) for t in tokens.text_column(b)]
            some = [i for i, f in enumerate(found) if f]
            near, entities, terms = ([[] for _ in found] for _ in range(3))
            texts: list[str | None] = [None] * len(found)
            if some:
                chosen = b.column("text").take(pa.array(some))
                for i, text, (_, _, t, free, ranges) in zip(some, chosen.to_pylist(), _free_terms(chosen, [[x[1:3] for x in found[i]] for i in some])):
                    own = [_hash(f"{k}:{value}") for k, _, _, value in found[i]]
                    reach = [[*range(max(0, lo - REACH), lo), *range(hi, min(len(t), hi + REACH))] for lo, hi in ranges]
                    near[i] = [{"entity": x, "term": int(t[j])} for x, js in zip(own, reach) for j in js if free[j]]
                    entities[i], terms[i], texts[i] = sorted(set(own)), np.unique(t[free]), text
            base = [[{"k": k, "s": s, "e": e} for k, s, e, _ in f] for f in found]
            columns = [b.column("doc_id"), b.column("copy"), pa.array(base, span_type), pa.array(near, near_type), pa.array(entities, longs), pa.array(terms, longs), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "base", "near", "entities", "terms", "text"])

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", F.xxhash64("text"))
    return d.mapInArrow(run, _FOUND.format(d.schema["doc_id"].dataType.simpleString()))


def _with_terms(found: DataFrame) -> DataFrame:
    """doc_id, copy and spans of rows (doc_id, copy, base, flags, text): base spans and every place of a flagged term."""
    span_type = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))

    def run(batches):
        for b in tokens.slices(batches, words.SLICE):
            spans, flags = b.column("base").to_pylist(), b.column("flags").to_pylist()
            some = [i for i, f in enumerate(flags) if f]
            if some:
                known = _free_terms(b.column("text").take(pa.array(some)), [[(x["s"], x["e"]) for x in spans[i]] for i in some])
                for i, (s, e, t, free, _) in zip(some, known):
                    kind = {f["term"]: f["k"] for f in flags[i]}
                    at = np.flatnonzero(free & np.isin(t, np.array(list(kind), np.int64)))
                    spans[i] = spans[i] + [{"k": kind[int(t[j])], "s": int(s[j]), "e": int(e[j])} for j in at]
            spans = [sorted(x, key=lambda x: (x["k"], x["s"], x["e"])) for x in spans]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), pa.array(spans, span_type)], ["doc_id", "copy", "spans"])

    return found.select("doc_id", "copy", "base", "flags", "text").mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, copy long, spans array<{_SPAN}>")


def disclosing_terms(near: DataFrame, terms: DataFrame, n_texts: int, generalise: float = GENERALISE, remove: float = REMOVE, doubt: int = DOUBT) -> DataFrame:
    """entity, term and k, the kind of span of what the term discloses.

    near: copy, entity, term of every term near an entity; terms: term, n_term over all texts.
    """
    met = near.select("entity", "term", "copy").distinct()
    together = met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    entities = near.select("entity", "copy").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    known = together.join(entities, "entity").join(terms, "term")
    total = F.lit(float(max(n_texts, 1)))
    content = F.log2(total / F.col("n_entity"))
    shared = F.log2(F.col("n_both") * total / ((F.col("n_term") + doubt) * F.col("n_entity"))) / content
    kind = F.when(shared >= remove, KINDS.index("remove")).when(shared >= generalise, KINDS.index("general"))
    return known.where(content > 0).select("entity", "term", kind.alias("k")).where("k IS NOT NULL")


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, copy and spans (k, s, e) of every document, by kind and start; k is an index of KINDS."""
    found = table(_base_and_context(docs))
    near = found.where(F.size("near") > 0).select("doc_id", "copy", F.explode("near").alias("x")).select("doc_id", "copy", "x.*")
    flagged = table(disclosing_terms(near, term_counts(docs), found.select("copy").distinct().count()))
    # Copies hold the same terms and entities, so each different text is looked up once.
    once = found.where(F.size("entities") > 0).dropDuplicates(["copy"])
    told = once.select("copy", F.explode("terms").alias("term")).join(flagged, "term")
    told = told.join(once.select("copy", F.explode("entities").alias("entity")), ["copy", "entity"], "left_semi")
    # A term of two entities is removed if either asks for it.
    flags = told.groupBy("copy", "term").agg(F.max("k").alias("k")).groupBy(F.col("copy").alias("_copy")).agg(F.collect_list(F.struct("term", "k")).alias("flags"))
    plain = found.where(F.size("base") == 0).select("doc_id", "copy", F.array().cast(f"array<{_SPAN}>").alias("spans"))
    held = found.where(F.size("base") > 0).join(table(flags), F.col("copy") == F.col("_copy"), "left")
    return _with_terms(held).union(plain)


def rewrite(text: str, spans: list[dict]) -> str:
    """Spans replaced by their kind in brackets; general terms become [NUMBER] or [TERM], removed ones go."""
    out, at = [], 0
    for x in sorted(spans, key=lambda x: (x["s"], x["k"])):
        if x["s"] >= at:
            name = KINDS[x["k"]].upper()
            if name == "GENERAL":
                name = "NUMBER" if any(c.isdigit() for c in text[x["s"] : x["e"]]) else "TERM"
            out += [text[at : x["s"]], "" if name == "REMOVE" else f"[{name}]"]
        at = max(at, x["e"])
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """The same rows and columns with private data masked and disclosing terms generalised or removed."""
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_copy"))
    found = find_private(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "copy"])
    both = keyed.join(found, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_copy") == F.col("copy")), "left").select("_row.*", F.col("spans").alias("_spans"))
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in tokens.slices(batches, words.SLICE, at):
            spans = b.column(b.num_columns - 1).to_pylist()
            texts = [rewrite(t, s) if s else t for t, s in zip(b.column(at).to_pylist(), spans)]
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, docs.schema)
