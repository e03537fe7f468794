"""Byte-pair encoding and decoding of whole texts by merge ranks, without a tokenizer library.

A short pre-token holds its parts and the ranks of adjacent parts in two contiguous arrays: the smallest rank is found
by a scan, its boundary is deleted and the two neighbouring ranks are refreshed. All new pre-tokens of one length take
each step together, as rows of a matrix. Scans of a long pre-token would cost the square of its length, so beyond SHORT
bytes the same merges are taken from a heap over linked parts.

Null text is an empty text with no ids. Rows are kept one to one: repeated rows and repeated or null doc_ids give a row
each. An empty table gives an empty result. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import gc
import heapq
import json
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import tokens

SHORT = 64
_NONE = 1 << 60


def _printable_bytes() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def default_path() -> str:
    """The 50k byte-level vocabulary among the public tokenizers, which every node has."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """Merge ranks and token bytes of a byte-level BPE file in the tokenizers format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _printable_bytes()
        vocab = spec["model"]["vocab"]
        self.token_bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.merged = np.array([vocab[a + b] for a, b in pairs] or [0], np.int64)
        keys = np.array([a << 32 | b for a, b in self.rank] or [-1], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([*self.rank.values()] or [_NONE], np.int64)[order]
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.pre_token = regex.compile(tokens.PRE_TOKEN)
        self.words = tokens.WordEncoder(self.encode_strings)
        self.decimal = [str(i) for i in range(max(self.token_bytes) + 1)]
        self.piece = [self.token_bytes.get(i, b"") for i in range(len(self.decimal))]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids, _NONE where the pair never merges."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge_rows(self, raw: np.ndarray) -> list[bytes]:
        """Ids of short pre-tokens of one length; raw: their bytes, a row each."""
        ids = self.byte_id[raw]
        out: list[bytes] = [b""] * len(ids)
        ranks, row = self._ranks(ids[:, :-1], ids[:, 1:]), np.arange(len(ids))
        while len(row):
            if not ranks.shape[1]:
                best, done = None, np.ones(len(row), bool)
            else:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(row)), at]
                done = best == _NONE
            ended, size = tokens.as_bytes(ids[done]), 4 * ids.shape[1]
            for k, r in enumerate(row[done].tolist()):
                out[r] = ended[k * size : (k + 1) * size]
            if best is None:
                break
            go = ~done
            row, ids, ranks, at, best = row[go], ids[go], ranks[go], at[go], best[go]
            n, i = ids.shape[1], np.arange(len(row))
            ids[i, at] = self.merged[best]
            ids = ids[np.arange(n) != at[:, None] + 1].reshape(len(row), n - 1)
            ranks = ranks[np.arange(n - 1) != at[:, None]].reshape(len(row), n - 2)
            for left in (at - 1, at):
                k = np.flatnonzero((left >= 0) & (left < n - 2))
                ranks[k, left[k]] = self._ranks(ids[k, left[k]], ids[k, left[k] + 1])
        return out

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens."""
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        out: list[bytes] = [b""] * len(words)
        for n, at in by_length.items():
            if n > SHORT:
                found = [tokens.as_bytes(self._merge_long(self.byte_id[np.frombuffer(words[k], np.uint8)].tolist())) for k in at]
            else:
                found = self.merge_rows(np.frombuffer(b"".join([words[k] for k in at]), np.uint8).reshape(len(at), n))
            for k, x in zip(at, found):
                out[k] = x
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rank.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue  # one of the parts has been merged since
            ids[i], ids[j], right[i] = int(self.merged[r]), -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (s := get((ids[k], ids[right[k]]))) is not None:
                    heapq.heappush(heap, (s, k, ids[k], ids[right[k]]))
        return [x for x in ids if x >= 0]

    def encode_strings(self, texts: list[str]) -> list[bytes]:
        """Ids of many strings, each of whose distinct pre-tokens is merged once."""
        seen: dict[str, int] = {}
        plan: list[list[int] | int] = []  # a string's pre-tokens; specials are below zero
        for t in texts:
            if t.isalpha() or t[:1] == " " and t[1:].isalpha():
                plan.append(seen.setdefault(t, len(seen)))
                continue
            own: list[int] = []
            for part in self.special_split.split(t) if self.special_split else (t,):
                if part in self.special:
                    own.append(~self.special[part])
                else:
                    own += [seen.setdefault(w, len(seen)) for w in self.pre_token.findall(part)]
            plan.append(own)
        merged = self.merge_all([w.encode() for w in seen])
        return [merged[p] if isinstance(p, int) else b"".join([merged[k] if k >= 0 else tokens.as_bytes([~k]) for k in p]) for p in plan]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.words.encode_all(texts)]

    def decode(self, ids) -> str:
        """The text of ids; bytes that form no character become U+FFFD."""
        return b"".join([self.piece[i] for i in ids]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and file. Its memos are millions of small objects without cycles, which the collector need not walk."""
    if path not in _CODECS:
        gc.disable()
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ids of every text as array<int>."""

    def run(batches):
        c = codec(path)
        for b in tokens.slices(batches, name=text_column):
            ids = [x.astype(np.int32) for x in c.encode_all(tokens.text_column(b, text_column))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_column, "ids"])

    d = docs.select(id_column, text_column)
    return d.mapInArrow(run, f"`{id_column}` {d.schema[id_column].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The text of every array of ids; a null array is an empty text."""

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [c.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    d = encoded.select(id_column, ids_column)
    return d.mapInArrow(run, f"`{id_column}` {d.schema[id_column].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every document, in one narrow pass."""

    def run(batches):
        c = codec(path)
        for b in tokens.slices(batches):
            n, of_ids, of_text = [], [], []
            for ids in map(np.ndarray.tolist, c.encode_all(tokens.text_column(b))):
                n.append(len(ids))
                of_ids.append(sha256(",".join([c.decimal[i] for i in ids]).encode()).hexdigest())
                of_text.append(sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
