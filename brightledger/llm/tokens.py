"""Byte-level BPE ids of whole texts, encoded once per distinct word.

A word between two single spaces (or single line feeds) is cut into pre-tokens in the same way wherever it stands,
so its ids can be kept in a memo. Texts with any other white space between words are encoded as one string.
Memos live in the Python worker, are shared by all of its tasks, and are emptied when they pass MEMO_WORDS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

MEMO_WORDS = 300_000
#: Fixed value: how the byte-level tokenizers cut text into pre-tokens. White space is Unicode's, without the
#: separators U+001C to U+001F that Python counts as well.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SPACE = regex.compile(r"\p{White_Space}")


class _Unusual(Exception):
    """White space other than single spaces and line feeds between words."""


class _Memo(dict):
    """Ids by word. A word that is not there yet gets an empty buffer, filled by `settle` together with the others."""

    def __init__(self, before: str):
        self.before, self.new = before, {}

    def __missing__(self, word: str) -> bytearray:
        if not word or not word.isalnum() and SPACE.search(word):
            raise _Unusual
        self[word] = self.new[word] = buffer = bytearray()
        return buffer

    def settle(self, encode_many: Callable[[list[str]], list[bytes]]) -> None:
        for (word, buffer), ids in zip(self.new.items(), encode_many([self.before + w for w in self.new])):
            buffer += ids
            self[word] = ids
        self.new.clear()
        if len(self) > MEMO_WORDS:
            self.clear()


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by a function that encodes many short strings at once."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]]):
        self.encode_many = encode_many
        self.first, self.spaced = _Memo(""), _Memo(" ")  # words that start a line; words after a space
        self.feed = encode_many(["\n"])[0]

    def _look_up(self, text: str) -> list | None:
        """The ids of its words, buffers still to be filled among them; None if the words cannot be encoded alone."""
        first, spaced, out = self.first, self.spaced.__getitem__, []
        try:
            for line in text.split("\n"):
                words = iter(line.split(" "))
                out += (self.feed, first[next(words)], *map(spaced, words))
        except _Unusual:
            return None
        return out[1:]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        found = [self._look_up(t) for t in texts]
        for memo in (self.first, self.spaced):
            memo.settle(self.encode_many)
        return [self.encode_many([t])[0] if f is None else b"".join(f) for t, f in zip(texts, found)]


def as_bytes(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def text_column(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], size: int = 4 << 20, name: str | int = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text, so that memory follows the longest text only."""
    for b in batches:
        col = b.column(name)
        at = 0
        if b.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
                yield b.slice(at, to - at)
                at = to
