"""Words of many texts at once: positions and hashes as arrays.

Words are runs of characters other than space and U+0009 to U+000D. All texts of a batch lie in one byte buffer, each
followed by a line feed, so that no word or window crosses two texts unnoticed. A hash is a polynomial over 64 bits,
read from prefix sums and mixed, and depends on the content alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words are looked at together: positions and hashes take dozens of times as much memory.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    key = int(inverse)
    if key not in _POWERS or len(_POWERS[key]) < n:
        base = np.full(max(n, 1 << 16), pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
        base[0] = 1
        _POWERS[key] = np.cumprod(base)
    return _POWERS[key][:n]


def hash_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for every pair of bounds."""
    sums = np.zeros(len(values) + 1, np.uint64)
    # One array holds the terms and then their sums.
    np.add(values, np.uint64(1), out=sums[1:], dtype=np.uint64, casting="unsafe")
    sums[1:] *= _powers(len(values))
    np.cumsum(sums[1:], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(len(values) + 1, True)[starts])


@dataclass
class Words:
    buffer: np.ndarray  # bytes of all texts
    space: np.ndarray  # which of them are white space
    text_start: np.ndarray  # byte where each text begins, and one past the last
    start: np.ndarray  # byte where each word begins
    end: np.ndarray
    text: np.ndarray  # index of each word's text
    first: np.ndarray  # index of each text's first word, and one past the last

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.buffer, self.start, self.end)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of `size` consecutive words of one text."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[size - 1 :] == self.text[:n])
        return at, hash_ranges(hashes, at, at + size)


def find_words(column: pa.Array) -> Words:
    """Words of a string column; null counts as an empty text."""
    lengths = np.array([0 if x is None else x for x in pc.binary_length(column).to_pylist()], np.int64)
    raw = [memoryview(x.as_buffer()) if x.is_valid else b"" for x in column.cast(pa.binary())]
    buffer = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    text_start = np.concatenate([[0], np.cumsum(lengths + 1)])
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buffer) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    text = np.searchsorted(text_start, start, side="right") - 1
    return Words(buffer, space, text_start, start, end, text, np.searchsorted(text, np.arange(len(lengths) + 1)))


def code_point_offsets(buffer: np.ndarray) -> np.ndarray:
    """Code points before each byte, and one more for the end."""
    return np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
