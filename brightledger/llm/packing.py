"""Packing of documents into training windows by Karmarkar-Karp multiway differencing.

Every document is cut into whole windows and a remainder. Remainders of a group of neighbouring documents are spread over
as few windows as can hold them: two partial partitions with the largest imbalance are merged, heavy windows on light
ones, until one partition is left, whose windows are nearly equal. Whenever a window exceeds the capacity, the window
count rises if documents must stay whole; if they may be cut, only the excess is cut off and moved to windows with room.

A group is a run of documents of one partition. It ends with GROUP_TOKENS ids, or when its documents times its windows reach
GROUP_PLACES, which bounds its memory however short the documents are. So packing needs no shuffle, no source or
length can make a group large, and a task repeated after a lost executor gives the same windows.

Null text is an empty document. Empty tables give no pieces. Repeated rows are packed as often as they occur, ties keep
the row order, null ids stay null, and other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from . import bpe, tokens

GROUP_TOKENS = 1_000_000
#: Documents of a group times its windows: one four-byte place each is kept while a group is packed.
GROUP_PLACES = 8_000_000
SCHEMA = "doc_id {}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of every size, of near-equal sums, by multiway differencing.

    A partial partition is a vector of window sums, heaviest first. Merging adds the heaviest windows of one to the
    lightest of the other; what went where is kept as one permutation a merge and read back from the last to the first.
    """
    n = len(sizes)
    if windows <= 1 or n <= 1:
        return np.zeros(n, np.int64)
    order = count()
    partial: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes.tolist()):
        heap.append((-s, next(order), i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []

    def sums(node: int) -> np.ndarray:
        if node >= n:
            return partial.pop(node)
        v = np.zeros(windows, np.int64)
        v[0] = sizes[node]
        return v

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sums(a) + sums(b)[::-1]
        by = np.argsort(-both).astype(np.int32)
        merges.append((a, b, by))
        node = n + len(merges) - 1
        both = both[by]
        partial[node] = both - both[-1]
        heapq.heappush(heap, (-int(partial[node][0]), next(order), node))
    out = np.zeros(n, np.int64)
    places = {n + len(merges) - 1: np.arange(windows)}  # node -> window of each of its slots
    for k in range(len(merges) - 1, -1, -1):
        a, b, by = merges[k]
        slots = np.empty(windows, np.int64)
        slots[by] = places.pop(n + k)
        for child, own in ((a, slots), (b, slots[::-1])):
            if child < n:
                out[child] = own[0]
            else:
                places[child] = own
    return out


def pack_lengths(lengths, capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of at most `capacity`, each a list of (item, start, length); items of length 0 are left out.

    cut: items may be divided. Otherwise every item of at most `capacity` stays whole and longer ones are divided only
    at multiples of it.
    """
    lengths = np.asarray(lengths, np.int64)
    out = [[(i, k * capacity, capacity)] for i in np.flatnonzero(lengths >= capacity).tolist() for k in range(int(lengths[i]) // capacity)]
    rest = lengths % capacity
    items = np.flatnonzero(rest)
    if not len(items):
        return out
    sizes = rest[items]
    windows = -(-int(sizes.sum()) // capacity)
    while True:
        place = difference(sizes, windows)
        total = np.bincount(place, sizes, windows).astype(np.int64)
        over = int(np.maximum(total - capacity, 0).sum())
        if not over or cut:
            break
        windows += max(1, over // capacity)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(windows)]
    for i, w in zip(items.tolist(), place.tolist()):
        held[w].append((i, int(lengths[i] - rest[i]), int(rest[i])))
    loose: list[tuple[int, int, int]] = []
    for w in np.flatnonzero(total > capacity).tolist():
        excess = int(total[w]) - capacity
        held[w].sort(key=lambda x: (x[2], x[0]))
        while excess:
            i, start, n = held[w].pop()
            off = min(excess, n)
            loose.append((i, start + n - off, off))
            if n > off:
                held[w].append((i, start, n - off))
            excess -= off
    for w in np.argsort(total, kind="stable")[::-1].tolist():  # fullest first, so that what stays empty is one window's end
        room = capacity - int(total[w])
        while loose and room > 0:
            i, start, n = loose.pop()
            held[w].append((i, start, min(n, room)))
            if n > room:
                loose.append((i, start + room, n - room))
            room -= min(n, room)
    return out + [h for h in held if h]


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per piece: its ids (little-endian unsigned 32-bit) and its place in a window. Every document ends with `end_id`."""
    end = tokens.as_bytes([end_id])

    def pack(held: list[tuple[object, bytes]], sequence: Iterator[int]) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for window in pack_lengths([len(x) // 4 for _, x in held], capacity):
            number, offset = next(sequence), 0
            for i, start, n in window:
                doc, ids = held[i]
                for c, v in zip(cols, (doc, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, number, offset)):
                    c.append(v)
                offset += n
        kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def run(batches):
        c, sequence = bpe.codec(path), count(TaskContext.get().partitionId() << 40)
        held, size = [], 0
        for b in tokens.slices(batches, name=text_column):
            for doc, ids in zip(b.column(0).to_pylist(), c.words.encode_all(tokens.text_column(b, text_column))):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= GROUP_TOKENS or len(held) * (size // capacity + 1) >= GROUP_PLACES:
                    yield pack(held, sequence)
                    held, size = [], 0
        if held:
            yield pack(held, sequence)

    d = docs.select(id_column, text_column)
    kind = d.schema[id_column].dataType.simpleString()
    id_type = to_arrow_type(d.schema[id_column].dataType)
    return d.mapInArrow(run, SCHEMA.format(kind))
