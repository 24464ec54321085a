"""Sequence packing: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .encoding import encoder

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


class CapacityTree:
    """Open windows by the room left in them. Leaf r holds the windows with r ids of room; an inner
    node counts the windows below it, so the smallest sufficient room is found in log steps."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with at least ``need`` room; it is removed."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node <<= 1
                if not count[node]:
                    node += 1
        room = node - self.size
        window = self.windows[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of positions in ``lengths`` (each 1..capacity; given in falling order)."""
    tree, windows = CapacityTree(capacity), []
    for i, n in enumerate(lengths):
        found = tree.take(n)
        if found is None:
            room, w = capacity, len(windows)
            windows.append([])
        else:
            room, w = found
        windows[w].append(i)
        if room > n:
            tree.add(room - n, w)
    return windows


def pack_block(pieces: list[tuple[int, int, int]], capacity: int, max_padding: float) -> list[list[tuple[int, int, int]]]:
    """Pack pieces (document, start, length), none longer than ``capacity``, into windows.

    Best-fit decreasing first. Where equal lengths leave more padding than ``max_padding`` of all
    room, the emptiest windows are dissolved and their pieces cut into the gaps of the others."""
    order = sorted(pieces, key=lambda p: (-p[2], p[0], p[1]))
    windows = [[order[i] for i in w] for w in best_fit_decreasing([p[2] for p in order], capacity)]
    load = lambda w: sum(p[2] for p in w)
    windows.sort(key=load)
    gaps = [capacity - load(w) for w in windows]
    padding, first, last = sum(gaps), 0, len(windows) - 1
    while first < last and padding > max_padding * capacity * (len(windows) - first):
        if sum(gaps[first + 1 :]) < capacity - gaps[first]:
            break
        todo, windows[first] = windows[first], []
        for doc, start, n in todo:
            while n:
                while not gaps[last]:
                    last -= 1
                cut = min(n, gaps[last])
                windows[last].append((doc, start, cut))
                gaps[last] -= cut
                start, n = start + cut, n - cut
        padding -= capacity
        first += 1
    return [w for w in windows if w]


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = 2048,
    block_tokens: int = 4 << 20,
    max_padding: float = 0.005,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and pack the ids into sequences of at most
    ``capacity``; one row for each piece, with its ids as little-endian unsigned 32-bit integers.

    Each task packs blocks of about ``block_tokens`` ids from its own input partition, so nothing is
    shuffled, memory is bounded by the block, and a hot source or key cannot gather in one task. A
    document longer than ``capacity`` is first cut into full windows. Sequence ids are unique, not
    consecutive (partition number, then a count); a lost task is packed again as a whole.

    A null text counts as empty (its one id is ``end_id``); null and repeated ids are kept as given,
    each row is a document of its own. An empty table gives an empty result. Other columns are not
    read. Texts of any length work: a document may span many sequences and blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "ids")
        tail = np.array([end_id], "<u4").tobytes()
        base, used = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int | None, int, bytes]] = []
        pieces: list[tuple[int, int, int]] = []
        rows: list[list] = [[] for _ in range(7)]
        size = 0

        def put(doc: int, start: int, n: int, seq: int, offset: int) -> None:
            key, total, data = held[doc]
            for column, v in zip(rows, (key, start, n, data[4 * start : 4 * (start + n)], total, base + seq, offset)):
                column.append(v)

        def out() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)
            for c in rows:
                c.clear()
            return made

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used, size
            for window in pack_block(pieces, capacity, max_padding):
                offset = 0
                for doc, start, n in window:
                    put(doc, start, n, used, offset)
                    offset += n
                used += 1
                if len(rows[0]) >= 4000:
                    yield out()
            held.clear()
            pieces.clear()
            size = 0
            if rows[0]:
                yield out()

        for part in (p for batch in batches for p in slices(batch, "text", 1 << 20)):
            texts = [t or "" for t in part.column(1).to_pylist()]
            for key, data in zip(part.column(0).to_pylist(), enc.ids(texts)):
                data += tail
                total, start = len(data) // 4, 0
                held.append((key, total, data))
                while total - start >= capacity:  # full windows need no search
                    put(len(held) - 1, start, capacity, used, 0)
                    used, start = used + 1, start + capacity
                    if len(rows[0]) >= 4000:
                        yield out()
                if start < total:
                    pieces.append((len(held) - 1, start, total - start))
                size += total
                if size >= block_tokens:
                    yield from flush()
        yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
