"""Content-defined anchors: which windows of a corpus cannot repeat.

Every window of ``window`` symbols has one anchor, the gram of ``gram`` symbols with the smallest
hash in it (the first of equals). Equal windows have equal anchors at equal places, so a window can
only repeat if its anchor does. Neighbouring windows with one anchor form a segment. Anchors only
ever rule windows out: a segment whose anchor occurs once drops, all others stay open, and whether
their windows are equal is decided elsewhere. Nothing is sampled: every window lies in exactly one
segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .dealing import ITEMS, RUNS, answer, ask, by_key, grouped, mix, parts_of

_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = ~_LOW

#: One 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class Rolling:
    """Polynomial hashes (modulo 2^64) of any stretch of a symbol sequence, in constant time."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int = _BASE) -> None:
        n = len(values)
        if base not in self._powers or len(self._powers[base][0]) < n + 1:
            size = max(1 << 18, 1 << n.bit_length())
            step = np.full(size, base, np.uint64)
            back = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self._powers[base] = np.cumprod(step), np.cumprod(back)
        power, self.inverse = self._powers[base]
        self.n, self.prefix = n, np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=self.prefix[1:])

    def all(self, length: int) -> np.ndarray:
        count = max(0, self.n - length + 1)
        return mix((self.prefix[length : length + count] - self.prefix[:count]) * self.inverse[:count])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.prefix[start + length] - self.prefix[start]) * self.inverse[start])


def segments(values: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, ...]:
    """(document number, first window, windows, place of the anchor after it, gram hash) of every
    segment of the documents that lie in ``values`` between ``bounds``."""
    count = np.maximum(np.diff(bounds) - window + 1, 0)
    total = int(count.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    grams = Rolling(values).all(gram)
    least, span, need = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), 1, window - gram + 1
    while 2 * span <= need:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < need:
        least = np.minimum(least[: len(least) - (need - span)], least[need - span :])
    p = np.arange(total) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)
    anchor = (least[p] & _LOW).astype(np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    first, size, doc = p[cut], np.diff(np.r_[cut, total]), doc[cut]
    return doc, first - bounds[doc], size, anchor[cut] - first, grams[anchor[cut]]


def anchor_items(
    batches: Iterator[pa.RecordBatch], symbols: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], gram: int, window: int,
    parts: int, chunk: int = 1 << 20, most: int = 500_000,
) -> Iterator[pa.RecordBatch]:
    """``ITEMS`` of the segments of (key, UTF-8 text) rows, worked on in runs of about ``chunk`` bytes
    and dealt in lots of about ``most`` segments. x holds the number of windows (upper 16 bits) and
    the place of the anchor."""
    held, count = [], 0
    for part in (s for b in batches for s in slices(b, "text", chunk)):
        values, bounds = symbols([t or b"" for t in part.column("text").to_pylist()])
        doc, p, n, a, g = segments(values, bounds, gram, window)
        # Anchors are the least hashes of their windows: mixed once more, they are even again.
        held.append((mix(g), np.asarray(part.column(0), np.int64)[doc], p, n << 16 | a))
        count += len(g)
        if count >= most:
            yield ask(*(np.concatenate(c) for c in zip(*held)), parts)
            held, count = [], 0
    if count:
        yield ask(*(np.concatenate(c) for c in zip(*held)), parts)


def open_segments(texts: DataFrame, symbols: Callable, gram: int, window: int) -> DataFrame:
    """``SPANS`` (__key, p, x as n) of the segments of (__key, text as UTF-8 binary) whose anchor is
    met again. Two shuffles of packed numbers: by gram, then by document."""
    if window - gram + 1 >= 1 << 16:
        raise ValueError("a window may be at most 65534 symbols longer than its gram")
    parts = parts_of(texts.sparkSession)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_key(*answer(batches), parts)

    items = texts.mapInArrow(lambda batches: anchor_items(batches, symbols, gram, window, parts), ITEMS)
    return grouped(items.repartitionById(parts, "part").mapInArrow(told, RUNS), parts, False)


def covered(p: np.ndarray, n: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Disjoint (start, end) of the symbols in the windows of sorted runs (p, n) of starts."""
    if not len(p):
        return []
    end = np.maximum.accumulate(p + n - 1 + width)
    at = np.flatnonzero(np.r_[True, p[1:] > end[:-1]])
    return list(zip(p[at].tolist(), end[np.r_[at[1:], len(p)] - 1].tolist()))
