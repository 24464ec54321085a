"""Numbers dealt as packed arrays: one row for each part and lot instead of one for each number.

A map task sorts a lot of coded items by their 64-bit codes, keeps one of equal ones and sends, for
each part of the code range, one row that holds the items' columns as binary arrays. Parts are ranges
of the codes' upper half, given by number, so every part is one task and codes spread evenly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What is known of an item: its code must be met elsewhere, or it is known to repeat already.
_ASK, _SEVERAL, _KNOWN = range(3)

_ITEMS = {"code": np.uint64, "low": np.uint32, "high": np.uint32, "p": np.uint32, "x": np.uint64, "state": np.uint8}
_RUNS = {"low": np.uint32, "high": np.uint32, "p": np.uint32, "n": np.uint32}
ITEMS, RUNS = ("part int, " + ", ".join(f"{n} binary" for n in kinds) for kinds in (_ITEMS, _RUNS))
SPANS = "__key long, p binary, n binary"


def parts_of(spark: SparkSession) -> int:
    """Parts to deal to: what the session shuffles to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal in, equal out; close inputs far apart."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xCA5A826395121157)
    return x ^ (x >> np.uint64(32))


def runs_of(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``start``, range after range."""
    total = int(length.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)


def binaries(array: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """An array's stretches between ``cuts`` as binary values, without a copy."""
    data = np.ascontiguousarray(array)
    offsets = (cuts * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _halves(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = key.astype(np.int64).view(np.uint64)
    return k.astype(np.uint32), (k >> np.uint64(32)).astype(np.uint32)


def _key(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))).view(np.int64)


def _part(code: np.ndarray, parts: int) -> np.ndarray:
    return ((code >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _rows(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row for each run of equal ``part``s."""
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    cuts = np.r_[at, len(part)]
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), *(binaries(c, cuts) for c in columns)], ["part", *names])


def _arrays(batches: Iterator[pa.RecordBatch], kinds: dict) -> list[np.ndarray]:
    held: list[list[bytes]] = [[] for _ in kinds]
    for b in batches:
        for h, name in zip(held, kinds):
            h += b.column(name).to_pylist()
    return [np.frombuffer(b"".join(h), t) for h, t in zip(held, kinds.values())]


def ask(code: np.ndarray, key: np.ndarray, p: np.ndarray, x: np.ndarray, parts: int, both: bool = False) -> pa.RecordBatch:
    """``ITEMS`` rows of one lot. Of equal codes (with ``both``: equal in x too) the first item asks by
    its code and says that there are several; the others are known to repeat and are spread evenly,
    so a frequent code sends one item for each lot to its part."""
    order = np.lexsort((x, code)) if both else np.argsort(code, kind="stable")
    c = code[order]
    same = np.r_[False, (c[1:] == c[:-1]) & (not both or x[order[1:]] == x[order[:-1]])]
    state = np.where(np.r_[same[1:], False], _SEVERAL, _ASK)
    state[same] = _KNOWN
    part = _part(c, parts)
    known = np.flatnonzero(same)
    part[known] = np.arange(len(known)) * parts // max(1, len(known))
    again = np.lexsort((np.arange(len(part)), part)) if len(known) else np.arange(len(part))
    pick = order[again]
    low, high = _halves(key[pick])
    columns = [c[again], low, high, p[pick].astype(np.uint32), x[pick].astype(np.uint64), state[again].astype(np.uint8)]
    return _rows(part[again], columns, list(_ITEMS))


def answer(batches: Iterator[pa.RecordBatch], both: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, p, x) of one part's items whose codes (with ``both``: and x) are met again."""
    code, low, high, p, x, state = _arrays(batches, _ITEMS)
    keep = state != _ASK
    at = np.flatnonzero(state != _KNOWN)
    at = at[np.lexsort((x[at], code[at])) if both else np.argsort(code[at], kind="stable")]
    same = (code[at[1:]] == code[at[:-1]]) & (not both or x[at[1:]] == x[at[:-1]])
    keep[at[1:][same]] = True
    keep[at[:-1][same]] = True
    return _key(low[keep], high[keep]), p[keep].astype(np.int64), x[keep].view(np.int64)


def by_key(key: np.ndarray, p: np.ndarray, n: np.ndarray, parts: int, lot: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """``RUNS`` rows of (key, p, n), dealt by key."""
    for i in range(0, len(key), lot):
        k = key[i : i + lot]
        part = _part(mix(k.astype(np.int64).view(np.uint64)), parts)
        order = np.argsort(part, kind="stable")
        low, high = _halves(k[order])
        columns = [low, high, p[i : i + lot][order].astype(np.uint32), n[i : i + lot][order].astype(np.uint32)]
        yield _rows(part[order], columns, list(_RUNS))


def grouped(rows: DataFrame, parts: int, join: bool) -> DataFrame:
    """``SPANS``: one row for each key of ``RUNS`` rows, its entries in the order of p as packed
    32-bit arrays; with ``join``, runs of starts that touch or overlap are made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, p, n = _arrays(batches, _RUNS)
        key, p, n = _key(low, high), p.astype(np.int64), n.astype(np.int64)
        order = np.lexsort((p, key))
        key, p, n = key[order], p[order], n[order]
        if join and len(key):
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            # Ends so far within a key: keys are laid out one after the other, so a running maximum serves.
            gap = np.repeat(np.cumsum(np.r_[0, np.maximum.reduceat(p + n, new)[:-1] + 1]), np.diff(np.r_[new, len(key)]))
            reach = np.maximum.accumulate(p + n + gap)
            at = np.flatnonzero(np.r_[True, (p + gap)[1:] > reach[:-1]])
            last = np.r_[at[1:], len(key)] - 1
            key, p, n = key[at], p[at], (reach - gap)[last] - p[at]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        cuts = np.r_[at, len(key)]
        p, n = p.astype(np.uint32), n.astype(np.uint32)
        for i in range(0, len(at), 1 << 14):
            j = min(len(at), i + (1 << 14))
            own = cuts[i : j + 1]
            arrays = [pa.array(key[at[i:j]]), binaries(p[own[0] : own[-1]], own - own[0]), binaries(n[own[0] : own[-1]], own - own[0])]
            yield pa.RecordBatch.from_arrays(arrays, ["__key", "p", "n"])

    return rows.repartitionById(parts, "part").mapInArrow(run, SPANS)


def numbers(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.uint32).astype(np.int64)
