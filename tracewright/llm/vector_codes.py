"""Vector codes: product quantisation, its codebooks fitted by Elkan's form of Lloyd's rounds.

All distances that decide are squared integers. Floating-point bounds only rule entries out, and
strictly: an upper bound of the distance to the own entry and a lower bound for every entry live with
each vector from round to round and move by as much as the entries moved. Upper bounds are rounded up
and lower ones down, so what they rule out is farther than the own entry and never as near; all other
entries are compared as integers, ties going to the lower index.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, dealt_join

#: Components beyond this (after scaling) are refused: their squared distances might not fit a long.
LARGEST = 1 << 26
_STATE = "code binary, upper binary, lower binary"


class VectorCodes(NamedTuple):
    """``codes``: (vec_id, label, code, error), a byte for each part; ``codebooks``: (part, entry, place)."""

    codes: DataFrame
    codebooks: np.ndarray


def _up(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats, none smaller."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def _packed(x: np.ndarray) -> np.ndarray:
    """Non-negative numbers in 16 bits (exponent and 8 bits), none larger."""
    y = x.astype(np.float32)
    y = np.where(y > x, np.nextafter(y, np.float32(0)), y)
    return (y.view(np.uint32) >> 15).astype(np.uint16)


def _unpacked(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << 15).view(np.float32).astype(np.float64)


class Round:
    """The codebooks of a round, how far each entry came, and what lies between entries."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None) -> None:
        self.now = now
        parts, k, self.width = now.shape
        moved = np.zeros((parts, k)) if before is None else np.sqrt(((now - before) ** 2).sum(2).astype(float))
        self.moved = moved * (1 + 4e-15)
        self.half = np.zeros((parts, k, k))
        for p in range(parts):
            self.half[p] = np.sqrt(self._all(now[p], now[p]).astype(float)) * (0.5 - 4e-15)
            np.fill_diagonal(self.half[p], np.inf)
        self.nearest = self.half.min(2)

    def _all(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Squared distances of all rows to all entries, exact."""
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
        exact = most * most * max(self.width, 1) < 1 << 53
        dot = (x.astype(float) @ entries.T.astype(float)).astype(np.int64) if exact else x @ entries.T
        return (x * x).sum(1)[:, None] - 2 * dot + (entries * entries).sum(1)

    @staticmethod
    def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return ((x - y) ** 2).sum(1)

    def assign(self, p: int, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Give every row of x (its part p) its nearest entry; own, upper and lower are brought up to date."""
        entries = self.now[p]
        np.maximum(lower - self.moved[p], 0, out=lower)
        upper += self.moved[p][own]
        upper *= 1 + 4e-15
        at = np.flatnonzero(~(upper < self.nearest[p][own]))
        if not len(at):
            return
        mine, rows = own[at], x[at]
        best = self._pairs(rows, entries[mine])
        far = np.sqrt(best.astype(float))
        upper[at], lower[at, mine] = far * (1 + 4e-15), far * (1 - 4e-15)
        limit = upper[at][:, None]
        near = ~((limit < lower[at]) | (limit < self.half[p][mine]))
        near[np.arange(len(at)), mine] = False
        if near.mean() > 0.1:
            every = self._all(rows, entries)
            r, j = np.nonzero(near)
            d = every[r, j]
        else:
            r, j = np.nonzero(near)
            d = np.concatenate([np.zeros(0, np.int64), *(self._pairs(rows[r[a : a + 65536]], entries[j[a : a + 65536]]) for a in range(0, len(r), 65536))])
        lower[at[r], j] = np.sqrt(d.astype(float)) * (1 - 4e-15)
        r, j, d = np.r_[r, np.arange(len(at))], np.r_[j, mine], np.r_[d, best]
        order = np.lexsort((j, d, r))
        first = order[np.r_[True, np.diff(r[order]) != 0]]
        own[at] = j[first]
        upper[at] = np.sqrt(d[first].astype(float)) * (1 + 4e-15)


def compress_vectors(
    vectors: DataFrame,
    entries: int = 256,
    parts: int = 4,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> VectorCodes:
    """Codes of ``parts`` bytes for all vectors and the codebooks they point into.

    Components become floor(scale * x). Each part's codebook starts as that part of the ``entries``
    vectors of smallest ids; a round assigns all parts and moves each used entry to the floored mean of
    its parts. A round reads the table of bounds that the last one wrote (16 bits for each entry and
    part, in the shared folder) and writes the next; only sums, at most one row for each entry, place
    and task, are shuffled, and what the driver sees and sends out is the codebooks. Every round
    covers all rows, and a lost task is done again from the written table.

    Rows whose vector is null or holds null or non-finite components are left out. Null ids come last,
    equal ids are ordered by their components, and every row keeps a code of its own; null labels are
    kept. With fewer vectors than ``entries`` the codebook is as small; an empty table gives an empty
    result. Other columns are not read. Vectors of several lengths, of a length that ``parts`` does
    not divide, or with scaled components beyond 2**26 raise a ValueError."""
    if not 1 <= entries <= 256:
        raise ValueError("entries lies between 1 and 256")
    spark = vectors.sparkSession
    work = Workspace(spark, "vector-codes")
    x = F.col("x")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x")).where(finite)
    largest = F.max(F.array_max(F.transform(x, F.abs)))
    n, short, wide, most = kept.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x")), largest).first()
    if n == 0:
        empty = kept.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return VectorCodes(empty.where("false"), np.zeros((parts, 0, 0), np.int64))
    if short != wide or wide % parts:
        raise ValueError(f"vectors need one length that {parts} divides, not {short} to {wide}")
    if (most or 0) * scale >= LARGEST:
        raise ValueError("a component is too large for exact distances")
    width = wide // parts
    whole = kept.select("vec_id", "label", F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))
    head = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    now = np.array([r.v for r in head], np.int64).reshape(len(head), parts, width).transpose(1, 0, 2).copy()
    label = whole.schema["label"].dataType.simpleString()
    before, state = None, whole
    for k in range(rounds + 1):
        last = k == rounds
        made = state.mapInArrow(_step(spark, Round(now, before), k == 0, last), f"vec_id long, label {label}, " + ("code binary, error long" if last else f"v array<int>, {_STATE}"))
        state = work.save(made, f"round-{k}")
        if k:
            work.drop(f"round-{k - 1}")
        if not last:
            before, now = now, _means(state, now)
    return VectorCodes(state, now)


def _step(spark, now: Round, first: bool, last: bool):
    held = spark.sparkContext.broadcast(now)  # entries x entries for each part
    parts, k, width = now.now.shape

    def matrix(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)

    def rows_of(m: np.ndarray) -> pa.Array:
        raw, size = m.tobytes(), m.itemsize * int(np.prod(m.shape[1:]))
        return pa.array([raw[i * size : (i + 1) * size] for i in range(len(m))], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = held.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                n, v = len(part), part.column(2)
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, width)
                if first:
                    code, upper = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf)
                    lower = np.zeros((n, parts, k))
                else:
                    code = matrix(part.column(3), "u1", parts).astype(np.int64)
                    upper = matrix(part.column(4), "<f4", parts).astype(float)
                    lower = _unpacked(matrix(part.column(5), "<u2", parts, k))
                for p in range(parts):
                    own, most, least = code[:, p].copy(), upper[:, p].copy(), lower[:, p]
                    step.assign(p, x[:, p], own, most, least)
                    code[:, p], upper[:, p] = own, most
                coded = rows_of(code.astype(np.uint8))
                if last:
                    error = sum(step._pairs(x[:, p], step.now[p][code[:, p]]) for p in range(parts))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), coded, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])
                else:
                    columns = [part.column(0), part.column(1), v, coded, rows_of(_up(upper).astype("<f4")), rows_of(_packed(lower).astype("<u2"))]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "code", "upper", "lower"])

    return run


def _means(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floored means of the parts that each entry got."""
    parts, k, width = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), parts, width)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), "u1").reshape(-1, parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=k)
        p, e = np.nonzero(count)
        at = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), np.repeat(count[p, e], width), total[p, e].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in at], ["part", "entry", "place", "n", "total"])

    sums = state.select("v", "code").mapInArrow(run, "part long, entry long, place long, n long, total long")
    after = now.copy()
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        after[r.part, r.entry, r.place] = r.total // r.n
    return after


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with ``label_error``: the errors of all rows of an equal label, nulls together."""
    n = codes.count()
    keyed = codes.withColumn("__label", F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("n")))
    sums = keyed.groupBy("__label").agg(F.sum("error").alias("label_error"))
    return dealt_join(keyed, sums, "__label", n).drop("__label")
