"""SimHash fingerprints, and near-duplicate groups by bit-sliced comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, dealt_join, slices
from .components import components

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, size: int = 4, seed: int = 42) -> np.ndarray:
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text over its word shingles; a text without
    words, or a null one, has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, "text")):
            made = [fingerprint(shingle_hashes(t or b"", size, seed)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], ["doc_id", "fp"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def close_lanes(fps: np.ndarray, rows: slice, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the j > i with at most ``radius`` bits between fingerprints i and j) for i in ``rows``.

    The fingerprints stand vertically: plane b holds bit b of 64 of them in each word, so one
    operation compares a bit of a row with 64 fingerprints. Distances are bitwise counters that
    start so high that the (radius + 1)th difference carries out of the top; planes go in threes
    through full adders. A row is abandoned once all its lanes have carried out."""
    n = len(fps)
    words = -(-n // 64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.zeros((64, 8 * words), np.uint8)
    planes[:, : -(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    planes = planes.view(np.uint64)
    row = np.arange(rows.start, rows.stop)
    own = np.where(bits[row].T.astype(bool), _ONES, np.uint64(0))[:, :, None]
    over = np.zeros((len(row), 64 * words), np.uint8)
    over[:, n:] = 1
    over[np.arange(64 * words)[None, :] <= row[:, None]] = 1  # pairs are seen from their smaller side
    over = np.packbits(over, axis=1, bitorder="little").view(np.uint64)
    depth = radius.bit_length()
    first = (1 << depth) - 1 - radius
    count = [np.full_like(over, _ONES if first >> k & 1 else 0) for k in range(depth)]

    def add(carry: list[np.ndarray], k: int) -> None:
        for level in range(k, depth):
            out = []
            for c in carry:
                out.append(count[level] & c)
                count[level] ^= c
            carry = out
        for c in carry:
            np.bitwise_or(over, c, out=over)

    for b in range(0, 63, 3):
        x, y, z = (planes[b + i][None, :] ^ own[b + i] for i in range(3))
        half = x ^ y
        if depth > 1:
            add([half ^ z], 0)
            add([(x & y) | (z & half)], 1)
        else:
            for p in (x, y, z):
                add([p], 0)
        if b % 12 == 9:
            alive = (over != _ONES).any(axis=1)
            if not alive.all():
                row, own, over = row[alive], own[:, alive], over[alive]
                count[:] = [c[alive] for c in count]
                if not len(row):
                    return
    add([planes[63][None, :] ^ own[63]], 0)
    left = ~np.unpackbits(over.view(np.uint8), axis=1, bitorder="little").astype(bool)
    for i, lanes in zip(row, left):
        found = np.flatnonzero(lanes[:n])
        if len(found):
            yield int(i), found


def block_links(fps: np.ndarray, radius: int, tile: int = 512) -> list[tuple[int, int]]:
    """Edges that connect all fingerprints of a block that are linked in it: a spanning forest."""
    label, edges = np.arange(len(fps)), []
    for at in range(0, len(fps), tile):
        for i, found in close_lanes(fps, slice(at, min(at + tile, len(fps))), radius):
            for root, k in zip(*np.unique(label[found], return_index=True)):
                if root != label[i]:
                    edges.append((i, int(found[k])))
                    label[label == root] = label[i]
    return edges


def _tables(radius: int, rows: int, room: int) -> list[int]:
    """Bit masks such that two fingerprints within ``radius`` agree under one of them: 64 bits in
    radius + m blocks, of which m always agree. m grows until a mask's buckets have about ``room``
    rows of this many."""
    for m in range(1, 5):
        blocks = radius + m
        if rows <= room << (64 * m // blocks) or m == 4:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(part, m)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def links(classes: DataFrame, work: Workspace, radius: int = 4, cell: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of ``classes`` (fp) that connect exactly those
    which chains of pairs within ``radius`` connect.

    Candidates share a bucket of one of several bit masks. A bucket of over ``cell`` fingerprints is
    dealt into chunks, and each pair of chunks is a cell of its own, so no task holds more than two
    chunks and no pair is left out. Small buckets are compared together in blocks; a pair found
    across buckets is a true link too."""
    masks = _tables(radius, classes.count(), cell)
    dealt = classes.select(
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"), "fp"
    )
    hot = work.save(dealt.groupBy("t", "key").count().where(F.col("count") > cell), "hot-buckets")
    if hot.isEmpty():
        dealt = dealt.withColumn("cell", F.lit(0).cast("long"))
    else:
        m = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / F.lit(cell))
        own = F.pmod(F.xxhash64("fp"), m)
        other = F.sequence(F.lit(0).cast("long"), m - 1)
        pair = F.transform(other, lambda j: F.least(own, j) * F.lit(1 << 31) + F.greatest(own, j))
        dealt = dealt.join(hot, ["t", "key"], "left").select("t", "key", "fp", F.explode(pair).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)

        def edges(fps: np.ndarray) -> pa.RecordBatch:
            fps = np.unique(fps).view(np.uint64)
            found = block_links(fps, radius)
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            made = fps.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(made[a]), pa.array(made[b])], ["a", "b"])

        def blocks(done: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(done):
                return
            starts = np.flatnonzero(np.r_[True, (done[1:, :3] != done[:-1, :3]).any(axis=1)])
            at = 0
            for end in [*starts[1:], len(done)]:
                if end - at >= 1024 or end == len(done):
                    yield edges(done[at:end, 3])
                    at = end

        for batch in batches:
            rows = np.column_stack([np.asarray(batch.column(k), np.int64) for k in range(4)])
            held = np.concatenate([held, rows]) if len(held) else rows
            if len(held):
                last = int(np.flatnonzero((held[:, :3] != held[-1, :3]).any(axis=1))[-1]) + 1 if (held[:, :3] != held[-1, :3]).any() else 0
                yield from blocks(held[:last])
                held = held[last:]
        yield from blocks(held)

    ordered = dealt.select(F.col("t").cast("long"), "key", "cell", "fp").repartition("t", "key", "cell")
    return ordered.sortWithinPartitions("t", "key", "cell").mapInArrow(run, "a long, b long")


def simhash_groups(
    docs: DataFrame, size: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) of every row: two fingerprints link at ``radius`` or fewer
    differing bits, component_id is the smallest doc_id reachable over links.

    Documents of one fingerprint are one class; only classes are compared. Null and word-free texts
    share fingerprint 0 and link like any other. Null ids are kept but never smallest (a group of
    null ids only has component null); repeated rows stay repeated. An empty table gives an empty
    result; other columns are not read."""
    work = Workspace(docs.sparkSession, "simhash")
    fps = work.save(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    classes = work.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    edges = work.save(links(classes.select("fp"), work, radius), "links")
    roots = components(edges, work).withColumnRenamed("node", "fp")
    linked = work.save(classes.join(roots, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = dealt_join(linked, least, "root", linked.count()).select("fp", "component_id")
    alone = classes.join(linked, "fp", "left_anti").select("fp", F.col("least_id").alias("component_id"))
    named = work.save(named.unionByName(alone), "class-groups")
    return dealt_join(fps, named, "fp", fps.count()).select("doc_id", "fp", "component_id")
