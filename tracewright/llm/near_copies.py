"""Near copies by exact Jaccard similarity of word shingles, on top of the SimHash groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, dealt_join, gathered, slices
from .components import components
from .simhash import shingle_hashes, simhash_groups

#: Two texts with Jaccard similarity j share a bucket with probability 1 - (1 - j^ROWS)^BANDS:
#: 0.999993 at 0.8, more above.
BANDS, ROWS = 30, 5
#: What a whole text counts for among rows of a few numbers.
TEXT = 128


def bucket_keys(shingles: np.ndarray, seed: int = 42) -> np.ndarray:
    """One key a band, of the smallest of all ``shingles`` under each of ROWS orders."""
    orders = np.random.default_rng(seed).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(orders), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 12):
        np.minimum(least, np.multiply.outer(orders, shingles[at : at + (1 << 12)]).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, low, high, n, buckets) of every text with words: a 128-bit digest of its set of
    shingles, their number and its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, "text")):
            ids, made, sizes, keys = [], [], [], []
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = np.unique(shingle_hashes(t or b"", size))
                if len(own):
                    ids.append(i)
                    made.append(xxhash.xxh3_128_digest(own.tobytes()))
                    sizes.append(len(own))
                    keys.append(bucket_keys(own))
            low, high = np.frombuffer(b"".join(made), np.int64).reshape(-1, 2).T
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), flat)
            columns = [pa.array(ids, pa.int64()), pa.array(low), pa.array(high), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "low", "high", "n", "buckets"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, low long, high long, n long, buckets array<long>")


def verified(pairs: DataFrame, texts: DataFrame, work: Workspace, name: str, size: int, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole texts reach ``threshold``. The rows of an id that is in
    many pairs are dealt out."""
    side = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), "a", "b")
    many = work.save(side.groupBy("doc_id").count().where("count > 256"), f"{name}-many")
    parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / F.lit(256))
    side = side.join(F.broadcast(many), "doc_id", "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), parts)).drop("count")
    dealt = texts.join(F.broadcast(many), "doc_id", "left")
    dealt = dealt.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    both = side.join(dealt, ["doc_id", "part"]).select("a", "b", "text").repartition("a", "b").sortWithinPartitions("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in (p for b in batches for p in slices(b, "text")):
            found = []
            for a, b, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                own = np.unique(shingle_hashes(text or b"", size))
                if held is None:
                    held = own
                    continue
                shared = len(np.intersect1d(held, own, assume_unique=True))
                if shared >= threshold * (len(held) + len(own) - shared):
                    found.append((a, b))
                held = None
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return work.save(gathered(both.mapInArrow(run, "a long, b long"), 2 * TEXT * pairs.count()), name)


def cell_links(ids: np.ndarray, first: np.ndarray, sets: list[np.ndarray], threshold: float, block: int = 2048) -> list[tuple[int, int]]:
    """Pairs of ids whose sets reach ``threshold``, enough of them to connect all groups (``first``) that
    such pairs connect. All intersections of a cell are products of membership matrices, a block of
    shingles at a time; shingles of one member only are left out."""
    size = np.array([len(s) for s in sets])
    label = np.unique(first, return_inverse=True)[1]
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    place = np.cumsum(count > 1) - 1
    row, column = row[count[column] > 1], place[column[count[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, block):
        i, j = np.searchsorted(column, (at, at + block))
        member = np.zeros((len(sets), block), np.float32)
        member[row[i:j], column[i:j] - at] = 1
        shared += member @ member.T
    both = size[:, None] + size[None, :] - shared
    x, y = np.nonzero(np.triu((shared >= threshold * both) & (label[:, None] != label[None, :]), 1))
    low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
    one = np.unique(low * (label.max() + 1) + high, return_index=True)[1]
    root, out = np.arange(label.max() + 1), []
    for k in one.tolist():
        a, b = root[low[k]], root[high[k]]
        if a != b:
            root[root == b] = a
            out.append((int(ids[x[k]]), int(ids[y[k]])))
    return out


def pool_links(members: DataFrame, n: int, texts: DataFrame, work: Workspace, size: int, threshold: float, cell: int = 512) -> DataFrame:
    """Links (a, b) within pools: members (pool, doc_id, first; at most n) of each are dealt into chunks of about
    ``cell``, and each pair of chunks is one cell, so no task holds more than two chunks, no pair is
    left out, and only links leave a task."""
    count = members.groupBy("pool").agg(F.count("*").alias("m"), F.countDistinct("first").alias("groups"))
    count = work.save(gathered(count, n), "pool-sizes")
    chunks = F.ceil(F.col("m") / cell)
    own = F.pmod(F.xxhash64("doc_id"), chunks)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda j: F.least(own, j) * F.lit(1 << 31) + F.greatest(own, j))
    dealt = members.join(count.where("groups > 1"), "pool").select("pool", "doc_id", "first", F.explode(pair).alias("cell"))
    rows = dealt.join(texts, "doc_id").select("pool", "cell", "doc_id", "first", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            ids, first, sets = zip(*held)
            a, b = np.array(cell_links(np.array(ids), np.array(first), list(sets), threshold), np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for part in (p for b in batches for p in slices(b, "text")):
            for pool, at, i, first, text in zip(*(part.column(k).to_pylist() for k in range(5))):
                if (pool, at) != now and held:
                    yield out()
                    held.clear()
                now = (pool, at)
                held.append((i, first, np.unique(shingle_hashes(text or b"", size))))
        if held:
            yield out()

    dealt = rows.repartition("pool", "cell").sortWithinPartitions("pool", "cell", "doc_id")
    return work.save(dealt.mapInArrow(run, "a long, b long"), "pool-links")


def near_groups(docs: DataFrame, id_col: str, text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row, for unique ids: SimHash groups, joined further by every
    pair that shares a bucket and whose shingles of ``size`` words have a Jaccard similarity of
    ``threshold`` or more, computed on the whole texts. component_id is the smallest id of a group.

    Texts with equal sets of shingles are one class, and only one of each is compared. In every
    bucket all are first compared with the smallest id; where that leaves more than one group, the
    documents that such buckets connect are one pool, and all pairs of a pool are compared in cells
    inside the tasks, once for all buckets. No pairs but links leave a task."""
    work = Workspace(docs.sparkSession, "near-copies")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    groups = simhash_groups(docs, id_col=id_col, text_col=text_col).select("doc_id", F.col("component_id").alias("first"))
    groups = work.save(groups, "simhash-groups")
    n = groups.count()
    own = work.save(gathered(sketches(docs, size, id_col, text_col).join(groups, "doc_id"), BANDS * n), "sketches")

    classes = own.groupBy("low", "high", "first").agg(F.min("doc_id").alias("doc_id"))
    least = classes.groupBy("low", "high").agg(F.min(F.struct("doc_id", "first")).alias("least"))
    least = work.save(gathered(least.select("low", "high", "least.*"), n), "classes")
    equal = classes.select("low", "high", F.col("first").alias("a")).join(
        least.select("low", "high", F.col("first").alias("b")), ["low", "high"]
    )
    edges = work.save(gathered(equal.where("a <> b").select("a", "b"), n), "equal")

    def grouped(rows: DataFrame, name: str) -> DataFrame:
        """rows with ``first`` as the edges found so far have it."""
        roots = components(edges, work, name).select(F.col("node").alias("first"), "root")
        return dealt_join(rows, roots, "first", rows.count(), "left").withColumn("first", F.coalesce("root", "first")).drop("root")

    now = own.join(least.select("doc_id"), "doc_id", "left_semi")
    rows = work.save(gathered(now.select("doc_id", "first", "n", F.explode("buckets").alias("bucket")), BANDS * n), "members")
    most = rows.count()
    open_ = F.min("first") < F.max("first")

    hubs = rows.groupBy("bucket").agg(open_.alias("open"), F.min(F.struct("doc_id", "first", "n")).alias("hub")).where("open").drop("open")
    rows = work.save(gathered(rows.join(hubs, "bucket"), most), "open-members")  # groups only merge, so no other bucket opens later
    work.drop("sketches", "classes", "members")
    pair = rows.where(F.col("first") != F.col("hub.first"))
    pair = pair.where(F.least("n", "hub.n") >= threshold * F.greatest("n", "hub.n"))
    pair = pair.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    tried = work.save(gathered(pair, most), "pairs-1")

    def joined(found: DataFrame, name: str) -> DataFrame:
        """The edges, with those between the groups of the pairs found."""
        one, two = (groups.select(F.col("doc_id").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
        found = found.join(one, "a").join(two, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
        return work.save(gathered(edges.unionByName(found), most), f"{name}-edges")

    edges = joined(verified(tried, texts, work, "near-1", size, threshold), "near-1")
    rows = work.save(gathered(grouped(rows.drop("hub"), "components-1"), most), "members-2")
    work.drop("open-members", "pairs-1")
    rest = rows.groupBy("bucket").agg(open_.alias("open"), F.min("doc_id").alias("hub"), F.count("*").alias("count")).where("open AND count > 2")
    left = rows.join(rest.select("bucket", "hub"), "bucket").select("hub", "doc_id", "first").distinct()
    left = work.save(gathered(left, most), "left")
    pools = components(left.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")), work, "pools")
    members = left.select("doc_id", "first").distinct().join(pools.select(F.col("node").alias("doc_id"), F.col("root").alias("pool")), "doc_id")
    edges = joined(pool_links(members, n, texts, work, size, threshold), "near-2")
    return grouped(groups, "components-2").select("doc_id", F.col("first").alias("component_id"))
