"""Connected components of an edge table by alternating stars, contracted inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, dealt_join

#: Edges that a task contracts at once; a task with more of them does so in several lots.
LOT = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is connected with) for all nodes of the edges but the smallest ones."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
        while (label != label[label]).any():
            label = label[label]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what ``edges`` connect: in each task, stars around the smallest nodes."""
    lot = LOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            u, v = np.concatenate(held, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in forest(u, v)], ["u", "v"])

        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(k), np.int64) for k in range(2)]))
            n += batch.num_rows
            if n >= lot:
                yield out()
                held.clear()
                n = 0
        if n:
            yield out()

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def _only_stars(edges: DataFrame, tasks: int) -> bool:
    """True if every node is the smaller end of all its edges, or the larger end with one other node."""
    child = edges.select(F.col("u").alias("node"), F.col("v").alias("up"))
    centre = edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("up"))
    seen = child.unionByName(centre).groupBy("node")
    seen = seen.agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max(F.col("up").isNull()).alias("centre"))
    return seen.where("low <> high OR (low IS NOT NULL AND centre)").coalesce(tasks).agg(F.count("*")).first()[0] == 0


def _linked_up(edges: DataFrame, n: int) -> DataFrame:
    """Every node linked to the smallest smaller neighbour that its own smaller neighbour has (the
    neighbour itself if there is none)."""
    up = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return dealt_join(edges, up, "v", n, "left").select("u", F.coalesce("m", "v").alias("v"))


def _joined_below(edges: DataFrame) -> DataFrame:
    """Every node linked to its smallest neighbour, and its other smaller neighbours to that one."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    two = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return edges.join(low, "u").select(F.explode(two).alias("e")).select("e.*").where("u != v")


def components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), longs; root is the smallest node reachable.

    Each task first replaces its edges by stars. A round is a large-star and a small-star step, each
    followed by stars inside the tasks again, until only stars are left. Rounds grow with the logarithm
    of the size at most; a node is the larger end of one edge a lot, so no node has many rows in the
    second step, and in the first one such nodes are dealt out. Each step is written, so lineage stays
    short. Loops and repeated edges are ignored; edges with a null end are dropped."""
    a, b = F.col("a"), F.col("b")
    at_once = edges.sparkSession.sparkContext.defaultParallelism
    now = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = work.save(contracted(now), f"{name}-0")
    k = 0
    while True:
        n = now.count()
        tasks = max(at_once, n // LOT + 1)
        if _only_stars(now, tasks):
            break
        large = work.save(contracted(_linked_up(now, n).coalesce(tasks)), f"{name}-{k}-large")
        now = work.save(contracted(_joined_below(large).coalesce(tasks)), f"{name}-{k + 1}")
        work.drop(f"{name}-{k}", f"{name}-{k}-large")
        k += 1
    pairs = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))
    return now.select(F.explode(pairs).alias("e")).select("e.*").distinct()
