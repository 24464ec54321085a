"""Behavioural models by frontier joins: how deep relations lie behind the start and before the end.

Every search goes level by level: a frontier table is joined with the relations, and what is known is left
out. A level is written before the next one reads it; the driver only asks whether it is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..order import with_index
from ..workspace import written

#: Depths beyond this are not told apart.
DEEPEST = 6
#: Paths kept for each relation and step by the first search for deep paths; the second knows no such bound.
KEPT = 16


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _distances(rel: DataFrame) -> DataFrame:
    """(source, at, d): the fewest relations that lead from one activity to another, 0 to itself."""
    ends = rel.select(F.col("src").alias("at")).union(rel.select("dst")).distinct()
    levels = [written(ends.select(F.col("at").alias("source"), "at", F.lit(0).alias("d")), "level")]
    steps = rel.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    while True:
        met = levels[-1].join(steps, "at").select("source", F.col("next").alias("at"), (F.col("d") + 1).alias("d")).distinct()
        level = written(met.join(_union(levels).select("source", "at"), ["source", "at"], "left_anti"), "level")
        if level.isEmpty():
            return _union(levels)
        levels.append(level)


def model_of(relations: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(src, dst, p_min, p_max, f) of a behavioural model.

    ``relations`` are (src, dst), ``starts`` and ``ends`` are (activity). p_min and p_max tell how deep a relation
    lies behind a start activity at least and at most (a path may use a relation again once, which takes it no
    deeper, and stops at depth 6), f how far it is from an end activity at least; null where none leads there."""
    rel = with_index(relations.select("src", "dst").distinct(), "src", "dst", name="r")
    side = lambda df, name: df.select(F.col("activity").alias(name)).distinct().withColumn(f"is_{name}", F.lit(True))
    rel = rel.join(side(starts, "src"), "src", "left").join(side(ends, "dst"), "dst", "left")
    rel = written(rel.select("r", "src", "dst", F.col("is_src").isNotNull().alias("first"), F.col("is_dst").isNotNull().alias("last")), "relations")
    away = _distances(rel)

    behind = rel.where("first").groupBy(F.col("dst").alias("source")).agg(F.count("*").alias("ways"))
    own = rel.join(away.withColumnRenamed("at", "src"), "src").join(behind, "source")
    # A relation is not behind itself: it counts as a source of its own at depth 0 only.
    own = own.where("NOT first OR source <> dst OR ways > 1")
    depths = own.select("r", (F.col("d") + 1).alias("d")).union(rel.where("first").select("r", F.lit(0)))
    depths = written(depths.groupBy("r").agg(F.min("d").alias("p_min"), F.max("d").alias("p_max")), "depths")

    final = rel.where("last").select(F.col("src").alias("at")).distinct()
    to_end = rel.join(away.join(final, "at").withColumnRenamed("source", "dst"), "dst").select("r", (F.col("d") + 1).alias("d"))
    to_end = to_end.union(rel.where("last").select("r", F.lit(0))).groupBy("r").agg(F.min("d").alias("f"))

    deep = _deepest(rel, away, depths.select("r", F.col("p_max").alias("depth")))
    found = rel.join(depths, "r", "left").join(deep, "r", "left").join(to_end, "r", "left")
    return found.select("src", "dst", F.col("p_min").cast("int").alias("p_min"), F.greatest("p_max", "depth").cast("int").alias("p_max"), F.col("f").cast("int").alias("f"))


def _deepest(rel: DataFrame, away: DataFrame, known: DataFrame) -> DataFrame:
    """(r, depth): the deepest place of each relation on the bounded paths, or at least on so many of
    them that no more can be found: at 6, or at the length of the longest walk to it.

    A first search keeps a few paths for each relation and step. Where it stays below what a
    walk could reach, a second one follows all paths that can still lead there."""
    ahead = rel.select(F.col("src").alias("dst"), F.col("r").alias("next"))
    after = written(rel.select("r", "dst").join(ahead, "dst").select("r", "next"), "after")
    first = rel.where("first").select("r")
    most = _limits(rel, after, away)

    def open_ones(found: DataFrame) -> DataFrame:
        best = known.unionByName(found).groupBy("r").agg(F.max("depth").alias("depth"))
        return most.join(best, "r", "left").where(F.coalesce("depth", F.lit(-1)) < F.col("most")).select("r")

    quick = _paths(after, first, KEPT, open_ones)
    left = written(open_ones(quick), "open")
    if left.isEmpty():
        return quick
    # Relations from which an open one can be reached, and these themselves.
    goals = rel.join(left, "r", "left_semi").select(F.col("src").alias("at")).distinct()
    leading = rel.join(away.join(goals, "at", "left_semi").select(F.col("source").alias("dst")).distinct(), "dst", "left_semi").select("r").union(left).distinct()
    leading = written(leading, "leading")
    some = after.join(leading, "r", "left_semi").join(leading.withColumnRenamed("r", "next"), "next", "left_semi")
    exact = _paths(written(some, "some"), first.join(leading, "r", "left_semi"), None, open_ones)
    return quick.unionByName(exact).groupBy("r").agg(F.max("depth").alias("depth"))


def _limits(rel: DataFrame, after: DataFrame, away: DataFrame) -> DataFrame:
    """(r, most): 6 for what lies behind a walk of 6 steps, else the length of the longest walk to r. Bit
    k of a relation's walks tells that one of k steps ends there."""
    walks = rel.where("first").select("r", F.lit(1).alias("walks"))
    for _ in range(DEEPEST):
        longer = walks.join(after, "r").select(F.col("next").alias("r"), F.shiftleft("walks", 1).alias("walks"))
        walks = walks.union(longer).groupBy("r").agg(F.bit_or("walks").alias("walks"))
    full = 1 << DEEPEST
    walks = written(walks.withColumn("walks", F.col("walks").bitwiseAND(F.lit(2 * full - 1))), "walks")
    deep = rel.join(walks.where(f"walks >= {full}"), "r", "left_semi").select(F.col("dst").alias("source")).distinct()
    beyond = rel.join(away.join(deep, "source", "left_semi").select(F.col("at").alias("src")).distinct(), "src", "left_semi").select("r", F.lit(DEEPEST).alias("most"))
    longest = walks.select("r", F.floor(F.log2("walks")).cast("int").alias("most"))
    return written(longest.unionByName(beyond).groupBy("r").agg(F.max("most").alias("most")), "limits")


def _paths(after: DataFrame, first: DataFrame, keep: int | None, open_ones) -> DataFrame:
    """(r, depth) at which the paths enter relations. A path is told by the relations it has left once
    (``seen``, their number is its depth) or twice (``again``), not by their order; of paths that
    come to one place with the same ``seen``, one that has left fewer relations twice does for
    all that have left these and more."""
    none = F.array().cast("array<bigint>")
    levels = [written(first.select("r", none.alias("seen"), none.alias("again")).distinct(), "paths")]
    holds = lambda c: F.array_contains(c, F.col("r"))
    put = lambda c: F.array_sort(F.array_append(F.col(c), F.col("r")))
    twice = holds("seen")
    while True:
        for _ in range(DEEPEST):
            nxt = levels[-1].where(F.size("seen") < DEEPEST).join(after, "r").select(
                F.col("next").alias("r"), F.when(twice, F.col("seen")).otherwise(put("seen")).alias("seen"), F.when(twice, put("again")).otherwise(F.col("again")).alias("again")
            )
            nxt = nxt.where(~holds("again")).distinct()
            if keep is None:
                nxt = _undominated(nxt, levels)
            else:
                w = Window.partitionBy("r").orderBy(-F.size("seen"), F.size("again"), F.xxhash64("seen", "again"))
                nxt = nxt.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= keep).drop("__k")
            levels.append(written(nxt, "paths"))
        found = written(_union(levels).groupBy("r").agg(F.max(F.size("seen")).alias("depth")), "found")
        if levels[-1].isEmpty() or open_ones(found).isEmpty():
            return found


def _undominated(states: DataFrame, past: list[DataFrame]) -> DataFrame:
    own = states.withColumn("__again", F.col("again")).drop("again")
    before = _union([*past, states])
    within = F.size(F.array_except(F.col("again"), F.col("__again"))) == 0
    fewer = within & (F.size("again") < F.size("__again"))
    kept = own.alias("o").join(before.alias("b"), (F.col("o.r") == F.col("b.r")) & (F.col("o.seen") == F.col("b.seen")) & fewer, "left_anti")
    return kept.select("r", "seen", F.col("__again").alias("again"))
