"""Discovery: directly-follows graphs, lossy-counting miners, temporal profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lossy import at_ticks, lossy_states
from ..functions.running import running
from ..order import last_index
from ..workspace import written
from .behaviour import model_of


#: Events of a tick up to which one task may hold all of them.
SHORT_TICK = 10_000


def directly_follows(df: DataFrame, order: str = "n") -> DataFrame:
    """df's events from the second of each case on, with the activity before as ``src`` and their own
    as ``dst``."""
    w = Window.partitionBy("case_id").orderBy(order)
    rows = df.withColumn("src", F.lag("activity").over(w)).withColumn("__k", F.row_number().over(w))
    return rows.where("__k > 1").withColumn("dst", F.col("activity")).drop("__k")


def dfg(df: DataFrame, order: str = "n") -> DataFrame:
    """(src, dst, freq) over the whole log; counts are combined before the shuffle."""
    return directly_follows(df, order).groupBy("src", "dst").agg(F.count("*").alias("freq"))


def start_end_activities(edges: DataFrame, loops_count: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, activity, is_start, is_end), for each graph that ``by`` names: starts are sources that are no
    targets of other activities, ends the reverse. A node with a self-loop only is neither, or both
    with ``loops_count``."""
    other = F.col("src") != F.col("dst")
    pool = F.lit(True) if loops_count else other
    mark = lambda when, c, side: F.when(when, F.struct(F.col(c).alias("activity"), F.lit(side).alias("side")))
    each = F.array(mark(pool, "src", "s"), mark(pool, "dst", "t"), mark(other, "src", "S"), mark(other, "dst", "T"))
    marks = edges.select(*by, F.explode(each).alias("m")).where("m IS NOT NULL").select(*by, "m.activity", "m.side")
    has = lambda side: F.max(F.when(F.col("side") == side, 1).otherwise(0)) == 1
    rows = marks.groupBy(*by, "activity").agg((has("s") & ~has("T")).alias("is_start"), (has("t") & ~has("S")).alias("is_end"))
    return rows.where("is_start OR is_end")


def dfg_matrix(edges: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """The square matrix of the edges over the sorted union of labels, 0 where there is none."""
    if labels is None:
        both = edges.select("src").union(edges.select("dst")).distinct()
        labels = sorted(r[0] for r in both.collect())  # the activities of one model
    return edges.groupBy("src").pivot("dst", labels).agg(F.sum("freq")).na.fill(0)


def simple_dfg_ticks(df: DataFrame, model_update_frequency: int = 10, min_relative_frequency: float = 0.75) -> DataFrame:
    """(n, src, dst, freq, rel_freq) after every ``model_update_frequency`` events (2 at least): the
    relations whose share of the most frequent one is above the minimum.

    Counts are combined by relation and tick, and run over ranges of ticks; a relation then stands for
    the ticks up to its next change. Rows sorted by case hold too many ticks to be combined before they move,
    so those of a short tick are dealt out by tick and counted where they meet."""
    f = max(model_update_frequency, 2)
    slots = directly_follows(df).select("src", "dst", F.ceil(F.col("n") / f).alias("slot"))
    if f <= SHORT_TICK:
        slots = slots.repartition("slot")
    rows = slots.groupBy("src", "dst", "slot").agg(F.count("*").alias("cnt"))
    rows = running(rows, ["src", "dst"], "slot", freq=("sum", "cnt"), next_slot=("lead", "slot"))
    rows = at_ticks(rows, last_index(df) // f).withColumn("n", F.col("tick") * f)
    rows = rows.withColumn("rel_freq", F.col("freq") / F.max("freq").over(Window.partitionBy("n")))
    return rows.where(F.col("rel_freq") > min_relative_frequency).select("n", "src", "dst", "freq", "rel_freq")


def case_events(df: DataFrame) -> DataFrame:
    """df as a log of cases. Object-centric events (n, activity, omap) must have exactly one object each,
    which is their case; others are a ValueError, and tables of neither kind a TypeError."""
    if {"n", "case_id", "activity"} <= set(df.columns):
        return df
    if not {"n", "activity", "omap"} <= set(df.columns):
        raise TypeError("a log has n, activity and case_id, or omap")
    ids = F.flatten(F.map_values("omap"))
    if not df.where(F.coalesce(F.size(F.array_distinct(ids)), F.lit(0)) != 1).isEmpty():
        raise ValueError("events must be flattened to one object each")
    return df.withColumn("case_id", F.element_at(ids, 1)).drop("omap")


def _survivors(df: DataFrame, width: int, group: list[str] = []) -> DataFrame:  # noqa: B006
    """The relations that a lossy table of cases still knows the first half of."""
    w = Window.partitionBy(*group, "case_id").orderBy("n")
    rows = df.withColumn("b", F.ceil(F.col("n") / width))
    rows = rows.withColumn("src", F.lag("activity").over(w)).withColumn("before", F.row_number().over(w) - 1)
    last = F.lag("b").over(w)
    rows = rows.withColumn("g", F.when(last.isNull() | (last != F.col("b")), F.col("before") - F.col("b")))
    least = F.min("g").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("g").isNotNull() & (least.isNull() | (F.col("g") <= least))
    return rows.withColumn("new", new).where("NOT new").withColumn("dst", F.col("activity")).drop("new", "g", "before")


def heuristics_lossy_ticks(
    df: DataFrame, model_update_frequency: int = 10, max_approx_error: float = 0.001, group: list[str] | None = None
) -> DataFrame:
    """(group, n, src, dst, freq): the lossy-counting relation table after every event n with
    (n + 1) divisible by ``model_update_frequency``.

    Both tables of the algorithm (cases, relations) are counted in closed form, see
    ``functions.lossy``. ``group`` names columns (such as the object type) with an index n of their own.
    Events of one object each are taken as they are, see ``case_events``."""
    df, group = case_events(df), group or []
    width, f = math.ceil(1 / max_approx_error), model_update_frequency
    rows = _survivors(df, width, group).withColumn("slot", F.ceil((F.col("n") + 1) / f))
    states = lossy_states(rows, [*group, "src", "dst"])
    dead = F.floor((F.lit(width) * F.greatest("b", "reach")) / f)  # last tick before that event
    if not group:
        out = at_ticks(states, (last_index(df) + 1) // f, dead)
    else:
        ends = df.groupBy(*group).agg(F.floor((F.max("n") + 1) / f).alias("__last"))
        states = states.join(ends, group)
        states = states.withColumn("next_slot", F.coalesce("next_slot", F.col("__last") + 1))
        out = at_ticks(states, 1 << 62, F.least(dead, F.col("__last")))
    return out.select(*group, (F.col("tick") * f - 1).alias("n"), "src", "dst", "freq")


def dependency_graph(model: DataFrame, dependency_threshold: float = 0.5) -> DataFrame:
    """model (n, src, dst, freq) with the dependency measure and whether it reaches the threshold."""
    back = model.select("n", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("freq").alias("back"))
    rows = model.join(back, ["n", "src", "dst"], "left").withColumn("back", F.coalesce("back", F.lit(0)))
    loop = F.col("freq") / (F.col("freq") + 1)
    other = (F.col("freq") - F.col("back")) / (F.col("freq") + F.col("back") + 1)
    rows = rows.withColumn("dependency", F.when(F.col("src") == F.col("dst"), loop).otherwise(other))
    return rows.withColumn("kept", F.col("dependency") >= dependency_threshold).drop("back")


def and_splits(model: DataFrame, dependency_threshold: float = 0.5, and_threshold: float = 0.8) -> DataFrame:
    """(n, src, first, second, measure, is_and) for every pair of kept edges that leave one activity."""
    kept = dependency_graph(model, dependency_threshold).where("kept AND src <> dst").select("n", "src", "dst", "freq")
    left = kept.select("n", "src", F.col("dst").alias("first"), F.col("freq").alias("f1"))
    right = kept.select("n", "src", F.col("dst").alias("second"), F.col("freq").alias("f2"))
    pairs = left.join(right, ["n", "src"]).where("first < second")
    freq = lambda a, b, c: model.select("n", F.col("src").alias(a), F.col("dst").alias(b), F.col("freq").alias(c))
    pairs = pairs.join(freq("first", "second", "bc"), ["n", "first", "second"], "left")
    pairs = pairs.join(freq("second", "first", "cb"), ["n", "first", "second"], "left")
    measure = (F.coalesce("bc", F.lit(0)) + F.coalesce("cb", F.lit(0))) / (F.col("f1") + F.col("f2") + 1)
    rows = pairs.withColumn("measure", measure).withColumn("is_and", F.col("measure") >= and_threshold)
    return rows.select("n", "src", "first", "second", "measure", "is_and")


class BudgetState:
    """The two tables of budgeted lossy counting: at most ``budget`` entries of cases and relations."""

    def __init__(self, budget: int) -> None:
        if budget < 1:
            raise ValueError("budget must be 1 or more")
        self.budget, self.bucket = budget, 0
        self.cases: dict = {}
        self.relations: dict = {}

    def _make_room(self) -> None:
        while len(self.cases) + len(self.relations) >= self.budget:
            self.bucket += 1
            alive = lambda t: {k: v for k, v in t.items() if v[-2] + v[-1] > self.bucket}
            self.cases, self.relations = alive(self.cases), alive(self.relations)

    def observe(self, case: object, activity: str) -> None:
        known = self.cases.get(case)
        if known is None:
            self._make_room()
            self.cases[case] = (activity, 1, self.bucket)
            return
        last, freq, error = known
        self.cases[case] = (activity, freq + 1, error)
        pair = (last, activity)
        if pair not in self.relations:
            self._make_room()
            self.relations[pair] = (1, self.bucket)
        else:
            freq, error = self.relations[pair]
            self.relations[pair] = (freq + 1, error)


def heuristics_budget_ticks(df: DataFrame, model_update_frequency: int = 10, budget: int = 100) -> DataFrame:
    """(n, src, dst, freq) after every ``model_update_frequency`` events, from tables of at most
    ``budget`` entries.

    When room is made depends on all entries together, so events must pass in order through one task;
    it streams them and holds no more than the budget. Prefer ``heuristics_lossy_ticks`` for large logs."""
    BudgetState(budget)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = BudgetState(budget)
        for pdf in batches:
            out = []
            for n, case, activity in zip(pdf["n"], pdf["case_id"], pdf["activity"]):
                state.observe(case, activity)
                if n % model_update_frequency == 0:
                    out += [(n, a, b, v[0]) for (a, b), v in state.relations.items()]
            yield pd.DataFrame(out, columns=["n", "src", "dst", "freq"])

    rows = df.select("n", "case_id", "activity").repartition(1).sortWithinPartitions("n")
    return rows.mapInPandas(run, "n long, src string, dst string, freq long")


def _moments(df: DataFrame, activities: list[str] | None) -> DataFrame:
    """(n, a, b, cnt, d, dd): what each event b adds to the count, sum and sum of squares of its distances to
    all earlier events a of its case."""
    if activities is None:
        activities = sorted(r[0] for r in df.select("activity").distinct().collect())  # one row an activity
    w = Window.partitionBy("case_id").orderBy("ts", "n")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    t = ((F.unix_micros(F.col("ts").cast("timestamp")) - F.first(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) / 1e6).alias("t")
    rows = df.select("case_id", "ts", "n", F.col("activity").alias("b"), t)
    is_a = lambda a, v: F.when(F.col("b") == a, v)
    sums = [
        F.struct(
            F.lit(a).alias("a"),
            F.count(is_a(a, 1)).over(past).alias("c"),
            F.sum(is_a(a, F.col("t"))).over(past).alias("s"),
            F.sum(is_a(a, F.col("t") * F.col("t"))).over(past).alias("q"),
        )
        for a in activities
    ]
    rows = rows.withColumn("past", F.array(*sums)).select("n", "b", "t", F.explode("past").alias("p")).where("p.c > 0")
    c, s, q, t = F.col("p.c"), F.col("p.s"), F.col("p.q"), F.col("t")
    return rows.select("n", F.col("p.a").alias("a"), "b", c.alias("cnt"), (c * t - s).alias("d"), (c * t * t - 2 * t * s + q).alias("dd"))


def _profile(both: DataFrame, *keys: str) -> DataFrame:
    spread = F.greatest(F.lit(0.0), F.col("dd") - F.col("d") * F.col("d") / F.col("cnt"))
    std = F.when(F.col("cnt") > 1, F.sqrt(spread / (F.col("cnt") - 1))).otherwise(0.0)
    return both.select(*keys, "a", "b", "cnt", (F.col("d") / F.col("cnt")).alias("mean_s"), std.alias("std_s"))


def temporal_profile(df: DataFrame, activities: list[str] | None = None) -> DataFrame:
    """(a, b, cnt, mean_s, std_s): how long after a an eventually following b comes, over all pairs of
    events of a case.

    Pairs are never made: running counts, sums and sums of squares of earlier times, one for each
    activity, give each event's share. Times are seconds since the case's first event."""
    both = _moments(df, activities).groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("cnt", "d", "dd")))
    return _profile(both)


def temporal_profile_ticks(df: DataFrame, every: int = 1, activities: list[str] | None = None) -> DataFrame:
    """(n, a, b, cnt, mean_s, std_s): the profile of the events so far after every ``every`` events.

    Moments are combined by pair and tick and run over ranges of ticks; nothing is mined twice. Events of a
    case must be numbered in the order of their times."""
    rows = _moments(df, activities).withColumn("slot", F.ceil(F.col("n") / every))
    rows = rows.groupBy("a", "b", "slot").agg(*(F.sum(c).alias(c) for c in ("cnt", "d", "dd")))
    rows = running(rows, ["a", "b"], "slot", cnt=("sum", "cnt"), d=("sum", "d"), dd=("sum", "dd"), next_slot=("lead", "slot"))
    rows = at_ticks(rows, last_index(df) // every).withColumn("n", F.col("tick") * every)
    return _profile(rows, "n")


def behavioral_model(df: DataFrame) -> DataFrame:
    """(src, dst, p_min, p_max, f) of the log's relations, see ``behaviour.model_of``."""
    relations = directly_follows(df).select("src", "dst").distinct()
    sides = written(df.groupBy("case_id").agg(F.min_by("activity", "n").alias("first"), F.max_by("activity", "n").alias("last")).select("first", "last").distinct(), "sides")
    return model_of(relations, sides.select(F.col("first").alias("activity")), sides.select(F.col("last").alias("activity")))


def petri_net_model(spark, places: list[tuple[list[str | None], list[str | None], bool, bool]]) -> DataFrame:
    """A behavioural model from the places of a Petri net: (labels of the transitions before, labels of
    those after, marked at first, marked at last). Unlabelled transitions are passed over."""
    net = spark.createDataFrame(list(places), "into array<string>, out array<string>, initial boolean, final boolean")
    pairs = net.select(F.explode("into").alias("src"), "out").select("src", F.explode("out").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    starts = net.where("initial").select(F.explode("out").alias("activity")).where("activity IS NOT NULL")
    ends = net.where("final").select(F.explode("into").alias("activity")).where("activity IS NOT NULL")
    return model_of(pairs, starts, ends)
