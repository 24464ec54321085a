"""Lossy counting without a sequential pass.

With buckets of w events, a key's entry is dropped when its count since insertion plus its error term
falls to the bucket number. Let C(b) be how often the key occurred before bucket b and g(b) = C(b) - b,
over the buckets it occurs in. An entry inserted in bucket a has died before its next occurrence in
bucket b exactly if g(b) <= g(a) (g(b) < g(a) where the error term is a instead of a - 1). So lives
begin at the running minima of g, and any number of keys and occurrences is counted in closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


def lossy_states(occurrences: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """(keys, b, slot, first_n, freq, reach, born, next_slot): the entry of a key after each group of
    occurrences.

    ``occurrences`` has the keys, n, b (bucket) and slot (any non-decreasing function of n whose last
    occurrence is wanted, such as the next tick), and, where it is counted by these already, cnt. The entry is there until event
    width * greatest(b, reach) of the counted sequence; ``born`` is the n that began its life. Counts are
    combined by key, bucket and slot, and run over ranges of n, so that a key of any share is split."""
    rows = occurrences.groupBy(*keys, "b", "slot").agg((F.sum("cnt") if "cnt" in occurrences.columns else F.count("*")).alias("cnt"), F.min("n").alias("first_n"))
    rows = running(rows, keys, "first_n", before=("before", "cnt"), previous=("lag", "b"), next_slot=("lead", "slot"))
    first = F.col("previous").isNull() | (F.col("previous") != F.col("b"))
    # A life begins where g is as low as never before (strictly lower, if strict): its row has the least (g, place).
    g = F.col("before") - F.col("b")
    place = F.col("first_n") if strict else -F.col("first_n")
    rows = running(rows, keys, "first_n", life=("min", F.when(first, F.struct(g.alias("g"), place.alias("place"), "before", "b", "first_n"))))
    rows = rows.withColumn("new", F.col("life.first_n") == F.col("first_n"))
    rows = rows.withColumn("freq", F.col("before") + F.col("cnt") - F.col("life.before"))
    error = F.col("life.b") if strict else F.col("life.b") - 1
    rows = rows.withColumn("reach", F.col("freq") + error).withColumn("born", F.col("life.first_n"))
    return rows.select(*keys, "b", "slot", "first_n", "freq", "reach", "born", "next_slot", "new")


def at_ticks(states: DataFrame, last_slot: int, dead_slot: Column | None = None) -> DataFrame:
    """One row for each tick (slot) that an entry is the latest of its key at; ``dead_slot`` is the last
    tick it lives to."""
    end = F.coalesce(F.col("next_slot") - 1, F.lit(last_slot))
    end = F.least(end, F.lit(last_slot)) if dead_slot is None else F.least(end, F.lit(last_slot), dead_slot)
    rows = states.withColumn("__end", end.cast("long")).where("slot <= __end")
    return rows.withColumn("tick", F.explode(F.sequence(F.col("slot").cast("long"), F.col("__end")))).drop("__end")
