"""Limits and count-based windows over the arrival index ``n``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..order import last_index, with_index
from .filters import Operator


def take(k: int) -> Operator:
    return lambda df: df.filter(F.col("n") <= k)


def first_events(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first k events of a log that is not numbered yet, numbered: every task keeps k rows at most."""
    return with_index(df.orderBy(*order).limit(k), *order)


def skip_events(k: int) -> Operator:
    """Every k-th event: k, 2k, ..."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    return lambda df: df.filter(F.col("n") % k == 0)


def sliding_window(size: int, skip: int = 1, length: int | None = None) -> Operator:
    """Complete windows as rows (window_id, pos, event): window j holds events j*skip+1 .. j*skip+size.

    An event finds its windows by arithmetic, so nothing is shuffled. ``length`` is the number of
    events, read from the log where it is not given; the open windows at the end are left out."""
    if size < 1 or skip < 1:
        raise ValueError("size and skip must be 1 or more")

    def op(df: DataFrame) -> DataFrame:
        total = last_index(df) if length is None else length
        n = F.col("n")
        first = F.greatest(F.lit(0), F.ceil((n - size) / skip)).cast("long")
        last = F.least(F.floor((n - 1) / skip), F.lit((total - size) // skip)).cast("long")
        ids = F.when(first <= last, F.sequence(first, last))
        rows = df.withColumn("window_id", F.explode(ids))
        return rows.withColumn("pos", n - F.col("window_id") * skip)

    return op


def tumbling_window(size: int, length: int | None = None) -> Operator:
    return sliding_window(size, size, length)


def buffer_with_count(size: int) -> Operator:
    """As tumbling windows, but the last buffer may be short."""
    return lambda df: df.withColumn("window_id", F.floor((F.col("n") - 1) / size)).withColumn(
        "pos", F.col("n") - F.col("window_id") * size
    )


def sliding_window_to_log(df: DataFrame) -> DataFrame:
    """The rows of windows as small logs (window_id, case_id, activity, ts and attributes, in order)."""
    return df.sortWithinPartitions("window_id", "pos")


def pairwise(df: DataFrame, *per: str) -> DataFrame:
    """Each event with the one after it as ``next_case`` and ``next_activity``, within ``per``."""
    w = Window.partitionBy(*per).orderBy("n")
    return df.withColumn("next_case", F.lead("case_id").over(w)).withColumn("next_activity", F.lead("activity").over(w))


def pair_counts(df: DataFrame, size: int, src: str, dst: str) -> DataFrame:
    """(window_id, pairs): within buffers of ``size`` events, the adjacent pairs src, dst of one case."""
    pairs = pairwise(buffer_with_count(size)(df), "window_id")
    hit = (F.col("activity") == src) & (F.col("next_activity") == dst) & (F.col("case_id") == F.col("next_case"))
    return pairs.groupBy("window_id").agg(F.count(F.when(hit, 1)).alias("pairs"))


def session_cases(df: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(case_id, start, end, events, activities): the stretches of a case without a ``gap`` between
    events, batch or streaming (then with a watermark ``late`` behind). ``end`` is the last event's time
    plus the gap; ``activities`` counts the distinct ones."""
    rows = df.withWatermark("ts", late) if late else df
    by = F.session_window("ts", gap)
    found = rows.groupBy("case_id", by.alias("w")).agg(F.count("*").alias("events"), F.size(F.collect_set("activity")).cast("long").alias("activities"))
    return found.select("case_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "activities")
