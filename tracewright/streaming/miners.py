"""Miners of unbounded logs (n, case_id, activity, ...): the same rows as the batch operators.

What belongs to a case is kept under the case. What belongs to relations or activities is dealt over
``shards`` keys, each with a map in the state store. A tick must reach every shard, also those that
got no row: each event that ends a tick is passed on to all of them as a heartbeat, behind the
rows of its own n. Micro-batches must follow one another in the order of n."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.objects import type_pairs
from .processors import with_store

_RELATION = "shard int, beat boolean, n long, src string, dst string"


def seen_again(freq: int, error: int, last: int, bucket: int, strict: bool = False) -> tuple[int, int, bool]:
    """(freq, error, new) of an entry that occurs in ``bucket``: it starts anew if it was dropped at the
    end of an earlier bucket."""
    if freq and max(last, freq + error) > bucket - 1:
        return freq + 1, error, False
    return 1, bucket if strict else bucket - 1, True


class _Processor(StatefulProcessor):
    def ordered(self, rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
        return pd.concat(list(rows)).sort_values(list(by), kind="stable")

    def close(self) -> None:
        pass


class _LossyCases(_Processor):
    """The relations whose first half the lossy table of cases still knew."""

    def __init__(self, width: int, every: int, shards: int) -> None:
        self.width, self.every, self.shards = width, every, shards

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("case", "activity string, freq long, error long, last long")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        own = self.ordered(rows, "n")
        before, freq, error, last = self.state.get() or (None, 0, 0, 0)
        out = []
        for n, activity in zip(own["n"].tolist(), own["activity"]):
            bucket = -(-n // self.width)
            freq, error, new = seen_again(freq, error, last, bucket)
            if not new:
                out.append((0, False, n, before, activity))
            before, last = activity, bucket
            if (n + 1) % self.every == 0:
                out += [(k, True, n, None, None) for k in range(self.shards)]
        self.state.update((before, freq, error, last))
        yield pd.DataFrame(out, columns=["shard", "beat", "n", "src", "dst"])


class _LossyRelations(_Processor):
    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.table = handle.getMapState("relations", "src string, dst string", "freq long, error long, last long")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        table = {k: v for k, v in self.table.iterator()}
        known, changed, out = set(table), set(), []
        own = self.ordered(rows, "n", "beat")
        for n, beat, src, dst in zip(own["n"].tolist(), own["beat"].tolist(), own["src"], own["dst"]):
            if beat:
                gone = [k for k, (f, e, last) in table.items() if n >= self.width * max(last, f + e)]
                for k in gone:
                    del table[k]
                out += [(n, *k, v[0]) for k, v in table.items()]
            else:
                bucket = -(-n // self.width)
                freq, error, _ = seen_again(*table.get((src, dst), (0, 0, 0)), bucket)
                table[src, dst] = (freq, error, bucket)
                changed.add((src, dst))
        for k in known - table.keys():
            self.table.removeKey(k)
        for k in changed & table.keys():
            self.table.updateValue(k, table[k])
        yield pd.DataFrame(out, columns=["n", "src", "dst", "freq"])


def _sharded(rows: DataFrame, shards: int, *keys: str) -> DataFrame:
    """Rows dealt by their keys; heartbeats keep the shard that they were made for."""
    own = F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")
    return rows.withColumn("shard", F.when(F.col("beat"), F.col("shard")).otherwise(own)).groupBy("shard")


def heuristics_lossy_stream(df: DataFrame, model_update_frequency: int = 10, max_approx_error: float = 0.001, shards: int = 8) -> DataFrame:
    """(n, src, dst, freq), the rows of ``heuristics_lossy_ticks``. A case's state is its last activity
    and its lossy entry; a shard keeps the entries that lossy counting keeps, and drops the others at each tick."""
    width = math.ceil(1 / max_approx_error)
    cases = with_store(df.select("n", F.col("case_id").cast("string"), "activity")).groupBy("case_id")
    rows = cases.transformWithStateInPandas(_LossyCases(width, model_update_frequency, shards), _RELATION, outputMode="Append", timeMode="None")
    return _sharded(rows, shards, "src", "dst").transformWithStateInPandas(
        _LossyRelations(width), "n long, src string, dst string, freq long", outputMode="Append", timeMode="None"
    )


class _SimpleRelations(_Processor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.table = handle.getMapState("relations", "src string, dst string", "freq long")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        table = {k: v[0] for k, v in self.table.iterator()}
        changed, out = set(), []
        own = self.ordered(rows, "n", "beat")
        for n, beat, src, dst in zip(own["n"].tolist(), own["beat"].tolist(), own["src"], own["dst"]):
            if beat:
                out += [(n, *k, f) for k, f in table.items()]
            else:
                table[src, dst] = table.get((src, dst), 0) + 1
                changed.add((src, dst))
        for k in changed:
            self.table.updateValue(k, (table[k],))
        yield pd.DataFrame(out, columns=["n", "src", "dst", "freq"])


class _Follows(_Processor):
    def __init__(self, every: int, shards: int) -> None:
        self.every, self.shards = every, shards

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "activity string")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        own = self.ordered(rows, "n")
        known, out = self.last.get(), []
        for n, activity in zip(own["n"].tolist(), own["activity"]):
            if known is not None:
                out.append((0, False, n, known[0], activity))
            known = (activity,)
            if n % self.every == 0:
                out += [(k, True, n, None, None) for k in range(self.shards)]
        self.last.update(known)
        yield pd.DataFrame(out, columns=["shard", "beat", "n", "src", "dst"])


def simple_dfg_stream(df: DataFrame, model_update_frequency: int = 10, shards: int = 8) -> DataFrame:
    """(n, src, dst, freq) of all relations after every ``model_update_frequency`` events (2 at least);
    ``frequent_only`` keeps those that ``simple_dfg_ticks`` keeps. A tick's rows come from all shards in
    one micro-batch, so a batch of the sink holds whole ticks."""
    cases = with_store(df.select("n", F.col("case_id").cast("string"), "activity")).groupBy("case_id")
    rows = cases.transformWithStateInPandas(_Follows(max(model_update_frequency, 2), shards), _RELATION, outputMode="Append", timeMode="None")
    return _sharded(rows, shards, "src", "dst").transformWithStateInPandas(
        _SimpleRelations(), "n long, src string, dst string, freq long", outputMode="Append", timeMode="None"
    )


def frequent_only(rows: DataFrame, min_relative_frequency: float = 0.75) -> DataFrame:
    """(n, src, dst, freq, rel_freq) of a batch of whole ticks (in ``foreachBatch``, or of the sink's
    table): relations above the minimum share of their tick's most frequent one."""
    top = rows.groupBy("n").agg(F.max("freq").alias("top"))
    rows = rows.join(top, "n").withColumn("rel_freq", F.col("freq") / F.col("top"))
    return rows.where(F.col("rel_freq") > min_relative_frequency).select("n", "src", "dst", "freq", "rel_freq")


class _Entities(_Processor):
    """Lossy counts of cardinalities for the activities of a shard, in buckets of an activity's events."""

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "activity string", "d long")
        self.table = handle.getMapState("pairs", "activity string, a string, b string, card string", "freq long, error long, last long, born long")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        table = {k: v for k, v in self.table.iterator()}
        known, out = set(table), []
        own = self.ordered(rows, "n", "beat")
        for n, beat, activity, pairs in zip(own["n"].tolist(), own["beat"].tolist(), own["activity"], own["pairs"]):
            if beat:
                for k in [k for k, (f, e, last, _) in table.items() if seen[k[0]] >= self.width * max(last, f + e)]:
                    del table[k]
                best: dict = {}
                for (act, a, b, card), (freq, _, _, born) in table.items():
                    best[act, a, b] = max(best.get((act, a, b), (0, 0, "")), (freq, -born, card))
                out += [(n, *k, v[2]) for k, v in best.items()]
                continue
            seen[activity] = seen.get(activity, 0) + 1
            bucket = -(-seen[activity] // self.width)
            for p in pairs:
                at = (activity, p["type_a"], p["type_b"], p["cardinality"])
                freq, error, last, born = table.get(at, (0, 0, 0, n))
                freq, error, new = seen_again(freq, error, last, bucket, strict=True)
                table[at] = (freq, error, bucket, n if new else born)
        for k in known - table.keys():
            self.table.removeKey(k)
        for k, v in table.items():
            self.table.updateValue(k, v)
        for k, v in seen.items():
            self.seen.updateValue((k,), (v,))
        yield pd.DataFrame(out, columns=["n", "activity", "type_a", "type_b", "cardinality"])


def aer_lossy_stream(
    df: DataFrame, model_update_frequency: int = 10, max_approx_error: float = 0.01, control_flow: list[str] | None = None, shards: int = 8
) -> DataFrame:
    """(n, activity, type_a, type_b, cardinality), the rows of ``aer_lossy_ticks``, of a stream of events
    (n, activity, omap). Activities are dealt over the shards."""
    if not 0 < max_approx_error <= 1:
        raise ValueError("max_approx_error must lie in (0, 1]")
    pairs = type_pairs(df, control_flow, spread=False)
    rows = pairs.select("n", "activity", "pairs", F.lit(False).alias("beat"), F.lit(0).alias("shard"))
    none = F.lit(None).cast(pairs.schema["pairs"].dataType)
    beats = df.where((F.col("n") + 1) % model_update_frequency == 0).select(
        "n", F.lit(None).cast("string").alias("activity"), none.alias("pairs"), F.lit(True).alias("beat"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )
    return _sharded(with_store(rows.unionByName(beats)), shards, "activity").transformWithStateInPandas(
        _Entities(int(1 / max_approx_error)), "n long, activity string, type_a string, type_b string, cardinality string", outputMode="Append", timeMode="None"
    )


class _Moments(_Processor):
    """What each event adds to the moments of (earlier activity, its own)."""

    def __init__(self, every: int, shards: int) -> None:
        self.every, self.shards = every, shards

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "us long")
        self.past = handle.getMapState("past", "activity string", "c long, s double, q double")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        own = self.ordered(rows, "n")
        first = self.first.get()
        if first is None:
            first = (int(own["us"].iloc[0]),)
            self.first.update(first)
        past = {k[0]: v for k, v in self.past.iterator()}
        out = []
        for n, activity, us in zip(own["n"].tolist(), own["activity"], own["us"].tolist()):
            t = (us - first[0]) / 1e6
            out += [(0, False, n, a, activity, c, c * t - s, c * t * t - 2 * t * s + q) for a, (c, s, q) in past.items()]
            c, s, q = past.get(activity, (0, 0.0, 0.0))
            past[activity] = (c + 1, s + t, q + t * t)
            if n % self.every == 0:
                out += [(k, True, n, None, None, 0, 0.0, 0.0) for k in range(self.shards)]
        for a in set(own["activity"]):
            self.past.updateValue((a,), past[a])
        yield pd.DataFrame(out, columns=["shard", "beat", "n", "a", "b", "cnt", "d", "dd"])


class _Profile(_Processor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.table = handle.getMapState("pairs", "a string, b string", "cnt long, d double, dd double")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        table = {k: v for k, v in self.table.iterator()}
        changed, out = set(), []
        own = self.ordered(rows, "n", "beat")
        for n, beat, a, b, *added in own[["n", "beat", "a", "b", "cnt", "d", "dd"]].itertuples(index=False):
            if beat:
                for k, (cnt, d, dd) in table.items():
                    std = math.sqrt(max(0.0, dd - d * d / cnt) / (cnt - 1)) if cnt > 1 else 0.0
                    out.append((n, *k, cnt, d / cnt, std))
            else:
                table[a, b] = tuple(x + y for x, y in zip(table.get((a, b), (0, 0.0, 0.0)), added))
                changed.add((a, b))
        for k in changed:
            cnt, d, dd = table[k]
            self.table.updateValue(k, (int(cnt), float(d), float(dd)))
        yield pd.DataFrame(out, columns=["n", "a", "b", "cnt", "mean_s", "std_s"])


def temporal_profile_stream(df: DataFrame, every: int = 1, shards: int = 8) -> DataFrame:
    """(n, a, b, cnt, mean_s, std_s), the rows of ``temporal_profile_ticks``: the profile after every
    ``every`` events. A case keeps a count, sum and sum of squares for each of its activities, a shard
    three moments for each pair; nothing is mined again. The events of a case must come in the order of their times."""
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    cases = with_store(df.select("n", F.col("case_id").cast("string"), "activity", us)).groupBy("case_id")
    schema = "shard int, beat boolean, n long, a string, b string, cnt long, d double, dd double"
    rows = cases.transformWithStateInPandas(_Moments(every, shards), schema, outputMode="Append", timeMode="None")
    return _sharded(rows, shards, "a", "b").transformWithStateInPandas(
        _Profile(), "n long, a string, b string, cnt long, mean_s double, std_s double", outputMode="Append", timeMode="None"
    )


class _Deviations(_Processor):
    """Pairs of a case outside the profile; a case that is silent for too long is closed and forgotten."""

    def __init__(self, profile: dict, zeta: float, idle_ms: int | None) -> None:
        self.profile, self.zeta, self.idle_ms = profile, zeta, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getListState("past", "activity string, us long")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        own = self.ordered(rows, "n")
        past, fresh, out = list(self.past.get()), [], []
        for n, activity, us in zip(own["n"].tolist(), own["activity"], own["us"].tolist()):
            for a, before in past:
                held = self.profile.get((a, activity))
                if held is not None:
                    mean, std = held
                    delta = (us - before) / 1e6
                    if delta < mean - self.zeta * std or delta > mean + self.zeta * std:
                        out.append((n, key[0], a, activity, delta, abs(delta - mean) / std if std > 0 else None))
            past.append((activity, us))
            fresh.append((activity, us))
        self.past.appendList(fresh)
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(us for _, us in past) // 1000 + self.idle_ms)
        yield pd.DataFrame(out, columns=["n", "case_id", "a", "b", "delta_s", "z"]).astype({"z": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.past.clear()
        yield pd.DataFrame([], columns=["n", "case_id", "a", "b", "delta_s", "z"])


def temporal_conformance_stream(df: DataFrame, profile: DataFrame, zeta: float = 6.0, idle: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(n, case_id, a, b, delta_s, z), the rows of ``temporal_conformance``, as events come. The profile
    has a row for each pair of activities and travels with the operator. A case keeps the times of its events;
    with ``idle`` (such as "2 hours" of event time) a case is forgotten once the watermark, ``late``
    behind the newest event, has passed its last event by so much, and later events begin it anew."""
    held = {(r.a, r.b): (float(r.mean_s), float(r.std_s)) for r in profile.select("a", "b", "mean_s", "std_s").collect()}
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    rows = df.select("n", F.col("case_id").cast("string"), "activity", us, F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", late) if idle else rows
    return with_store(rows).groupBy("case_id").transformWithStateInPandas(
        _Deviations(held, zeta, _milliseconds(df, idle) if idle else None), "n long, case_id string, a string, b string, delta_s double, z double",
        outputMode="Append", timeMode="EventTime" if idle else "None",
    )


class _Summary(_Processor):
    """One row for a case when it ends, by a last activity or by silence."""

    def __init__(self, idle_ms: int, last: frozenset[str]) -> None:
        self.idle_ms, self.last = idle_ms, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("case", "events long, first string, newest string, began long, us long")

    def _told(self, key, why: str) -> tuple:
        events, first, newest, began, us = self.state.get()
        self.state.clear()
        return key[0], int(events), first, newest, int(began), int(us), why

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        own = self.ordered(rows, "us", "n")
        out = []
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for activity, us in zip(own["activity"], own["us"].tolist()):
            known = self.state.get()
            if known is not None and us // 1000 - known[4] // 1000 > self.idle_ms:
                out.append(self._told(key, "idle"))
                known = None
            events, first, _, began, newest = known or (0, activity, None, us, us)
            self.state.update((int(events) + 1, first, activity, int(began), max(us, int(newest))))
            if activity in self.last:
                out.append(self._told(key, "ended"))
        known = self.state.get()
        if known is not None:
            self.handle.registerTimer(int(known[4]) // 1000 + self.idle_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame([self._told(key, "idle")] if self.state.get() is not None else [])

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["case_id", "events", "first", "newest", "began_us", "ended_us", "why"])


def closed_cases(df: DataFrame, idle: str, last: tuple[str, ...] = (), late: str = "10 minutes") -> DataFrame:
    """(case_id, events, first, newest, began, ended, why) of a stream (n, case_id, activity, ts): a row for
    each case that ended, with an activity in ``last`` (``ended``) or by ``idle`` without events (``idle``).
    Its state goes then. Event-time timers fire once the watermark, ``late`` behind the newest event, is past
    them; rows later than the watermark are dropped by Spark. A case that comes back is a new one."""
    rows = df.select("n", F.col("case_id").cast("string"), "activity", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("ts"))
    found = with_store(rows.withWatermark("ts", late)).groupBy("case_id").transformWithStateInPandas(
        _Summary(_milliseconds(df, idle), frozenset(last)),
        "case_id string, events long, first string, newest string, began_us long, ended_us long, why string", outputMode="Append", timeMode="EventTime",
    )
    at = lambda c: F.timestamp_micros(c)
    return found.select("case_id", "events", "first", "newest", at("began_us").alias("began"), at("ended_us").alias("ended"), "why")


def _milliseconds(df: DataFrame, interval: str) -> int:
    """Of a text such as ``2 hours``, read by Spark."""
    one = df.sparkSession.range(1).select((F.unix_micros(F.expr(f"timestamp'1970-01-01 00:00:00Z' + interval {interval}")) / 1000).cast("long"))
    return one.first()[0]
