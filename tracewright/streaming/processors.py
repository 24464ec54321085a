"""The stateful operators on unbounded logs, keyed by case, with state in the state store."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.discovery import BudgetState

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


class _LastActivity(StatefulProcessor):
    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "activity string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("n")
        known = self.last.get()
        src = own["activity"].shift(1, fill_value=known[0] if known else None)
        self.last.update((own["activity"].iloc[-1],))
        out = pd.DataFrame({"n": own["n"], "case_id": key[0], "src": src, "dst": own["activity"]})
        yield out if known else out.iloc[1:]

    def close(self) -> None:
        pass


def directly_follows_stream(df: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(n, case_id, src, dst) of a stream (n, case_id, activity): a case's state is its last activity,
    forgotten after ``ttl_ms`` without events if that is given."""
    keyed = with_store(df.select("n", F.col("case_id").cast("string"), "activity")).groupBy("case_id")
    return keyed.transformWithStateInPandas(
        _LastActivity(ttl_ms), "n long, case_id string, src string, dst string", outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )


def dfg_stream(df: DataFrame) -> DataFrame:
    """Running (src, dst, freq); write it in complete or update mode."""
    return directly_follows_stream(df).groupBy("src", "dst").agg(F.count("*").alias("freq"))


class _Behaviour(StatefulProcessor):
    def __init__(self, model: dict, most: int) -> None:
        self.model, self.most = model, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "activity string, wrong long")
        self.seen = handle.getMapState("seen", "src string, dst string", "one boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("n")
        last, wrong = self.state.get() or (None, 0)
        right = sum(1 for _ in self.seen.keys())
        out = []
        for n, activity in zip(own["n"], own["activity"]):
            if last is not None:
                known = self.model.get((last, activity))
                if known is None:
                    wrong += 1
                    sure = part = -1.0
                else:
                    if not self.seen.containsKey((last, activity)):
                        self.seen.updateValue((last, activity), (True,))
                        right += 1
                    low, high, f = known
                    part = 1.0 if low is not None and low <= right <= high else min(1.0, right / (low + 1)) if low is not None else 0.0
                    sure = 1 - (self.most if f is None else f) / self.most if self.most else 1.0
                out.append((n, key[0], right / (right + wrong), sure, part))
            last = activity
        self.state.update((last, wrong))
        yield pd.DataFrame(out, columns=["n", "case_id", "conformance", "confidence", "completeness"])

    def close(self) -> None:
        pass


def behavioral_conformance_stream(df: DataFrame, model: DataFrame) -> DataFrame:
    """As the batch operator, on a stream; the model has a row for each relation and travels with the
    operator."""
    number = lambda v: None if v is None else int(v)
    rows = {(r.src, r.dst): (number(r.p_min), number(r.p_max), number(r.f)) for r in model.collect()}
    most = max((f for _, _, f in rows.values() if f is not None), default=0)
    keyed = with_store(df.select("n", F.col("case_id").cast("string"), "activity")).groupBy("case_id")
    schema = "n long, case_id string, conformance double, confidence double, completeness double"
    return keyed.transformWithStateInPandas(_Behaviour(rows, most), schema, outputMode="Append", timeMode="None")


class _Soft(StatefulProcessor):
    def __init__(self, weights: dict, scale: float) -> None:
        self.weights, self.scale = weights, scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "activity string, k long, total double, log double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        import math

        own = pd.concat(list(rows)).sort_values("n")
        last, k, total, log = self.state.get() or (None, 0, 0.0, 1.0)
        out = []
        for n, activity in zip(own["n"], own["activity"]):
            if last is not None:
                p = self.weights.get((last, activity), 0.0)
                k, total, log = k + 1, total + p, log + (-math.log(p) if p > 0 else math.inf)
            mean = total / k if k else 0.0
            out.append((n, key[0], log, mean, mean / self.scale))
            last = activity
        self.state.update((last, k, total, log))
        yield pd.DataFrame(out, columns=["n", "case_id", "log_prob", "mean_prob", "soft_conformance"])

    def close(self) -> None:
        pass


def soft_conformance_stream(df: DataFrame, pdfa: DataFrame, alpha: float = 0.5) -> DataFrame:
    """As the batch operator with room for all cases (the state store is the table of cases)."""
    from ..operators.conformance import node_count, normalize_weights

    size = node_count(pdfa)
    weights = {(r.src, r.dst): r.prob for r in normalize_weights(pdfa, alpha).collect()}
    keyed = with_store(df.select("n", F.col("case_id").cast("string"), "activity")).groupBy("case_id")
    schema = "n long, case_id string, log_prob double, mean_prob double, soft_conformance double"
    return keyed.transformWithStateInPandas(_Soft(weights, alpha + (1 - alpha) / max(1, size)), schema, outputMode="Append", timeMode="None")


class _Budget(StatefulProcessor):
    def __init__(self, budget: int, every: int) -> None:
        self.budget, self.every = budget, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "pickled binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        import pickle

        own = pd.concat(list(rows)).sort_values("n")
        kept = self.state.get()
        state = pickle.loads(bytes(kept[0])) if kept else BudgetState(self.budget)
        out = []
        for n, case, activity in zip(own["n"], own["case_id"], own["activity"]):
            state.observe(case, activity)
            if n % self.every == 0:
                out += [(n, a, b, v[0]) for (a, b), v in state.relations.items()]
        self.state.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=["n", "src", "dst", "freq"])

    def close(self) -> None:
        pass


def heuristics_budget_stream(df: DataFrame, model_update_frequency: int = 10, budget: int = 100) -> DataFrame:
    """Budgeted lossy counting of a stream: one key, as the budget spans all cases."""
    rows = df.select("n", F.col("case_id").cast("string"), "activity", F.lit(0).alias("all"))
    return with_store(rows).groupBy("all").transformWithStateInPandas(
        _Budget(budget, model_update_frequency), "n long, src string, dst string, freq long", outputMode="Append", timeMode="None"
    )


def event_time_counts(df: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, activity, freq) in event-time windows; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = df.withWatermark("ts", late).groupBy(window.alias("w"), "activity").agg(F.count("*").alias("freq"))
    return rows.select(F.col("w.start").alias("start"), "activity", "freq")


def dot_sink(render: Callable[[DataFrame], str], folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes what ``render`` makes of each batch to ``folder`` as one text file,
    through Spark, so any file system will do."""

    def write(batch: DataFrame, number: int) -> None:
        text = render(batch)
        batch.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, f"{number}.dot"))

    return write
