"""Streaming miners give the batch operators' rows, over several micro-batches and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import conformance, discovery, objects, windows
from tracewright.streaming import miners

SCHEMA = "n long, case_id string, activity string, ts string"


def put(spark, folder, rows, schema, files):
    for i in range(files):
        part = rows[len(rows) * i // files : len(rows) * (i + 1) // files]
        df = spark.createDataFrame(part, schema)
        if "ts" in df.columns:
            df = df.withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    schema = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(spark, df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.schema(df.schema).parquet(str(tmp_path / name))


def restarted(spark, tmp_path, name, rows, schema, make):
    """The stream's rows, its query stopped after two thirds of the input and started again from its checkpoint."""
    folder = tmp_path / f"{name}-in"
    put(spark, folder, rows[: len(rows) * 2 // 3], schema, 2)
    drain(spark, make(stream(spark, folder)), tmp_path, name)
    put(spark, folder, rows[len(rows) * 2 // 3 :], schema, 1)
    return drain(spark, make(stream(spark, folder)), tmp_path, name)


def log_rows(seed, n=90):
    rng = random.Random(seed)
    return [(i + 1, f"c{rng.randint(0, 8)}", rng.choice("ABCD"), f"2024-01-01 {i // 60:02d}:{i % 60:02d}:0{rng.randint(0, 9)}") for i in range(n)]


def same(got, want, *rounded):
    cols = [c for c in want.columns if c not in rounded]
    pick = lambda df: sorted(map(tuple, df.select(*cols, *(F.round(c, 6).alias(c) for c in rounded)).collect()), key=str)
    assert pick(got) == pick(want) and want.count() > 0


def test_lossy_heuristics(spark, tmp_path):
    rows = log_rows(1)
    batch = spark.createDataFrame(rows, SCHEMA)
    got = restarted(spark, tmp_path, "hm", rows, SCHEMA, lambda s: miners.heuristics_lossy_stream(s, 7, 0.1, shards=2))
    same(got, discovery.heuristics_lossy_ticks(batch, 7, 0.1))


def test_simple_dfg(spark, tmp_path):
    rows = log_rows(2)
    batch = spark.createDataFrame(rows, SCHEMA)
    got = restarted(spark, tmp_path, "dfg", rows, SCHEMA, lambda s: miners.simple_dfg_stream(s, 10, shards=2))
    same(miners.frequent_only(got, 0.3), discovery.simple_dfg_ticks(batch, 10, 0.3), "rel_freq")


def test_entity_relations(spark, tmp_path):
    rng = random.Random(3)
    schema = "n long, activity string, omap map<string,array<string>>"
    rows = [(i, rng.choice("PQR"), {t: [f"{t}{k}" for k in range(rng.choice([1, 1, 2]))] for t in rng.sample(["Item", "Order", "User"], rng.randint(1, 3))}) for i in range(1, 91)]
    got = restarted(spark, tmp_path, "aer", rows, schema, lambda s: miners.aer_lossy_stream(s, 9, 0.25, shards=2))
    same(got, objects.aer_lossy_ticks(spark.createDataFrame(rows, schema), 9, 0.25))


def test_temporal_profile(spark, tmp_path):
    rows = log_rows(4, 60)
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp("ts"))
    got = restarted(spark, tmp_path, "tp", rows, SCHEMA, lambda s: miners.temporal_profile_stream(s, 1, shards=2))
    want = discovery.temporal_profile_ticks(batch, 1)
    same(got, want, "mean_s", "std_s")
    same(want.where("n = 60").drop("n"), discovery.temporal_profile(batch), "mean_s", "std_s")


@pytest.mark.parametrize("idle", [None, "20 hours"])
def test_temporal_conformance(spark, tmp_path, idle):
    rows = log_rows(5, 60)
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp("ts"))
    profile = discovery.temporal_profile(batch)
    got = restarted(spark, tmp_path, f"tc{idle is None}", rows, SCHEMA, lambda s: miners.temporal_conformance_stream(s, profile, 1.0, idle))
    same(got, conformance.temporal_conformance(batch, profile, 1.0), "delta_s", "z")


def test_closed_cases(spark, tmp_path):
    """Cases end by a last activity or by silence; late rows are dropped; what is still open stays open."""
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    rows = [(1, "a", "open", at(0)), (2, "b", "open", at(1)), (3, "a", "work", at(5)), (4, "a", "close", at(6)), (5, "c", "open", at(50)), (6, "c", "work", at(55))]
    rows += [(7, "b", "late", at(2)), (8, "d", "open", at(100)), (9, "b", "open", at(101))]
    folder = tmp_path / "cc-in"
    for part in (rows[:4], rows[4:6], rows[6:]):
        put(spark, folder, part, SCHEMA, 1)
    got = drain(spark, miners.closed_cases(stream(spark, folder), "20 minutes", ("close",), late="1 minute"), tmp_path, "cc")
    found = sorted((r.case_id, r.events, r.first, r.newest, r.why) for r in got.collect())
    assert found == [("a", 3, "open", "close", "ended"), ("b", 1, "open", "open", "idle"), ("c", 2, "open", "work", "idle")]


def test_sessions(spark, tmp_path):
    rows = log_rows(6, 40)
    rows += [(100 + i, "c1", "A", f"2024-01-02 0{i}:00:00") for i in range(3)]
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp("ts"))
    want = windows.session_cases(batch, "10 minutes")
    put(spark, tmp_path / "se-in", [*rows, (999, "end", "A", "2024-01-05 00:00:00")], SCHEMA, 2)
    got = drain(spark, windows.session_cases(stream(spark, tmp_path / "se-in"), "10 minutes", late="1 day"), tmp_path, "se")
    same(got, want)
