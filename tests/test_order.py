"""Numbers within keys, counted where rows are, and tables that go when nobody reads them any more."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracewright import order
from tracewright.operators import discovery, objects
from tracewright.order import with_index
from tracewright.plans import queries
from tracewright.workspace import Passing, shared_dir, written


def refuse(*_, **__):
    raise AssertionError("rows were put in order")


def odd_log(spark):
    """Events with null and empty maps and lists, unsorted and repeated ids, and what their index is."""
    rng = random.Random(3)
    kinds, ids = ["Part", "Order", "Cust", "é"], [None, "b", "a", "aa", "10", "9", "é"]
    omap = lambda: {t: None if rng.random() < 0.1 else rng.choices(ids, k=rng.choice([0, 1, 1, 2, 4])) for t in rng.sample(kinds, rng.randint(0, 4))}
    rows = [(n, rng.choice("AB"), None if rng.random() < 0.05 else omap()) for n in range(1, 300)]
    want, seen = [], {}
    for n, a, m in rows:
        flat = [(t, i) for t in sorted(m or {}) for i in sorted(set(m[t] or []), key=lambda x: (x is not None, x or ""))]
        for p, (t, i) in enumerate(flat, 1):
            seen[t] = seen.get(t, 0) + 1
            want.append((n, p, t, i or "", a, seen[t]))
    df = spark.createDataFrame(rows, "n long, activity string, omap map<string,array<string>>").withColumn("ts", F.lit(0))
    return df, want


def index_rows(df):
    found = df.na.fill("", ["case_id"]).select("event_n", "flat_pos", "object_type", "case_id", "activity", "n").collect()
    return sorted(map(tuple, found))


@pytest.mark.parametrize("batch", ["13", "10000"])
def test_index_of_types(spark, batch):
    df, want = odd_log(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for own in (df, df.repartition(3), df.orderBy(F.col("n").desc())):
            assert index_rows(objects.flat_index(own)) == want
            assert index_rows(objects.per_type_index(objects.flatten(own))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ordered_rows_are_numbered_in_place(spark, monkeypatch):
    """No row of a log that is read in its order moves."""
    df, want = odd_log(spark)
    own = df.repartitionByRange(4, "n").sortWithinPartitions("n")
    monkeypatch.setattr(order, "with_index", refuse)
    assert index_rows(objects.per_type_index(objects.flatten(own))) == want


def test_runs_that_overlap(spark, monkeypatch):
    """Rows 1, 2, 3, 4 of a key beside 2, 3 of the same numbers: the two runs cannot be told by their first rows."""
    rows = [(n, p, "k") for p in (1, 2) for n in range(1, 5)]
    df = spark.createDataFrame(rows, "n long, p int, k string").coalesce(1)
    moved = []
    monkeypatch.setattr(order, "with_index", lambda *a, **k: moved.append(1) or with_index(*a, **k))
    got = sorted(map(tuple, order.numbered_within(df, "k", "n", "p", name="i").select("n", "p", "i").collect()))
    assert moved and got == [(n, p, 2 * n + p - 2) for n in range(1, 5) for p in (1, 2)]


def test_many_runs(spark, monkeypatch):
    df, want = odd_log(spark)
    monkeypatch.setattr(order, "MOST_RUNS", 2)
    assert index_rows(objects.flat_index(df)) == want


def tables(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_passing_tables(spark):
    before = tables(spark)
    with Passing() as outer:
        with Passing() as stage:
            first = written(spark.range(9), "first")
            kept = stage.keep(first.where("id > 4"), "kept")
        assert len(tables(spark) - before) == 1 and kept.count() == 4
    assert tables(spark) == before and outer.paths


def test_merged_models_leave_no_large_table(spark):
    """Of the log itself only its events stay, each with its objects; the rows of every object go."""
    before = tables(spark)
    _, messages, _, _ = queries._merged(spark, "/root/testdata/sf0.001")
    left = {t.rsplit("-", 1)[0] for t in tables(spark) - before}
    assert messages.count() > 0 and "runs" not in left and "models" in left


def test_models_come_where_the_miner_says(spark):
    df, _ = odd_log(spark)
    indexed = objects.flat_index(df.na.fill("?"))
    miner = lambda events: events.where("n % 4 = 0").select("n", F.lit("a").alias("src"), F.lit("b").alias("dst"), F.lit(1).cast("long").alias("freq"))
    rows = lambda at: sorted(map(tuple, objects.mined_types(indexed, {"Part": miner, "Cust": miner}, told_at=at)[0].collect()))
    assert rows(F.expr("n % 4 = 0")) == rows(None) != []
    with pytest.raises(ValueError):
        objects.mined_types(indexed, {"Part": miner}, told_at=F.expr("n % 8 = 0"))


def test_ends_read_the_edges_once(spark, tmp_path):
    rows = [("x", "a", "b"), ("x", "b", "b"), ("x", "b", "c"), ("y", "d", "d"), ("y", None, "e")]
    spark.createDataFrame(rows, "g string, src string, dst string").write.parquet(str(tmp_path / "edges"))
    ends = discovery.start_end_activities(spark.read.parquet(str(tmp_path / "edges")), by=("g",))
    assert sorted(map(tuple, ends.collect())) == [("x", "a", True, False), ("x", "c", False, True)]
    assert ends._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_models_of_types_move_no_event(spark, monkeypatch):
    """Events are numbered within their activity where they are, and met by their shapes; types may come in any order."""
    rows = [(n, "AB"[n % 2], {t: ["x"] * (1 + n % 3 // 2) for t in (["P", "Q"] if n % 5 else ["Q", "P"])}) for n in range(1, 60)]
    df = spark.createDataFrame(rows, "n long, activity string, omap map<string,array<string>>").repartitionByRange(3, "n").sortWithinPartitions("n")
    for module in (order, objects):
        monkeypatch.setattr(module, "with_index", refuse)
    found = objects.aer_lossy_ticks(df, 20, 0.25).collect()
    assert {(r.n, r.activity, r.type_a, r.type_b) for r in found} == {(n, a, "P", "Q") for n in (19, 39, 59) for a in "AB"}
    kinds = {tuple(r)[1:] for r in objects.shape_pairs(objects.shapes(df)).collect()}
    assert kinds == {tuple(r)[1:] for r in objects.type_pairs(df).collect()}


def test_spans_are_entered_for_widths_there_are(spark):
    from tracewright.functions.spans import overlaps

    short = spark.range(0, 64).select(F.lit("k").alias("k"), F.col("id").alias("from"), F.col("id").alias("to"), F.col("id").alias("i"))
    long = spark.createDataFrame([("k", 0, 1 << 40, 1)], "k string, from long, to long, j long")
    pairs = overlaps(short, long, ["k"], 1 << 40)
    assert pairs.count() == 64
    assert "lambdafunction" in pairs._jdf.queryExecution().optimizedPlan().toString()  # widths are taken from a list, not from 0 to 40


def test_irregular_models_pair_no_event(spark, monkeypatch):
    """The pairs of types are those of counted shapes: events are not joined with themselves."""
    own = queries.oc_log(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(objects, "type_pairs", refuse)
    aer, ticks = queries._irregular_aer(own)
    assert 0 < aer.select("n").distinct().count() <= ticks.count()
