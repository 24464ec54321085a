"""Small tests of the fluent log, callbacks, rendering and miners of one's own."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.functions import render
from tracewright.operators import conformance, discovery, objects
from tracewright.plans.log import EventLog
from tracewright.sources import dict_ocel_log, log_source
from tracewright.streaming import processors


def events(spark, activities, case="c"):
    return spark.createDataFrame([(i + 1, case, a) for i, a in enumerate(activities)], "n long, case_id string, activity string")


@pytest.mark.parametrize("cases,kept,stretch", [(9, 3, 7), (12, 5, 4), (4, 2, 50), (30, 4, 20)])
def test_forgotten_cases(spark, cases, kept, stretch):
    """Stretches with and without enough cases, against the definition."""
    rng = random.Random(cases)
    own = [str(rng.choice([rng.randrange(cases), rng.randrange(2)])) for _ in range(240)]
    df = spark.createDataFrame([(i + 1, c, "a") for i, c in enumerate(own)], "n long, case_id string, activity string")
    got = {r.n: r.life for r in conformance.case_restarts(df, kept, stretch).collect()}
    last, life = {}, {}
    for i, c in enumerate(own):
        gone = c not in last or len(set(own[last[c] + 1 : i])) >= kept
        life[c] = life.get(c, 0) + gone
        last[c] = i
        assert got[i + 1] - life[c] == got[own.index(c) + 1] - 1


def test_maps_and_multicast(spark):
    log = EventLog.of(spark, 1, 2, 3, 4)
    assert [r.d for r in log.map(d=F.col("value") * 2).to_list()] == [2, 4, 6, 8]
    assert sorted(r.x for r in log.flat_map("x", F.array("value", F.lit(0))).to_list()) == [0, 0, 0, 0, 1, 2, 3, 4]
    assert [r.e for r in log.map_not_null("e", F.when(F.col("value") % 2 == 0, F.col("value"))).to_list()] == [2, 4]
    assert [r.value for r in log.map_batches(lambda it: (p[p.value > 2] for p in it), "n long, value long").to_list()] == [3, 4]
    assert [r.value for r in log.tap("seen", F.count("*").alias("n")).to_list()] == [1, 2, 3, 4]
    shared = log.share()
    assert shared.df.is_cached and shared.find_any().value == 1
    shared.df.unpersist()
    same, handle = log.publish()
    assert same.df is log.df and not handle.is_connected
    handle.disconnect()


def test_map_with_state(spark):
    log = EventLog(events(spark, "ABA").unionByName(events(spark, "BB", "d")))

    def step(state, event):
        state = (state or "") + event.activity
        return state, [] if len(state) == 1 else [(event.n, state)]

    rows = sorted(tuple(r) for r in log.map_with_state(step, "n long, seen string").df.collect())
    assert rows == [("c", 2, "AB"), ("c", 3, "ABA"), ("d", 2, "BB")]


def test_callbacks(spark):
    log, told = EventLog.of(spark, 1, 2, 3), []
    log.subscribe(lambda r: told.append(r.value), on_completed=lambda: told.append("done"))
    assert told == [1, 2, 3, "done"]

    def fail(row):
        raise KeyError(row.value)

    log.subscribe(fail, on_error=lambda e: told.append(type(e)), on_completed=lambda: told.append("no"))
    assert told[-1] is KeyError
    with pytest.raises(KeyError):
        log.sink(fail, close=lambda: told.append("closed"))
    assert told[-1] == "closed"
    lines = []
    log.print_sink(lambda r: lines.append(r.value) or "")
    assert lines == [1, 2, 3]


def test_tables_keep_their_order(spark):
    t = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame({"case:concept:name": ["2", "1", "2"], "concept:name": ["z", "y", "a"], "time:timestamp": [t, t, t], "cost": [1, 2, 3]})
    assert [(r.case_id, r.activity, r.cost) for r in log_source(spark, pdf).orderBy("n").collect()] == [("2", "z", 1), ("1", "y", 2), ("2", "a", 3)]
    assert log_source(spark, object()).count() == 0
    with pytest.raises(Exception):
        log_source(spark, pd.DataFrame({"nothing": [1]})).count()


def test_rendering(spark):
    edges = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 0.25), ("L", "L", 0.05)], "src string, dst string, weight double")
    dot = render.dfg_to_dot(edges)
    for line in ('"A" -> "B" [penwidth=5.00, label="1.00"];', '"L" -> "L" [penwidth=0.50, label="0.05"];', '"__start__" -> "A"', '"C" -> "__end__"', '"L" -> "__end__"'):
        assert line in dot
    pairs = spark.createDataFrame([("a", "b", 2), ("b", "b", 1)], "src string, dst string, freq int")
    assert sorted(map(tuple, render.heatmap(pairs).select("src", "a", "b").collect())) == [("a", 0, 2), ("b", 0, 1)]
    graph = pairs.withColumn("object_type", F.lit("Order"))
    assert '"a" -> "b"' in render.ocdfg_to_dot(graph)
    assert [r.line for r in render.ocdfg_lines(graph.where("src = 'a'")).collect()] == ["a --(Order)--> b [2]"]
    aer = spark.createDataFrame([("pay", "Customer", "Order", "1..N")], "activity string, type_a string, type_b string, cardinality string")
    assert [r.line for r in render.aer_lines(aer).collect()] == ["pay: Customer → Order [1..N]"]
    assert '"pay/Customer" -> "pay/Order" [dir=none, label="1..N"];' in render.aer_to_dot(aer)
    assert len({render.colour(i) for i in range(40)}) == 40
    assert render.event_text(events(spark, "A")).first().text == '{"n":1,"case_id":"c","activity":"A"}'


def test_petri_net(spark):
    places = [([], ["A"], True, False), (["A"], ["B", None], False, False), (["B"], ["C"], False, False), (["C"], [], False, True)]
    assert sorted(map(tuple, discovery.petri_net_model(spark, places).collect())) == [("A", "B", 0, 0, 1), ("B", "C", 1, 1, 0)]


def test_miners_of_ones_own(spark):
    steps = [{"activity": a, "objects": {t: ["x"] for t in ts}} for a, ts in (("open", "PQ"), ("work", "PQR"), ("close", "P"))]
    own = dict_ocel_log(spark, [(steps, 6)])
    indexed = objects.per_type_index(objects.flatten(own))
    called = []

    def miner(freq):
        return lambda df: called.append(freq) or discovery.simple_dfg_ticks(df, freq, 0.0)

    messages, models = objects.mined_types(indexed, {"P": miner(6), "Q": miner(4)})
    assert called == [6, 4]
    rows = messages.orderBy("msg").collect()
    assert [(r.msg, r.object_type, r.type_n) for r in rows if r.object_type == "P"] == [(r.msg, "P", 6 * k) for k, r in enumerate((r for r in rows if r.object_type == "P"), 1)]
    assert {r.type_n for r in rows if r.object_type == "Q"} == {4, 8, 12} and not any(r.object_type == "R" for r in rows)
    assert {(r.src, r.dst, r.freq) for r in models.where("object_type = 'Q' AND n = 12").collect()} == {("open", "work", 6)}
    assert objects.get_mode() == "dynamic" and objects.get_mode(["P"]) == "static"
    for bad, error in ((False, TypeError), ({"P": 1}, ValueError)):
        with pytest.raises(error):
            objects.get_mode(bad)
    with pytest.raises(TypeError):
        objects.dfg_messages(indexed, control_flow={"P": miner(2)})
    # A strategy of one's own: all types switched on by the first message.
    commands = objects.create_command(messages.where("msg = 1"), "P", "ACTIVE")
    merged = objects.spelled_out(objects.merged_ocdfg(messages, models, commands))
    assert {r.object_type for r in merged.collect()} == {"P"}
    told = objects.oc_stream(own, messages, lambda m: objects.create_command(m.where("msg = 1"), "P", "ACTIVE"), 5).orderBy("pos").collect()
    kinds = [r.type for r in told]
    assert kinds.index("command") + 1 == kinds.index("dfg") and kinds.count("aer") == 3 and kinds.count("dfg") == len(rows)
    with pytest.raises(ValueError):
        objects.create_command(messages, "P", "ON")
    ends = {(r.activity, r.is_start) for r in objects.type_ends(merged.where("msg = 1"), "P").collect()}
    assert ("open", True) in ends or ends == set()


def test_event_time_windows(spark, tmp_path):
    rows = [(i, "c", "a" if i % 2 else "b", f"2024-01-01 00:{i:02d}:00") for i in range(20)]
    spark.createDataFrame(rows, "n long, case_id string, activity string, ts string").selectExpr("n", "case_id", "activity", "timestamp(ts) AS ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long, case_id string, activity string, ts timestamp").parquet(str(tmp_path / "in"))
    counts = processors.event_time_counts(stream, "5 minutes", late="1 minute")
    q = counts.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("windows").collect()
    assert q.exception() is None and sum(r.freq for r in rows) == 15 and {r.activity for r in rows} == {"a", "b"}
