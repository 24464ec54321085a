import json

from pyspark.sql import functions as F

from tracewright.operators import conformance, discovery, filters, windows
from tracewright.plans.log import EventLog
from tracewright.sources import dict_ocel_log, event_source, log_source, ocel2_json_log, string_log, topic_events, xes_log
from tracewright.sources.custom import read
from tracewright.streaming import behavioral_conformance_stream, dfg_stream, directly_follows_stream, heuristics_budget_stream, soft_conformance_stream


def test_string_and_dict_sources(spark):
    rows = [(r.n, r.case_id, r.activity) for r in string_log(spark, ["AB", "", "C"]).orderBy("n").collect()]
    assert rows == [(1, "case_1", "A"), (2, "case_1", "B"), (3, "case_3", "C")]
    assert [r.activity for r in log_source(spark, ["X"]).collect()] == ["X"]
    step = lambda a: {"activity": a, "objects": {"T": ["i", "j"]}}
    log = dict_ocel_log(spark, [([step(a) for a in "abcdefghi"], 10), ([step(a) for a in "abcde"], 5)], shuffle=True, seed=4)
    assert log.count() == 115 and log.where("event_id = 'e114'").first().omap["T"][0].startswith("i_")


def test_xes(spark, tmp_path):
    f = tmp_path / "a.xes"
    f.write_text(
        '<?xml version="1.0"?><log><trace><string key="concept:name" value="t1"/><string key="who" value="me"/>'
        '<event><string key="concept:name" value="b"/><date key="time:timestamp" value="2020-01-02T00:00:00+00:00"/><int key="cost" value="3"/></event>'
        '<event><string key="concept:name" value="a"/><date key="time:timestamp" value="2020-01-01T00:00:00+00:00"/></event></trace>'
        '<trace><string key="concept:name" value="t2"/><event><string key="concept:name" value="c"/><date key="time:timestamp" value="2020-01-03T00:00:00+00:00"/></event></trace></log>'
    )
    rows = xes_log(spark, str(f)).orderBy("n").collect()
    assert [(r.case_id, r.activity) for r in rows] == [("t1", "a"), ("t1", "b"), ("t2", "c")]
    assert rows[1].event_attrs == {"cost": "3"} and rows[0].trace_attrs == {"who": "me"}


def test_ocel2(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text(json.dumps({
        "events": [
            {"id": "e2", "type": "pay", "time": "2024-01-02T00:00:00Z", "attributes": [{"name": "x", "value": "1"}], "relationships": [{"objectId": "o1", "qualifier": ""}]},
            {"id": "e1", "type": "order", "time": "2024-01-01T00:00:00Z", "attributes": [], "relationships": [{"objectId": "o1", "qualifier": ""}, {"objectId": "c1", "qualifier": ""}]},
        ],
        "objects": [{"id": "o1", "type": "Order"}, {"id": "c1", "type": "Customer"}],
    }))
    rows = ocel2_json_log(spark, str(f)).orderBy("n").collect()
    assert [(r.activity, r.omap, r.vmap) for r in rows] == [("order", {"Customer": ["c1"], "Order": ["o1"]}, {}), ("pay", {"Order": ["o1"]}, {"x": "1"})]


def test_topics(spark):
    df = spark.createDataFrame([("base/P/c1/act", '{"a": 1}'), ("c2/go", "no json")], "topic string, payload string")
    rows = sorted((r.process, r.case_id, r.activity, r.event_attrs or {}) for r in topic_events(df).collect())
    assert rows == [("P", "c1", "act", {"a": "1"}), ("Process", "c2", "go", {})]


def test_fluent_log(spark):
    log = EventLog.of(spark, 1, 2, 3, 4, 5)
    sums = log.pipe(windows.sliding_window(3)).df.groupBy("window_id").agg(F.sum("value").alias("s")).orderBy("window_id")
    assert [r.s for r in sums.collect()] == [6, 9, 12]
    assert log.all_match(F.col("value") > 0) and not log.all_match(F.col("value") > 1)
    assert EventLog.empty(spark).all_match(F.col("value") > 1) and EventLog.empty(spark).find_first() is None
    assert log.find_first(F.col("value") > 2).value == 3
    assert [r.value for r in log.concat(EventLog.of(spark, 9)).take(6).to_list()] == [1, 2, 3, 4, 5, 9]
    seen, closed = [], []
    log.filter(F.col("value") % 2 == 0).sink(lambda r: seen.append(r.value), lambda: closed.append(1))
    assert seen == [2, 4] and closed == [1]
    log2 = string_log(spark, ["ab", "b"])
    assert log2.transform(filters.retains_activity_filter("ab")).count() == 0
    assert log2.transform(filters.excludes_on_event_attribute_equal_filter("x", "1")).count() == 3


def test_custom_source(spark):
    source = event_source("numbers_for_test", "n long, activity string", lambda a, b: ((i + 1, "x") for i in range(a, b)), shards=3)
    assert sorted(r.n for r in read(spark, source, stop=10).collect()) == list(range(1, 11))


def stream_of(spark, tmp_path, rows):
    """A file stream of three batches."""
    for i in range(3):
        part = rows[len(rows) * i // 3 : len(rows) * (i + 1) // 3]
        spark.createDataFrame(part, "n long, case_id string, activity string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("n long, case_id string, activity string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i + 1, f"c{i * 7 % 5}", "ABCD"[i * i % 4]) for i in range(60)]
    batch = spark.createDataFrame(rows, "n long, case_id string, activity string")
    stream = stream_of(spark, tmp_path, rows)
    key = lambda df, cols: sorted(map(str, df.select(*cols).collect()))
    cols = ["n", "case_id", "src", "dst"]
    assert key(run(spark, directly_follows_stream(stream), tmp_path, "df1"), cols) == key(discovery.directly_follows(batch), cols)
    cols = ["src", "dst", "freq"]
    assert key(run(spark, dfg_stream(stream), tmp_path, "df2", "complete"), cols) == key(discovery.dfg(batch), cols)
    cols = ["n", "src", "dst", "freq"]
    assert key(run(spark, heuristics_budget_stream(stream, 10, 8), tmp_path, "df3"), cols) == key(discovery.heuristics_budget_ticks(batch, 10, 8), cols)
    model = discovery.behavioral_model(batch.where("n <= 20"))
    cols = ["n", "case_id", *(F.round(c, 9).alias(c) for c in ("conformance", "confidence", "completeness"))]
    assert key(run(spark, behavioral_conformance_stream(stream, model), tmp_path, "df4"), cols) == key(conformance.behavioral_conformance(batch, model), cols)
    edges = discovery.dfg(batch.where("n <= 30"))
    pdfa = edges.select("src", "dst", (F.col("freq") / 100).alias("prob"))
    cols = ["n", "case_id", *(F.round(c, 9).alias(c) for c in ("mean_prob", "soft_conformance"))]
    assert key(run(spark, soft_conformance_stream(stream, pdfa), tmp_path, "df5"), cols) == key(conformance.soft_conformance(batch, pdfa), cols)
