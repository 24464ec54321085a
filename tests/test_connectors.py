"""A stream of one's own, restarted, and a sink that commits whole batches."""

import pytest

from tracewright.sources.custom import event_source, read
from tracewright.sources.sinks import committed, event_sink


def test_source_restarts(spark, tmp_path):
    place = str(tmp_path / "newest")

    def newest():
        with open(place) as f:
            return int(f.read())

    source = event_source("growing_for_test", "n long, activity string", lambda a, b: ((i + 1, "x") for i in range(a, b)), step=4, newest=newest)
    spark.dataSource.register(source)
    for top in (10, 10, 23):
        (tmp_path / "newest").write_text(str(top))
        stream = spark.readStream.format("growing_for_test").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        assert sorted(r.n for r in spark.read.schema("n long").parquet(str(tmp_path / "out")).collect()) == list(range(1, top + 1))
    assert sorted(r.n for r in read(spark, source, stop=7).collect()) == list(range(1, 8))


def test_sink_commits_whole_batches(spark, tmp_path):
    healed = str(tmp_path / "healed")

    def line(row):
        import json
        import os

        if row.n == 37 and not os.path.exists(healed):
            raise ValueError("broken row")
        return json.dumps(row.asDict())

    spark.dataSource.register(event_sink("lines_for_test", line))
    out, rows = str(tmp_path / "out"), [(i, "ab"[i % 2]) for i in range(60)]
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, "n long, activity string").repartition(3).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("n long, activity string").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
        return stream.writeStream.format("lines_for_test").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="broken row"):
        run().awaitTermination(120)
    before = committed(spark, out, "n long, activity string").collect()
    assert len({r.n for r in before}) == len(before) < 60 and not any(r.n == 37 for r in before)
    (tmp_path / "healed").write_text("")
    run().awaitTermination(120)
    got = committed(spark, out, "n long, activity string").collect()
    assert sorted((r.n, r.activity) for r in got) == sorted(rows)


def test_batch_sink(spark, tmp_path):
    spark.dataSource.register(event_sink("whole_for_test"))
    out = str(tmp_path / "out")
    assert committed(spark, out, "n long").collect() == []
    for _ in range(2):
        spark.range(10).withColumnRenamed("id", "n").write.format("whole_for_test").mode("append").option("path", out).save()
    assert sorted(r.n for r in committed(spark, out, "n long").collect()) == sorted([*range(10)] * 2)
