"""Event logs from tables, strings, XES and OCEL 2.0 files, templates and topic messages."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..order import with_index

def _none() -> Column:
    return F.create_map().cast("map<string,string>")


def from_table(
    df: DataFrame, case: str, activity: str, ts: str, tie: str | None = None, keep: Iterable[str] = (), process: str = "log-file"
) -> DataFrame:
    """Any table as a log, numbered by time (then ``tie``). Columns in ``keep`` stay columns, so scans
    read them only where they are used."""
    cols = [F.col(case).cast("string").alias("case_id"), F.col(activity).alias("activity"), F.col(ts).alias("ts")]
    own = [c for c in dict.fromkeys([*([tie] if tie else []), *keep]) if c not in ("case_id", "activity", "ts")]
    rows = df.select(*cols, *own, F.lit(process).alias("process"))
    return with_index(rows, "ts", tie) if tie else with_index(rows, "ts", "case_id", "activity")


def string_log(spark: SparkSession, traces: Iterable[str] | DataFrame) -> DataFrame:
    """Each string is a case, each character an event, trace after trace. Traces are given as strings or
    as a table (i, trace), with numbers that order and name the cases."""
    rows = traces if isinstance(traces, DataFrame) else spark.createDataFrame(list(enumerate(traces)), "i long, trace string")
    chars = rows.select("i", F.posexplode(F.split("trace", "")).alias("p", "activity")).where("activity <> ''")
    w = with_index(chars, "i", "p")
    return w.select(
        "n", F.concat(F.lit("case_"), F.col("i") + 1).alias("case_id"), "activity", F.current_timestamp().alias("ts"),
        F.lit("Process").alias("process"), _none().alias("event_attrs"), _none().alias("trace_attrs"),
    )


#: The typed tags of attributes in XES files.
XES_TAGS = ["string", "date", "int", "float", "boolean", "id"]


def _attributes() -> T.StructType:
    entry = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
    return T.StructType([T.StructField(t, entry) for t in XES_TAGS])


def _as_map(at: str) -> Column:
    lists = [F.coalesce(F.col(f"{at}{t}"), F.array().cast(_attributes()[t].dataType)) for t in XES_TAGS]
    entries = F.filter(F.concat(*lists), lambda e: e["_key"].isNotNull() & e["_value"].isNotNull())
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["_key"], e["_value"])))


def xes_log(spark: SparkSession, path: str) -> DataFrame:
    """The events of XES files, in the order of ``time:timestamp`` and then of the file; traces are the
    rows that executors read. Without timestamps the order is the file's and ts is now."""
    event = _attributes()
    trace = T.StructType([*event.fields, T.StructField("event", T.ArrayType(event))])
    rows = spark.read.format("xml").option("rowTag", "trace").schema(trace).load(path)
    rows = rows.select(_as_map("").alias("t"), F.posexplode("event").alias("pos", "e"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("t", "pos", "row", _as_map("e.").alias("a"))
    stamp = F.try_to_timestamp(F.col("a")["time:timestamp"])
    rows = rows.withColumn("time", stamp)
    rows = with_index(rows, F.col("time").asc_nulls_first(), "row", "pos")
    without = lambda m, names: F.map_filter(m, lambda k, _: ~k.isin(names))
    return rows.select(
        "n", F.col("t")["concept:name"].alias("case_id"), F.col("a")["concept:name"].alias("activity"),
        F.coalesce("time", F.current_timestamp()).alias("ts"), F.lit("log-file").alias("process"),
        without(F.col("a"), ["concept:name", "time:timestamp"]).alias("event_attrs"), without(F.col("t"), ["concept:name"]).alias("trace_attrs"),
    )


def ocel2_json_log(spark: SparkSession, path: str) -> DataFrame:
    """The events of OCEL 2.0 JSON files: relationships become ``omap`` by the objects' types."""
    attrs = "array<struct<name: string, value: string>>"
    schema = (
        f"events array<struct<id: string, type: string, time: string, attributes: {attrs}, "
        "relationships: array<struct<objectId: string, qualifier: string>>>>, objects array<struct<id: string, type: string>>"
    )
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    events = raw.select(F.explode("events").alias("e")).select(
        F.col("e.id").alias("event_id"), F.col("e.type").alias("activity"), F.to_timestamp("e.time").alias("ts"),
        F.col("e.attributes").alias("attributes"), F.col("e.relationships.objectId").alias("ids"),
    )
    objects = raw.select(F.explode("objects").alias("o")).select(F.col("o.id").alias("id"), F.col("o.type").alias("t"))
    linked = events.select("event_id", F.explode("ids").alias("id")).join(objects, "id")
    by_type = linked.groupBy("event_id", "t").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    omap = by_type.groupBy("event_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "ids")))).alias("omap"))
    pairs = F.transform(F.coalesce("attributes", F.array().cast(attrs)), lambda a: F.struct(a["name"], a["value"]))
    rows = events.withColumn("vmap", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))
    none = F.create_map().cast("map<string,array<string>>")
    rows = rows.join(omap, "event_id", "left").withColumn("omap", F.coalesce("omap", none))
    return with_index(rows.select("event_id", "activity", "ts", "omap", "vmap"), "ts", "event_id")


def dict_ocel_log(spark: SparkSession, flows: list[tuple[list[dict], int]], shuffle: bool = False, seed: int = 0) -> DataFrame:
    """Templates (lists of {"activity", "objects": {type: [ids]}}) times repetitions. Every trace gets a
    number that its object ids end in; ``shuffle`` reorders whole traces."""
    rows, first = [], 0
    for steps, times in flows:
        for p, s in enumerate(steps):
            rows.append((first, int(times), p, s["activity"], json.dumps({k: list(v) for k, v in s["objects"].items()})))
        first += int(times)
    schema = "first long, times long, p int, activity string, objects string"
    df = spark.createDataFrame(rows, schema).where("times > 0")
    df = df.withColumn("trace", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("times") - 1)))
    omap = F.from_json("objects", "map<string,array<string>>")
    named = F.transform_values(omap, lambda _, v: F.array_distinct(F.transform(v, lambda i: F.concat_ws("_", i, F.col("trace")))))
    key = F.xxhash64(F.lit(seed), "trace") if shuffle else F.col("trace")
    numbered = with_index(df.select("trace", "p", "activity", named.alias("omap"), key.alias("key")), "key", "trace", "p")
    return numbered.select(
        "n", F.concat(F.lit("e"), F.col("n") - 1).alias("event_id"), "activity", F.current_timestamp().alias("ts"), "omap", _none().alias("vmap")
    )


def topic_events(df: DataFrame) -> DataFrame:
    """Messages (topic, payload; batch or streaming) of topics .../process/case/activity with a JSON
    payload, as events. Two levels or fewer have process ``Process``; bad JSON leaves no attributes."""
    parts = F.split("topic", "/")
    return df.withColumn("__t", parts).select(
        F.when(F.size("__t") > 2, F.try_element_at("__t", F.lit(-3))).otherwise("Process").alias("process"),
        F.try_element_at("__t", F.lit(-2)).alias("case_id"), F.try_element_at("__t", F.lit(-1)).alias("activity"),
        F.coalesce(F.from_json("payload", "map<string,string>"), _none()).alias("event_attrs"),
        *[c for c in df.columns if c not in ("topic", "payload")],
    )


def log_source(spark: SparkSession, log) -> DataFrame:
    """A DataFrame or pandas frame with the usual case:concept:name, concept:name and time:timestamp
    columns, a list of string traces (of any length), or the path of an XES file; else an empty log."""
    if isinstance(log, str):
        return xes_log(spark, log)
    if isinstance(log, (list, tuple)):
        return string_log(spark, log)
    if isinstance(log, pd.DataFrame):
        log = spark.createDataFrame(log)
    if not isinstance(log, DataFrame):
        return string_log(spark, []).limit(0)
    own = log.toDF(*[c.replace(":", "_") for c in log.columns])
    names = {"case_concept_name", "concept_name", "time_timestamp"}
    ts = F.col("time_timestamp") if "time_timestamp" in own.columns else F.current_timestamp()
    # Ties keep the order of the table's rows.
    rows = own.select(
        F.col("case_concept_name").cast("string").alias("case_id"), F.col("concept_name").alias("activity"), ts.alias("ts"),
        *[c for c in own.columns if c not in names], F.lit("log-file").alias("process"), F.monotonically_increasing_id().alias("__row"),
    )
    return with_index(rows, "ts", "__row").drop("__row")
