"""Object-centric operators: flattening, per-type miners, inclusion strategies, merged models."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.cardinality import infer_cardinality
from ..functions.lossy import at_ticks, lossy_states
from ..functions.running import as_of, running
from ..functions.spans import merged_spans, overlaps
from ..order import last_index, numbered_within, with_index
from ..workspace import Passing, written
from .discovery import heuristics_lossy_ticks, start_end_activities

#: The discriminators and commands of the message tables.
DFG, AER, COMMAND = "dfg", "aer", "command"
ACTIVE, INACTIVE = "ACTIVE", "INACTIVE"


def flatten(df: DataFrame) -> DataFrame:
    """(n, flat_pos, object_type, case_id, activity, ts): one event for each object, in the order of
    types and ids."""
    types = F.sort_array(F.map_keys("omap"))
    ids = lambda t: F.sort_array(F.array_distinct(F.coalesce(F.element_at("omap", t), F.array().cast("array<string>"))))
    each = F.transform(types, lambda t: F.transform(ids(t), lambda i: F.struct(t.alias("object_type"), i.alias("case_id"))))
    rows = df.select("n", "activity", "ts", F.posexplode(F.flatten(each)).alias("flat_pos", "o"))
    return rows.select("n", "activity", "ts", "o.object_type", "o.case_id", (F.col("flat_pos") + 1).alias("flat_pos"))


def oc_dfg(flat: DataFrame) -> DataFrame:
    """(object_type, src, dst, freq) over the whole flattened log."""
    w = Window.partitionBy("object_type", "case_id").orderBy("n")
    rows = flat.select("object_type", F.lag("activity").over(w).alias("src"), F.col("activity").alias("dst"))
    return rows.where("src IS NOT NULL").groupBy("object_type", "src", "dst").agg(F.count("*").alias("freq"))


def per_type_index(flat: DataFrame) -> DataFrame:
    """flat with ``n`` = the event's number within its object type, and ``event_n``, the log's own.

    A log read in its order is numbered without a shuffle, see ``numbered_within``; a type that holds most
    events is spread like any other."""
    return numbered_within(flat.withColumnRenamed("n", "event_n"), "object_type", "event_n", "flat_pos")


def _flat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``flatten``, with ``event_n``, of events (n, activity, omap)."""
    for batch in batches:
        n, activity, omap = batch.columns
        if omap.null_count:
            batch = batch.filter(omap.is_valid())
            n, activity, omap = batch.columns
        entries = np.diff(omap.offsets.to_numpy())
        first, last = omap.offsets[0].as_py(), omap.offsets[-1].as_py()
        keys, lists = omap.keys[first:last].dictionary_encode(), omap.items[first:last]
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ids = lists.flatten()
        if not len(ids):
            continue
        names = keys.dictionary.to_pylist()
        place = np.empty(len(names), np.int64)
        place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        entry = np.repeat(np.arange(len(sizes)), sizes)
        event = np.repeat(np.arange(len(entries)), entries)[entry]
        code = keys.indices.to_numpy().astype(np.int64)[entry]
        joint = event * len(names) + place[code]
        # Ids usually come sorted and once; where they do not, they are ranked.
        rising = pc.less(ids[:-1], ids[1:]).fill_null(False).to_numpy(zero_copy_only=False)
        if not (rising | (np.diff(entry) > 0)).all():
            told = ids.dictionary_encode()
            texts = told.dictionary.to_pylist()
            rank = np.empty(len(texts) + 1, np.int64)
            rank[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
            rank[-1] = -1
            rank = rank[told.indices.fill_null(len(texts)).to_numpy(zero_copy_only=False)]
            by = np.lexsort((rank, joint))
            by = by[(np.diff(joint[by], prepend=-1) > 0) | (np.diff(rank[by], prepend=-2) != 0)]
        else:
            by = np.argsort(joint, kind="stable") if (np.diff(joint) < 0).any() else np.arange(len(joint))
        event = event[by]
        heads = np.flatnonzero(np.diff(event, prepend=-1))
        pos = np.arange(1, len(by) + 1) - np.repeat(heads, np.diff(heads, append=len(by)))
        types = keys.dictionary.take(pa.array(code[by]))
        columns = [n.take(pa.array(event)), activity.take(pa.array(event)), types, ids.take(pa.array(by)), pa.array(pos.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["event_n", "activity", "object_type", "case_id", "flat_pos"])


def flat_index(df: DataFrame) -> DataFrame:
    """``per_type_index`` of ``flatten`` without ts, in one pass over the events: (event_n, activity, object_type, case_id, flat_pos, n)."""
    schema = StructType.fromDDL("event_n long, activity string, object_type string, case_id string, flat_pos int")
    return numbered_within(df.select(F.col("n").cast("long"), "activity", "omap"), "object_type", "event_n", "flat_pos", made=(_flat_batches, schema))


def _sizes(control_flow: list[str] | None = None) -> Column:
    """The types of an event in their order, and how many objects each has."""
    sizes = F.transform(F.map_entries("omap"), lambda e: F.struct(e["key"].alias("t"), F.size(e["value"]).alias("c")))
    if control_flow:
        sizes = F.filter(sizes, lambda e: e["t"].isin(list(control_flow)))
    return F.sort_array(sizes)


def _told(sizes: Column) -> Column:
    """(type_a, type_b, cardinality) of every pair of types."""
    pairs = F.flatten(
        F.transform(
            sizes, lambda x, i: F.transform(F.slice(sizes, i + 2, F.greatest(F.size(sizes) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("x"), y.alias("y")))
        )
    )
    return F.transform(
        pairs,
        lambda p: F.struct(p["x"]["t"].alias("type_a"), p["y"]["t"].alias("type_b"), infer_cardinality(p["x"]["c"], p["y"]["c"]).alias("cardinality")),
    )


def type_pairs(df: DataFrame, control_flow: list[str] | None = None, spread: bool = True) -> DataFrame:
    """(n, activity, type_a, type_b, cardinality) of every pair of object types of every event, or, not
    ``spread``, (n, activity, pairs): a row for each event."""
    told = _told(_sizes(control_flow))
    if not spread:
        return df.select("n", "activity", told.alias("pairs"))
    return df.select("n", "activity", F.inline(told))


def shapes(df: DataFrame, *keep: str) -> DataFrame:
    """(n, activity, shape, keep): an event's types as they come, each with 1 or 2 for one or many objects. Logs have
    few shapes, so events are counted by them; ``shape_pairs`` gives the pairs of what is counted."""
    many = F.transform(F.map_values("omap"), lambda ids: F.least(F.size(ids), F.lit(2)))
    return df.select("n", "activity", F.struct(F.map_keys("omap").alias("t"), many.alias("c")).alias("shape"), *keep)


def shape_pairs(rows: DataFrame, control_flow: list[str] | None = None) -> DataFrame:
    """rows with type_a, type_b and cardinality in place of ``shape``: a row for every pair of types. Events that
    list their types in another order are rows of their own."""
    sizes = F.arrays_zip(F.col("shape.t").alias("t"), F.col("shape.c").alias("c"))
    if control_flow:
        sizes = F.filter(sizes, lambda e: e["t"].isin(list(control_flow)))
    return rows.select(*(c for c in rows.columns if c != "shape"), F.inline(_told(F.sort_array(sizes))))


def cardinalities(pairs: DataFrame) -> DataFrame:
    """(activity, type_a, type_b, cardinality, freq): the most frequent cardinality of every pair; of
    equally frequent ones the one seen first."""
    counts = pairs.groupBy("activity", "type_a", "type_b", "cardinality").agg(F.count("*").alias("freq"), F.min("n").alias("n"))
    best = F.max(F.struct("freq", (-F.col("n")).alias("n"), "cardinality"))
    rows = counts.groupBy("activity", "type_a", "type_b").agg(best.alias("m"))
    return rows.select("activity", "type_a", "type_b", "m.cardinality", "m.freq")


def aer_lossy_ticks(
    df: DataFrame, model_update_frequency: int = 10, max_approx_error: float = 0.01, control_flow: list[str] | None = None
) -> DataFrame:
    """(n, activity, type_a, type_b, cardinality) after every event n with (n + 1) divisible by
    ``model_update_frequency``: lossy counts for each activity, pair and cardinality, in buckets of an
    activity's own events. A pair whose counts are all forgotten is left out."""
    if not 0 < max_approx_error <= 1:
        raise ValueError("max_approx_error must lie in (0, 1]")
    width, f = int(1 / max_approx_error), model_update_frequency
    last = (last_index(df) + 1) // f
    own = numbered_within(shapes(df), "activity", "n", name="d")
    rows = own.groupBy("activity", "shape", F.ceil(F.col("d") / width).alias("b"), F.ceil((F.col("n") + 1) / f).alias("slot"))
    rows = written(rows.agg(F.count("*").alias("cnt"), F.min("n").alias("n"), F.max("d").alias("d")), "shapes", lean=True)
    states = at_ticks(lossy_states(shape_pairs(rows.drop("d"), control_flow), ["activity", "type_a", "type_b", "cardinality"], strict=True), last)
    seen = rows.groupBy("activity", "slot").agg(F.max("d").alias("d"))
    seen = at_ticks(running(seen, ["activity"], "slot", next_slot=("lead", "slot")), last).select("activity", "tick", "d")
    alive = states.join(seen, ["activity", "tick"]).where(F.col("d") < F.lit(width) * F.greatest("b", "reach"))
    best = F.max(F.struct("freq", (-F.col("born")).alias("n"), "cardinality"))
    rows = alive.groupBy("tick", "activity", "type_a", "type_b").agg(best.alias("m"))
    return rows.select((F.col("tick") * f - 1).alias("n"), "activity", "type_a", "type_b", "m.cardinality")


def create_command(messages: DataFrame, object_type: str | Column, command: str) -> DataFrame:
    """(msg, object_type, command) for every row of messages: the type becomes ACTIVE or INACTIVE there."""
    if command not in (ACTIVE, INACTIVE):
        raise ValueError(f"a command is {ACTIVE} or {INACTIVE}")
    of = F.lit(object_type) if isinstance(object_type, str) else object_type
    return messages.select("msg", of.alias("object_type"), F.lit(command).alias("command"))


def get_mode(control_flow: dict[str, Callable] | list[str] | None = None) -> str:
    """``static`` where the types with miners are given, ``dynamic`` where none is and they come with the events."""
    if control_flow is not None and not isinstance(control_flow, (dict, list)):
        raise TypeError("control_flow is a dict of miners or a list of types")
    if isinstance(control_flow, dict) and not all(map(callable, control_flow.values())):
        raise ValueError("miners must be callable")
    return "static" if control_flow else "dynamic"


def mined_types(
    indexed: DataFrame,
    control_flow: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    default_miner: Callable[[DataFrame], DataFrame] | None = None,
    told_at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(messages, models) of miners of one's own: each gets the flattened events of its type, numbered
    from 1 in ``n``, and returns models (n, src, dst, freq) by the event they follow.

    With ``control_flow`` only the types it names are mined. Without it (or with an empty one) the types are
    those met in the events, and ``default_miner`` mines each; where that is not given either, lossy
    heuristics with 20 events to a model. ``told_at``, a condition on ``n``, says after which events the miners
    may give models, so that only these are looked up; a model elsewhere is a ValueError."""
    get_mode(control_flow)
    if control_flow:
        miners = dict(control_flow)
    elif default_miner is None:
        miners = None
    else:
        miners = {r[0]: default_miner for r in indexed.select("object_type").distinct().orderBy("object_type").collect()}  # one row a type
    if miners is None:
        miners = {None: lambda events: heuristics_lossy_ticks(events, 20, group=["object_type"])}
    none = indexed.where("false").select("object_type", "n", F.lit("").alias("src"), F.lit("").alias("dst"), F.lit(0).cast("long").alias("freq"))
    parts = [none]
    for name, miner in miners.items():
        with Passing() as stage:
            if name is None:
                own = miner(indexed)
            else:
                own = miner(indexed.where(F.col("object_type") == name).drop("object_type")).withColumn("object_type", F.lit(name))
            parts.append(stage.keep(own.select("object_type", "n", "src", "dst", "freq"), "models"))
    models = reduce(DataFrame.unionByName, parts)
    heard = indexed.select("object_type", "n", "event_n", "flat_pos")
    if told_at is not None:
        if not models.where(~told_at).isEmpty():
            raise ValueError("a miner gave models after other events than told_at says")
        heard = heard.where(told_at)
    told = written(models.select("object_type", "n").distinct().join(heard, ["object_type", "n"]), "told", lean=True)
    return with_index(told.select("event_n", "flat_pos", "object_type", F.col("n").alias("type_n")), "event_n", "flat_pos", name="msg", lean=True), models


def dfg_messages(indexed: DataFrame, model_update_frequency: int = 20, control_flow: list[str] | None = None) -> DataFrame:
    """(msg, event_n, flat_pos, object_type, type_n): the messages of the lossy miners, one for each type,
    numbered in the order they come. With ``control_flow`` only its types have miners; miners of one's
    own go to ``mined_types``."""
    get_mode(control_flow)
    if isinstance(control_flow, dict):
        raise TypeError("a dict of miners goes to mined_types")
    rows = indexed.where((F.col("n") + 1) % model_update_frequency == 0)
    if control_flow:
        rows = rows.where(F.col("object_type").isin(list(control_flow)))
    rows = rows.select("event_n", "flat_pos", "object_type", F.col("n").alias("type_n"))
    return with_index(rows, "event_n", "flat_pos", name="msg")


def relative_frequency(messages: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(msg, object_type, command): a type is active while its share of the messages so far is at least
    the threshold. A share only falls between a type's messages, so the message it falls below at
    follows from its count."""
    last = last_index(messages, "msg")
    rows = messages.select("msg", "object_type")
    rows = running(rows, ["object_type"], "msg", c=("sum", F.lit(1)), before=("lag", "msg"), next=("lead", "msg")).na.fill(last + 1, ["next"])
    at = F.floor(F.col("c") / threshold).cast("long")
    near = F.sequence(F.greatest(at - 1, F.col("c")), F.greatest(at, F.col("c")) + 2)
    off = F.array_min(F.filter(near, lambda m: F.col("c") / m < threshold))
    on = F.col("c") / F.col("msg") >= threshold
    was = F.col("before").isNotNull() & ((F.col("c") - 1) / (F.col("msg") - 1) >= threshold)
    starts = rows.where(on & ~was).select("msg", "object_type", F.lit(ACTIVE).alias("command"))
    stops = rows.where(on).select(F.greatest(off, F.col("msg")).alias("msg"), "object_type", F.lit(INACTIVE).alias("command"), "next")
    return starts.unionByName(stops.where("msg < next").drop("next"))


def sliding_window_inclusion(messages: DataFrame, window_size: int = 30) -> DataFrame:
    """(msg, object_type, command): a type is active for ``window_size`` messages from each of its own."""
    last = last_index(messages, "msg")
    rows = running(messages.select("msg", "object_type"), ["object_type"], "msg", before=("lag", "msg"), next=("lead", "msg"))
    rows = rows.na.fill(last + 1, ["next"])
    starts = rows.where(f"before IS NULL OR msg - before > {window_size}")
    stops = rows.withColumn("msg", F.col("msg") + window_size).where("msg < next")
    return starts.select("msg", "object_type", F.lit(ACTIVE).alias("command")).unionByName(
        stops.select("msg", "object_type", F.lit(INACTIVE).alias("command"))
    )


def lossy_inclusion(messages: DataFrame, max_approx_error: float = 0.05) -> DataFrame:
    """(msg, object_type, command): a type is active while lossy counting of the messages holds it."""
    width = math.ceil(1 / max_approx_error)
    last = last_index(messages, "msg")
    rows = messages.select("object_type", F.col("msg").alias("n"), F.ceil(F.col("msg") / width).alias("b"), F.col("msg").alias("slot"))
    states = lossy_states(rows, ["object_type"])
    dead = F.lit(width) * F.greatest("b", "reach")
    starts = states.where("new").select(F.col("slot").alias("msg"), "object_type", F.lit(ACTIVE).alias("command"))
    stops = states.withColumn("msg", dead.cast("long")).where(F.col("msg") < F.coalesce("next_slot", F.lit(last + 1)))
    return starts.unionByName(stops.select("msg", "object_type", F.lit(INACTIVE).alias("command")))


def _spans(df: DataFrame, keys: list[str], last: int) -> DataFrame:
    """Rows of a change table as spans ``from`` to ``to``, the message before the key's next change."""
    rows = running(df, keys, "msg", next=("lead", "msg")).na.fill(last + 1, ["next"])
    return rows.withColumn("from", F.col("msg")).withColumn("to", F.col("next") - 1).drop("msg", "next")


def active_spans(commands: DataFrame, last: int) -> DataFrame:
    """(object_type, from, to): the stretches of messages in which a type is active. Where a type is
    switched on and off by one message, off is the later."""
    rows = commands.groupBy("object_type", "msg").agg(F.max(F.when(F.col("command") == INACTIVE, 1).otherwise(0)).alias("off"))
    return _spans(rows, ["object_type"], last).where("off = 0").drop("off")


def merged_ocdfg(messages: DataFrame, models: DataFrame, commands: DataFrame) -> DataFrame:
    """(from, to, object_type, src, dst, freq): from each message to another the newest model of each
    active type.

    Models and commands are put in one order for each type and handed on, so every row stands for a
    stretch without a change; nothing grows with the number of messages between changes. ``spelled_out``
    gives a row for each message."""
    last = last_index(messages, "msg")
    off = F.max(F.when(F.col("command") == INACTIVE, 1).otherwise(0))
    messages = written(messages.select("msg", "object_type", "type_n"), "messages", lean=True)
    switched = commands.groupBy("object_type", "msg").agg((off == 0).alias("on"))
    told = messages.select("object_type", "msg", "type_n")
    rows = running(told.join(switched, ["object_type", "msg"], "full"), ["object_type"], "msg", type_n=("last", "type_n"), on=("last", "on"))
    rows = _spans(rows, ["object_type"], last).where("on AND type_n IS NOT NULL")
    found = rows.join(models.select("object_type", F.col("n").alias("type_n"), "src", "dst", "freq"), ["object_type", "type_n"])
    return found.select("from", "to", "object_type", "src", "dst", "freq")


def spelled_out(spans: DataFrame) -> DataFrame:
    """A row with ``msg`` for each message of every span; as many rows as messages, so for small results."""
    return spans.withColumn("msg", F.explode(F.sequence("from", "to"))).drop("from", "to")


def oc_miner(df: DataFrame, model_update_frequency: int = 20, max_approx_error: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(messages, models) of lossy heuristics miners, one for each object type."""
    indexed = per_type_index(flatten(df))
    messages = dfg_messages(indexed, model_update_frequency)
    return messages, heuristics_lossy_ticks(indexed, model_update_frequency, max_approx_error, ["object_type"])


def oc_stream(
    df: DataFrame, messages: DataFrame, inclusion: Callable[[DataFrame], DataFrame] = relative_frequency, aer_model_update_frequency: int = 30
) -> DataFrame:
    """(pos, type, event_n, object_type, type_n, command): all messages of an object-centric run as one
    stream. Of one event the AER message comes first, then its objects' models in flat order, each
    behind the commands that it gives rise to (by type). ``inclusion`` makes (msg, object_type, command)
    of the messages; any function of that shape will do."""
    commands = inclusion(messages).join(messages.select("msg", "event_n", "flat_pos"), "msg")
    none = lambda kind: F.lit(None).cast(kind)
    told = messages.select("event_n", "flat_pos", F.lit(2).alias("k"), F.lit(DFG).alias("type"), "object_type", "type_n", none("string").alias("command"))
    told = told.unionByName(
        commands.select("event_n", "flat_pos", F.lit(1).alias("k"), F.lit(COMMAND).alias("type"), "object_type", none("long").alias("type_n"), "command")
    )
    ticks = df.where((F.col("n") + 1) % aer_model_update_frequency == 0).select(
        F.col("n").alias("event_n"), F.lit(0).alias("flat_pos"), F.lit(0).alias("k"), F.lit(AER).alias("type"),
        none("string").alias("object_type"), none("long").alias("type_n"), none("string").alias("command"),
    )
    rows = with_index(told.unionByName(ticks), "event_n", "flat_pos", "k", "object_type", "command", name="pos")
    return rows.select("pos", "type", "event_n", "object_type", "type_n", "command")


def merged_aer(messages: DataFrame, edges: DataFrame, aer: DataFrame, commands: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """(from, to, activity, type_a, type_b, cardinality): from each message to another the newest AER
    model (n, ...), without activities that are not in the merged graph ``edges`` (spans) there and
    without types that are not active.

    ``aer`` may come in any rhythm: ``ticks`` (n) tells the events it was told after, the empty models
    too (without it, those with rows). Each message takes the newest tick before it as-of, the runs of
    messages with one tick are spans, and spans are joined where they overlap."""
    last = last_index(messages, "msg")
    aer, edges = written(aer, "aer", lean=True), written(edges.select("from", "to", F.array("src", "dst").alias("ends")).distinct(), "edges", lean=True)
    ticks = (aer if ticks is None else ticks).select(F.col("n").alias("event_n"), F.col("n")).distinct()
    newest = as_of(messages.select("msg", "event_n"), ticks, "event_n", tick="n").where("tick IS NOT NULL")
    told = newest.groupBy("tick").agg(F.min("msg").alias("from"), F.max("msg").alias("to"))
    rows = told.join(aer, F.col("tick") == F.col("n")).drop("tick", "n")
    on = written(active_spans(commands, last), "active")
    for side in ("type_a", "type_b"):
        rows = overlaps(written(rows, "spans", lean=True), on.withColumnRenamed("object_type", side), [side], last)
    nodes = edges.select("from", "to", F.explode("ends").alias("activity")).distinct()
    rows = overlaps(written(rows, "spans", lean=True), written(merged_spans(nodes, ["activity"]), "nodes", lean=True), ["activity"], last)
    return rows.select("from", "to", "activity", "type_a", "type_b", "cardinality")


def prune_aer(aer: DataFrame, ocdfg: DataFrame) -> DataFrame:
    """The rows of an AER (activity, type_a, type_b, ...) whose activity and both types are in the graph."""
    types = ocdfg.select("object_type").distinct()
    nodes = ocdfg.select(F.col("src").alias("activity")).union(ocdfg.select("dst")).distinct()
    both = aer.join(types.withColumnRenamed("object_type", "type_a"), "type_a", "left_semi")
    both = both.join(types.withColumnRenamed("object_type", "type_b"), "type_b", "left_semi")
    return both.join(nodes, "activity", "left_semi")


def type_ends(ocdfg: DataFrame, object_type: str) -> DataFrame:
    """Start and end activities of one type of a merged graph."""
    return start_end_activities(ocdfg.where(F.col("object_type") == object_type).select("src", "dst"))


def merged_ends(ocdfg: DataFrame) -> DataFrame:
    """(from, to, object_type, activity, is_start, is_end) of every merged graph. A type's spans do not
    overlap, so each is one graph."""
    return start_end_activities(ocdfg, by=("from", "to", "object_type"))


def edge_similarity(first: DataFrame, second: DataFrame) -> float:
    """Jaccard similarity of two edge sets (src, dst); 1.0 if both are empty."""
    both = first.select("src", "dst", F.lit(1).alias("x")).union(second.select("src", "dst", F.lit(2))).distinct()
    n, shared = both.groupBy("src", "dst").count().agg(F.count("*"), F.sum((F.col("count") == 2).cast("int"))).first()
    return (shared or 0) / n if n else 1.0
