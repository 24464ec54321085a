"""Models as text: Graphviz DOT and one line for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def colour(i: int) -> str:
    """The i-th colour as DOT's hue, saturation, value: hues step by the golden ratio, so any number of
    them stay apart and an index keeps its colour."""
    return f"{(0.58 + i * 0.6180339887) % 1:.3f} {(0.75, 0.45)[i % 2]} {(0.7, 0.85)[i // 2 % 2]}"


def _escaped(name: str) -> str:
    return str(name).replace("\\", "\\\\").replace('"', '\\"')


def _quoted(name: str):
    return F.concat(F.lit('"'), F.regexp_replace(F.col(name), '(["\\\\])', "\\\\$1"), F.lit('"'))


def dfg_lines(edges: DataFrame) -> DataFrame:
    """(src, dst, line): one DOT edge each, its width 5 times the weight between 0.5 and 5."""
    width = F.greatest(F.lit(0.5), F.least(F.lit(5.0), 5 * F.col("weight")))
    line = F.concat(
        _quoted("src"), F.lit(" -> "), _quoted("dst"), F.lit(" [penwidth="), F.format_number(width, 2), F.lit(', label="'),
        F.format_number("weight", 2), F.lit('"];'),
    )
    return edges.select("src", "dst", line.alias("line"))


def dfg_to_dot(edges: DataFrame) -> str:
    """One model (src, dst, weight) as a DOT graph with artificial start and end nodes."""
    from ..operators.discovery import start_end_activities

    lines = [r.line for r in dfg_lines(edges).orderBy("src", "dst").collect()]
    for r in start_end_activities(edges, loops_count=True).orderBy("activity").collect():
        name = _escaped(r.activity)
        lines += [f'"__start__" -> "{name}" [style=dashed];'] * r.is_start + [f'"{name}" -> "__end__" [style=dashed];'] * r.is_end
    return "digraph {\n" + "\n".join(lines) + "\n}\n"


def ocdfg_to_dot(edges: DataFrame) -> str:
    """A merged object-centric graph (object_type, src, dst, freq): parallel edges, a colour a type."""
    rows = edges.orderBy("object_type", "src", "dst").collect()
    types = sorted({r.object_type for r in rows})
    colours = {t: colour(i) for i, t in enumerate(types)}
    return "digraph {\n" + "".join(
        f'"{_escaped(r.src)}" -> "{_escaped(r.dst)}" [color="{colours[r.object_type]}", label="{_escaped(r.object_type)} {r.freq}"];\n' for r in rows
    ) + "}\n"


def aer_to_dot(aer: DataFrame) -> str:
    """An AER (activity, type_a, type_b, cardinality): a cluster for each activity, its types as boxes of
    the type's colour, its pairs as edges."""
    rows = aer.orderBy("activity", "type_a", "type_b").collect()
    types = sorted({t for r in rows for t in (r.type_a, r.type_b)})
    lines = []
    for i, a in enumerate(dict.fromkeys(r.activity for r in rows)):
        own, name = [r for r in rows if r.activity == a], _escaped(a)
        lines.append(f'subgraph cluster_{i} {{ label="{name}";')
        for t in sorted({t for r in own for t in (r.type_a, r.type_b)}):
            lines.append(f'"{name}/{_escaped(t)}" [shape=box, label="{_escaped(t)}", color="{colour(types.index(t))}"];')
        lines += [f'"{name}/{_escaped(r.type_a)}" -> "{name}/{_escaped(r.type_b)}" [dir=none, label="{r.cardinality}"];' for r in own] + ["}"]
    return "digraph {\n" + "\n".join(lines) + "\n}\n"


def event_text(df: DataFrame, name: str = "text") -> DataFrame:
    """df with every event as one line of JSON."""
    return df.withColumn(name, F.to_json(F.struct(*df.columns)))


def aer_lines(aer: DataFrame) -> DataFrame:
    return aer.select(F.format_string("%s: %s → %s [%s]", "activity", "type_a", "type_b", "cardinality").alias("line"))


def ocdfg_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string("%s --(%s)--> %s [%d]", "src", "object_type", "dst", "freq").alias("line"))


def dotted_chart(df: DataFrame, max_events: int | None = None, window_seconds: float | None = None) -> DataFrame:
    """(n, x, y, activity): seconds since the first shown event, and the place of the case in the order
    of first appearance; only the last events and those of the last seconds are shown."""
    from pyspark.sql import Window

    rows = df
    if max_events is not None:
        rows = rows.orderBy(F.col("n").desc()).limit(max_events)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    if window_seconds is not None:
        newest = rows.agg(F.max(micros)).first()[0]
        rows = rows.where(micros >= (newest or 0) - int(window_seconds * 1e6))
    first = rows.agg(F.min(micros)).first()[0] or 0
    seen = rows.groupBy("case_id").agg(F.min("n").alias("__n"))
    places = seen.select("case_id", (F.row_number().over(Window.orderBy("__n")) - 1).alias("y"))  # the rows of one chart
    return rows.join(places, "case_id").select("n", ((micros - first) / 1e6).alias("x"), "y", "activity")


def heatmap(pairs: DataFrame) -> DataFrame:
    """A square matrix of (src, dst, freq) with rows and columns for all labels."""
    from ..operators.discovery import dfg_matrix

    labels = pairs.select("src").union(pairs.select("dst")).distinct()
    names = sorted(r[0] for r in labels.collect())
    return labels.join(dfg_matrix(pairs, names), "src", "left").na.fill(0)
