"""Joins of spans: whole numbers ``from`` to ``to``, both included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], last: int) -> DataFrame:
    """Every pair of spans of equal keys that overlap, with the overlap as ``from`` and ``to`` and the other
    columns of both sides. Spans lie in 0..last; the sides share only the keys' names.

    A span of up to 2**k numbers touches at most two bins of that width. The longer span of a pair is
    met in the bins of its own width, in which the shorter one is entered too: so each span is
    entered twice for each width the other side has, 2 * log2(last) rows at most, whatever its length. Both sides are
    read three times; written tables serve best."""
    width = lambda df: df.withColumn("__k", F.ceil(F.log2(F.col("to") - F.col("from") + 1)).cast("int"))
    # One number for each width, 64 at most.
    widths = {id(df): sorted(r[0] for r in width(df).select("__k").distinct().collect()) for df in (left, right)}

    def entered(df: DataFrame, own: bool, side: str, strict: bool = False) -> DataFrame:
        rows = width(df)
        if own:
            rows = rows.withColumn("__w", F.col("__k"))
        else:
            theirs = F.array(*map(F.lit, widths[id(right if df is left else left)])).cast("array<int>")
            rows = rows.withColumn("__w", F.explode(F.filter(theirs, lambda w: w > F.col("__k") if strict else w >= F.col("__k"))))
        rows = rows.withColumn("__bin", F.explode(F.expr("sequence(shiftright(`from`, __w), shiftright(`to`, __w))")))
        return rows.drop("__k").withColumnRenamed("from", f"__from_{side}").withColumnRenamed("to", f"__to_{side}")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.join(b, [*keys, "__w", "__bin"])
        pairs = pairs.withColumn("from", F.greatest("__from_l", "__from_r")).withColumn("to", F.least("__to_l", "__to_r"))
        pairs = pairs.where("`from` <= `to` AND shiftright(`from`, __w) = __bin")
        return pairs.drop("__w", "__bin", "__from_l", "__from_r", "__to_l", "__to_r")

    longer_left = met(entered(left, True, "l"), entered(right, False, "r"))
    longer_right = met(entered(left, False, "l", strict=True), entered(right, True, "r"))
    return longer_left.unionByName(longer_right)


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, from, to): the union of the spans of each key as disjoint spans that do not touch.

    Every span adds one at its start and takes one off behind its end; sums of these changes, running over ranges of
    numbers (see ``running``), tell where a key is covered."""
    change = spans.select(*keys, F.col("from").alias("at"), F.lit(1).alias("d")).unionByName(spans.select(*keys, (F.col("to") + 1).alias("at"), F.lit(-1).alias("d")))
    change = change.groupBy(*keys, "at").agg(F.sum("d").alias("d")).where("d <> 0")
    rows = running(change, keys, "at", depth=("sum", "d"))
    rows = rows.withColumn("begins", F.col("depth") == F.col("d"))
    edges = rows.where("begins OR depth = 0")
    edges = running(edges, keys, "at", next=("lead", "at"))
    return edges.where("depth > 0").select(*keys, F.col("at").alias("from"), (F.col("next") - 1).alias("to"))
