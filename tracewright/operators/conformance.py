"""Conformance: behavioural, soft (probabilistic automaton) and temporal."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .discovery import directly_follows


def behavioral_conformance(df: DataFrame, model: DataFrame) -> DataFrame:
    """(n, case_id, conformance, confidence, completeness) of every event but the first of each case.

    The model (src, dst, p_min, p_max, f) has a row for each relation, and meets the log in a join on
    these; everything else is running counts within cases."""
    most = model.agg(F.max("f")).first()[0] or 0
    model = model.dropDuplicates(["src", "dst"]).withColumn("known", F.lit(True))
    rows = directly_follows(df).select("n", "case_id", "src", "dst").join(model, ["src", "dst"], "left")
    w = Window.partitionBy("case_id").orderBy("n")
    same = Window.partitionBy("case_id", "src", "dst").orderBy("n")
    rows = rows.withColumn("fresh", F.row_number().over(same) == 1)
    obs = F.sum(F.when(F.col("known") & F.col("fresh"), 1).otherwise(0)).over(w)
    wrong = F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).over(w)
    rows = rows.withColumn("obs", obs).withColumn("wrong", wrong)
    within = F.col("obs").between(F.col("p_min"), F.col("p_max"))
    reached = F.least(F.lit(1.0), F.col("obs") / (F.col("p_min") + 1))
    part = F.when(within, 1.0).otherwise(F.coalesce(reached, F.lit(0.0)))
    sure = 1 - F.coalesce(F.col("f"), F.lit(most)) / F.lit(float(most)) if most else F.lit(1.0)
    return rows.select(
        "n", "case_id", (F.col("obs") / (F.col("obs") + F.col("wrong"))).alias("conformance"),
        F.when(F.col("known"), sure).otherwise(-1.0).alias("confidence"),
        F.when(F.col("known"), part).otherwise(-1.0).alias("completeness"),
    )


def normalize_weights(pdfa: DataFrame, alpha: float) -> DataFrame:
    """(src, dst, prob) for every pair of the automaton's nodes: alpha of the own weight, the rest spread
    evenly. The pairs are those of one small model, made from an array of its nodes."""
    both = pdfa.select("src").union(pdfa.select("dst")).distinct()
    nodes = sorted(r[0] for r in both.collect())
    grid = both.select("src", F.explode(F.array(*map(F.lit, nodes))).alias("dst")) if nodes else pdfa.select("src", "dst")
    joined = grid.join(pdfa, ["src", "dst"], "left")
    even = (1 - alpha) / max(1, len(nodes))
    return joined.select("src", "dst", (F.coalesce("prob", F.lit(0.0)) * alpha + even).alias("prob"))


def node_count(pdfa: DataFrame) -> int:
    return pdfa.select("src").union(pdfa.select("dst")).distinct().count()


def case_restarts(df: DataFrame, max_cases: int, stretch: int | None = None) -> DataFrame:
    """df with ``life``, which grows when a case comes back after ``max_cases`` or more distinct other
    cases: a table of that many cases, least recently used out, has forgotten it.

    The log is cut into stretches of ``stretch`` events (50 times ``max_cases``), each gone through once
    with such a table. What the table holds at first are the last cases before it: an event that is
    the last of its case in its stretch is handed to the later ones up to the case's next event, or up
    to a stretch with ``max_cases`` cases of its own. So the work grows with the events, not with the
    gaps between them."""
    w = Window.partitionBy("case_id").orderBy("n")
    if df.select("case_id").distinct().count() <= max_cases:
        return df.withColumn("life", F.lit(0).cast("long"))
    size = stretch or 50 * max(1, max_cases)
    own = df.select("n", "case_id", F.floor((F.col("n") - 1) / size).alias("at"))
    lasts = own.groupBy("at", "case_id").agg(F.max("n").alias("n"))
    lasts = lasts.withColumn("newer", F.row_number().over(Window.partitionBy("at").orderBy(F.col("n").desc())))
    lasts = lasts.withColumn("again", F.lead("at").over(Window.partitionBy("case_id").orderBy("at"))).where(F.col("newer") <= max_cases)
    # One row for each stretch: the next one that fills a table by itself.
    full = own.groupBy("at").agg(F.countDistinct("case_id").alias("cases"))
    later = Window.orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    ends = full.select("at", F.min(F.when(F.col("cases") >= max_cases, F.col("at"))).over(later).alias("full"), F.max("at").over(later).alias("last"))
    given = lasts.join(ends, "at").where("last IS NOT NULL").withColumn("to", F.least("again", "full", "last"))
    given = given.select("n", "case_id", F.explode(F.sequence(F.col("at") + 1, "to")).alias("at"), F.lit(True).alias("before"))
    case_type = df.schema["case_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table: OrderedDict = OrderedDict()
        gone = []
        for n, case, before in pdf.sort_values("n")[["n", "case_id", "before"]].itertuples(index=False):
            if case in table:
                table.move_to_end(case)
            else:
                table[case] = None
                if len(table) > max_cases:
                    table.popitem(last=False)
                if not before:
                    gone.append((n, case))
        return pd.DataFrame(gone, columns=["n", "case_id"])

    rows = own.withColumn("before", F.lit(False)).unionByName(given)
    fresh = rows.groupBy("at").applyInPandas(run, f"n long, case_id {case_type}").withColumn("__new", F.lit(1))
    joined = df.join(fresh.select("n", "__new"), "n", "left")
    return joined.withColumn("life", F.sum(F.coalesce("__new", F.lit(0))).over(w)).drop("__new")


def soft_conformance(df: DataFrame, pdfa: DataFrame, alpha: float = 0.5, max_cases: int = 1000) -> DataFrame:
    """(n, case_id, last_prob, log_prob, mean_prob, soft_conformance) after each event: running measures
    of the case under the normalised automaton. The first event of a case (or of its return after it
    was forgotten) gives mean 0 and log_prob 1."""
    size = node_count(pdfa)
    weights = normalize_weights(pdfa, alpha)
    rows = case_restarts(df, max_cases)
    w = Window.partitionBy("case_id", "life").orderBy("n")
    rows = rows.select("n", "case_id", "life", "activity", F.lag("activity").over(w).alias("src"), F.row_number().over(w).alias("k"))
    rows = rows.join(weights.withColumnRenamed("dst", "activity"), ["src", "activity"], "left")
    p = F.when(F.col("k") > 1, F.coalesce("prob", F.lit(0.0)))
    rows = rows.withColumn("last_prob", p)
    surprise = F.when(F.col("last_prob") > 0, -F.log("last_prob")).when(F.col("last_prob") == 0, F.lit(float("inf")))
    mean = F.coalesce(F.avg("last_prob").over(w), F.lit(0.0))
    scale = alpha + (1 - alpha) / max(1, size)
    return rows.select(
        "n", "case_id", "last_prob", (1.0 + F.coalesce(F.sum(surprise).over(w), F.lit(0.0))).alias("log_prob"),
        mean.alias("mean_prob"), (mean / scale).alias("soft_conformance"),
    )


def soft_reports(df: DataFrame, pdfa: DataFrame, alpha: float = 0.5, max_cases: int = 1000, rate: int = 10) -> DataFrame:
    """(tick, case_id, mean_prob, soft_conformance): every ``rate`` events, the state of all cases then
    stored. A case stands from each of its events up to its next, or until it is forgotten."""
    from ..order import last_index

    last = last_index(df)
    rows = soft_conformance(df, pdfa, alpha, max_cases)
    w = Window.partitionBy("case_id").orderBy("n")
    rows = rows.withColumn("slot", F.ceil(F.col("n") / rate)).withColumn("until", F.coalesce(F.lead("n").over(w), F.lit(last + 1)))
    rows = rows.withColumn("end", F.floor((F.col("until") - 1) / rate)).where("slot <= end")
    ticks = rows.withColumn("tick", F.explode(F.sequence("slot", "end"))).withColumn("tick", F.col("tick") * rate)
    newest = Window.partitionBy("tick").orderBy(F.col("n").desc())
    return ticks.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= max_cases).select(
        "tick", "case_id", "mean_prob", "soft_conformance"
    )


def temporal_conformance(df: DataFrame, profile: DataFrame, zeta: float = 6.0) -> DataFrame:
    """(n, case_id, a, b, delta_s, z): pairs of events of a case whose distance in time lies more than
    ``zeta`` standard deviations from the profile's mean; n is the later event.

    The profile joins the later events first and turns into bounds on the earlier ones' times, so only
    deviating pairs leave the join within a case."""
    own = df.select("case_id", "n", "activity", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    late = own.select("case_id", F.col("n").alias("late"), F.col("activity").alias("b"), F.col("t").alias("u")).join(profile, "b")
    late = late.withColumn("low", F.col("mean_s") - zeta * F.col("std_s")).withColumn("high", F.col("mean_s") + zeta * F.col("std_s"))
    early = own.withColumnRenamed("activity", "a")
    pairs = late.join(early, ["case_id", "a"]).where("n < late AND ((u - t) / 1e6 < low OR (u - t) / 1e6 > high)")
    delta = (F.col("u") - F.col("t")) / 1e6
    z = F.when(F.col("std_s") > 0, F.abs(delta - F.col("mean_s")) / F.col("std_s"))
    return pairs.select(F.col("late").alias("n"), "case_id", "a", "b", delta.alias("delta_s"), z.alias("z"))
