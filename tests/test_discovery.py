"""Golden values, and keyed closed forms against sequential folds on random streams."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.operators import conformance, discovery, objects
from tracewright.sources import dict_ocel_log, string_log


def make(spark, rows):
    return spark.createDataFrame([(i + 1, c, a) for i, (c, a) in enumerate(rows)], "n long, case_id string, activity string")


def lossy_fold(rows, eps, every):
    w, cases, rel, out = math.ceil(1 / eps), {}, {}, set()
    for n, (c, a) in enumerate(rows, 1):
        b = math.ceil(n / w)
        if c in cases:
            last, f, d = cases[c]
            cases[c] = (a, f + 1, d)
            f, d = rel.get((last, a), (0, b - 1))
            rel[last, a] = (f + 1, d)
        else:
            cases[c] = (a, 1, b - 1)
        if n % w == 0:
            cases = {k: v for k, v in cases.items() if v[1] + v[2] > b}
            rel = {k: v for k, v in rel.items() if sum(v) > b}
        if (n + 1) % every == 0:
            out |= {(n, *k, v[0]) for k, v in rel.items()}
    return out


@pytest.mark.parametrize("seed,eps,every", [(1, 0.1, 5), (2, 0.25, 3), (3, 0.5, 4)])
def test_lossy_heuristics(spark, seed, eps, every):
    rng = random.Random(seed)
    rows = [(f"c{int(rng.expovariate(0.15))}", rng.choice("ABCDE")) for _ in range(400)]
    got = discovery.heuristics_lossy_ticks(make(spark, rows).repartition(3), every, eps).collect()
    assert {(r.n, r.src, r.dst, r.freq) for r in got} == lossy_fold(rows, eps, every) and len(got) == len(set(got))


def test_lossy_pruning_golden(spark):
    log = string_log(spark, ["ADCB", *["ABCD"] * 5])
    rows = {(r.n, r.src, r.dst) for r in discovery.heuristics_lossy_ticks(log, 6, 0.05).collect()}
    assert (5, "A", "D") in rows and (23, "A", "D") not in rows and (23, "A", "B") in rows
    rows = {(r.n, r.src, r.dst) for r in discovery.heuristics_budget_ticks(log, 6, 10).collect()}
    assert (6, "A", "D") in rows and (24, "A", "D") not in rows


def test_budget_must_hold_something(spark):
    with pytest.raises(ValueError):
        discovery.heuristics_budget_ticks(make(spark, []), 6, 0)


def test_behavioural_model(spark):
    model = discovery.behavioral_model(string_log(spark, ["ABCD", "ABCD"]))
    assert sorted(map(tuple, model.collect())) == [("A", "B", 0, 0, 2), ("B", "C", 1, 1, 1), ("C", "D", 2, 2, 0)]
    log = make(spark, [("1", a) for a in "ABCD"] + [("2", a) for a in "ABCD"])
    got = discovery.behavioral_model(log)
    seen = make(spark, [(c, a) for c in "12" for a in "BCD"])
    rows = sorted(conformance.behavioral_conformance(seen, got).collect())
    assert [(r.conformance, r.confidence, r.completeness, r.n) for r in rows] == [(1.0, 0.5, 1.0, 2), (1.0, 1.0, 1.0, 3), (1.0, 0.5, 1.0, 5), (1.0, 1.0, 1.0, 6)]


def test_soft_conformance(spark):
    rows = [("0", a) for a in "ABCDE"] + [("1", a) for a in "ABCKE"]
    pdfa = spark.createDataFrame([("A", "A", 0.2), ("A", "B", 0.8), ("B", "C", 1.0)], "src string, dst string, prob double")
    own = make(spark, rows)
    got = {r.n: r for r in conformance.soft_conformance(own, pdfa, 0.5, 100).collect()}
    assert round(got[2].soft_conformance, 4) == 0.85 and round(got[2].mean_prob, 4) == 0.5667
    report = sorted((r.tick, r.case_id, round(r.soft_conformance, 4)) for r in conformance.soft_reports(own, pdfa, 0.5, 100, 2).collect())
    assert report == [
        (2, "0", 0.85), (4, "0", 0.6167), (6, "0", 0.4625), (6, "1", 0.0), (8, "0", 0.4625), (8, "1", 0.925), (10, "0", 0.4625), (10, "1", 0.4625),
    ]


def test_temporal_profile(spark):
    t = datetime(2025, 1, 1)
    rows = [(i + 1, c, a, t + timedelta(seconds=s + 60 * k)) for k, c in enumerate("xy") for i, (a, s) in enumerate([("A", 0), ("B", 5), ("C", 15)])]
    rows = [(i + 1, *r[1:]) for i, r in enumerate(rows)]
    own = spark.createDataFrame(rows, "n long, case_id string, activity string, ts timestamp")
    got = {(r.a, r.b): (r.mean_s, r.std_s) for r in discovery.temporal_profile(own).collect()}
    assert got == {("A", "B"): (5, 0), ("A", "C"): (15, 0), ("B", "C"): (10, 0)}


FLOW = [
    {"activity": a, "objects": {t: ["x"] for t in ts}}
    for a, ts in [("r", ["Customer"]), ("o", ["Customer", "Order"]), ("a", ["Order", "Item"]), ("p", ["Order", "Item", "Shipment"]), ("s", ["Order", "Item", "Shipment"])]
]


def test_object_messages(spark):
    log = dict_ocel_log(spark, [(FLOW, 10)])
    assert log.count() == 50
    messages = objects.dfg_messages(objects.per_type_index(objects.flatten(log)), 10)
    count = {r.object_type: r["count"] for r in messages.groupBy("object_type").count().collect()}
    assert count == {"Customer": 2, "Order": 4, "Item": 3, "Shipment": 2}
    with pytest.raises(TypeError):
        objects.dfg_messages(log, control_flow=False)
    with pytest.raises(ValueError):
        objects.dfg_messages(log, control_flow={"a": 1})


def strategies(kinds, thr, width, eps):
    count, last, lossy, on = {}, {}, {}, [set(), set(), set()]
    out, w = [set(), set(), set()], math.ceil(1 / eps)
    for m, t in enumerate(kinds, 1):
        count[t] = count.get(t, 0) + 1
        last[t] = m
        now = [{x for x in count if count[x] / m >= thr}, {x for x in last if m - last[x] < width}]
        for k in (0, 1):
            out[k] |= {(m, x, "ACTIVE") for x in now[k] - on[k]} | {(m, x, "INACTIVE") for x in on[k] - now[k]}
            on[k] = now[k]
        b = math.ceil(m / w)
        if t not in lossy:
            out[2].add((m, t, "ACTIVE"))
        f, d = lossy.get(t, (0, b - 1))
        lossy[t] = (f + 1, d)
        if m % w == 0:
            out[2] |= {(m, x, "INACTIVE") for x, v in lossy.items() if sum(v) <= b}
            lossy = {x: v for x, v in lossy.items() if sum(v) > b}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strategies(spark, seed):
    rng = random.Random(seed)
    kinds = [rng.choices("abcdef", [9, 5, 3, 2, 1, 0.5])[0] for _ in range(150)]
    messages = spark.createDataFrame(list(enumerate(kinds, 1)), "msg long, object_type string")
    want = strategies(kinds, 0.2, 6, 0.25)
    got = [objects.relative_frequency(messages, 0.2), objects.sliding_window_inclusion(messages, 6), objects.lossy_inclusion(messages, 0.25)]
    for g, x in zip(got, want):
        rows = [tuple(r) for r in g.select("msg", "object_type", "command").collect()]
        assert set(rows) == x and len(rows) == len(x)


def aer_fold(events, eps, every):
    w, seen, table, out = int(1 / eps), {}, {}, set()
    for n, (a, sizes) in enumerate(events, 1):
        seen[a] = seen.get(a, 0) + 1
        b = math.ceil(seen[a] / w)
        names = sorted(sizes)
        for i, x in enumerate(names):
            for y in names[i + 1 :]:
                one, two = sizes[x], sizes[y]
                card = "1..1" if one == two == 1 else "1..N" if one == 1 else "N..1" if two == 1 else "N..M"
                t = table.setdefault((a, x, y), {})
                f, d = t.get(card, (0, b))
                t[card] = (f + 1, d)
        if seen[a] % w == 0:
            for k in table:
                if k[0] == a:
                    table[k] = {c: v for c, v in table[k].items() if sum(v) > b}
        if (n + 1) % every == 0:
            out |= {(n, *k, max(t.items(), key=lambda kv: kv[1][0])[0]) for k, t in table.items() if t}
    return out


@pytest.mark.parametrize("seed,eps", [(1, 0.5), (2, 0.25), (3, 0.2)])
def test_aer(spark, seed, eps):
    rng = random.Random(seed)
    events = [(rng.choice("PQR"), {t: rng.choice([1, 1, 2, 3]) for t in rng.sample(["Item", "Order", "User"], rng.randint(1, 3))}) for _ in range(200)]
    rows = [(i, a, {t: [f"{t}{k}" for k in range(c)] for t, c in s.items()}) for i, (a, s) in enumerate(events, 1)]
    df = spark.createDataFrame(rows, "n long, activity string, omap map<string,array<string>>").repartition(3)
    got = {tuple(r) for r in objects.aer_lossy_ticks(df, 7, eps).collect()}
    assert got == aer_fold(events, eps, 7)


def test_merge_has_only_active_types(spark):
    log = dict_ocel_log(spark, [(FLOW, 30)])
    messages, models = objects.oc_miner(log, 10, 0.01)
    commands = objects.relative_frequency(messages, 0.25)
    graph = objects.spelled_out(objects.merged_ocdfg(messages, models, commands))
    active = {}
    for m, t, c in sorted(tuple(r) for r in commands.select("msg", "object_type", "command").collect()):
        active.setdefault(m, []).append((t, c))
    on, want = set(), {}
    kinds = {r.msg: r.object_type for r in messages.collect()}
    seen = set()
    for m in sorted(kinds):
        for t, c in active.get(m, []):
            (on.add if c == "ACTIVE" else on.discard)(t)
        seen.add(kinds[m])
        want[m] = on & seen
    got = {r.msg: set(r.t) for r in graph.groupBy("msg").agg(F.collect_set("object_type").alias("t")).collect()}
    assert got == {m: t for m, t in want.items() if t}


def test_lossy_input(spark):
    schema = "n long, activity string, omap map<string,array<string>>"
    rows = [(i, "AB"[i % 2], {"Order": [f"o{i % 3}"]}) for i in range(1, 40)]
    cases = spark.createDataFrame([(n, a, m["Order"][0]) for n, a, m in rows], "n long, activity string, case_id string")
    want = sorted(map(tuple, discovery.heuristics_lossy_ticks(cases, 5, 0.1).collect()))
    assert sorted(map(tuple, discovery.heuristics_lossy_ticks(spark.createDataFrame(rows, schema), 5, 0.1).collect())) == want
    for bad in ({"Order": ["a", "b"]}, {"Order": ["a"], "Item": ["b"]}, {}):
        with pytest.raises(ValueError):
            discovery.heuristics_lossy_ticks(spark.createDataFrame([*rows, (40, "A", bad)], schema))
    with pytest.raises(TypeError):
        discovery.heuristics_lossy_ticks(spark.range(3))


def test_dot_names_are_escaped(spark):
    from tracewright.functions import render

    edges = spark.createDataFrame([('ty"pe', 'a"b', "c\\\\d", 2)], "object_type string, src string, dst string, freq long")
    assert '"a\\"b" -> "c\\\\\\\\d"' in render.ocdfg_to_dot(edges)
    aer = spark.createDataFrame([('a"b', "x", 'y"', "1..1")], "activity string, type_a string, type_b string, cardinality string")
    assert 'label="a\\"b"' in render.aer_to_dot(aer) and '"a\\"b/y\\""' in render.aer_to_dot(aer)
