"""Running values, as-of joins and span joins against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions.lossy import lossy_states
from tracewright.functions.running import as_of, running
from tracewright.functions.spans import merged_spans, overlaps


@pytest.mark.parametrize("size", [1, 3, 50, 1 << 20])
def test_running(spark, size):
    rng = random.Random(size)
    rows = [(k, n, rng.choice([None, 1, 2, -5, 7])) for k in ["a", "b", None] for n in rng.sample(range(120), 60 if k == "a" else 7)]
    df = spark.createDataFrame(rows, "k string, n long, v long").repartition(5)
    kinds = ["sum", "before", "min", "last", "lag", "lead"]
    got = running(df, ["k"], "n", size, **{f"x_{kind}": (kind, "v") for kind in kinds}).collect()
    want = []
    for key in ("a", "b", None):
        own = sorted((n, v) for k, n, v in rows if k == key)
        for i, (n, v) in enumerate(own):
            past = [x for _, x in own[:i] if x is not None]
            upto = past + ([v] if v is not None else [])
            want.append((key, n, v, sum(upto), sum(past), min(upto, default=None), upto[-1] if upto else None, own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert running(df.where("false"), ["k"], "n", s=("sum", "v")).collect() == []



def test_one_key_is_split(spark):
    """The rows of one key are dealt out by ranges: no task of the inner windows holds more than one."""
    df = spark.range(4000).select(F.lit("k").alias("k"), F.col("id").alias("n"))
    out = running(df, ["k"], "n", 500, total=("sum", F.lit(1)))
    assert out.agg(F.max("total"), F.sum(F.expr("cast(total <> n + 1 AS int)"))).first() == (4000, 0)
    most = df.withColumn("r", F.floor(F.col("n") / 500)).groupBy("r").count().agg(F.max("count")).first()[0]
    assert most == 500


@pytest.mark.parametrize("size", [4, 1 << 20])
def test_as_of(spark, size):
    rng = random.Random(size)
    left = [(rng.choice("pq"), rng.randint(0, 60), i) for i in range(80)]
    right = [(k, n, None if n % 7 == 0 else f"{k}{n}") for k in "pq" for n in rng.sample(range(60), 12)]
    a, b = spark.createDataFrame(left, "k string, n long, i long"), spark.createDataFrame(right, "k string, n long, v string")
    got = {(r.k, r.n, r.i, r.v, r.at) for r in as_of(a, b.withColumn("m", F.col("n")), "n", ["k"], size, v="v", at="m").collect()}
    want = set()
    for k, n, i in left:
        found = max(((m, v) for key, m, v in right if key == k and m <= n), default=(None, None))
        want.add((k, n, i, found[1], found[0]))
    assert got == want


def test_spans(spark):
    rng = random.Random(5)
    span = lambda most: (lambda a: (a, min(199, a + rng.randint(0, most))))(rng.randint(0, 199))
    left = [(rng.choice("pq"), *span(rng.choice([0, 3, 150])), i) for i in range(60)]
    right = [(rng.choice("pq"), *span(rng.choice([0, 1, 9, 190])), i) for i in range(60)]
    a = spark.createDataFrame(left, "k string, from long, to long, i long")
    b = spark.createDataFrame(right, "k string, from long, to long, j long")
    got = sorted((r["k"], r["from"], r["to"], r.i, r.j) for r in overlaps(a, b, ["k"], 199).collect())
    assert got == sorted((k, max(x, p), min(y, q), i, j) for k, x, y, i in left for m, p, q, j in right if k == m and max(x, p) <= min(y, q))
    for key in "pq":
        covered = {n for k, x, y, _ in left if k == key for n in range(x, y + 1)}
        own = sorted((r["from"], r["to"]) for r in merged_spans(a, ["k"]).where(F.col("k") == key).collect())
        assert {n for x, y in own for n in range(x, y + 1)} == covered and all(y + 1 < u for (_, y), (u, _) in zip(own, own[1:]))


@pytest.mark.parametrize("strict", [False, True])
def test_lossy_states_of_split_keys(spark, strict, monkeypatch):
    """Ranges of a few numbers give the same lives as one window over a key."""
    from tracewright.functions import lossy

    rng = random.Random(2)
    rows = [(rng.choice("aabc"), n, (n + 9) // 10, (n + 6) // 7) for n in range(1, 400) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "k string, n long, b long, slot long")
    whole = sorted(map(tuple, lossy_states(df, ["k"], strict).collect()), key=str)
    monkeypatch.setattr(lossy, "running", lambda rows, keys, order, **v: running(rows, keys, order, 16, **v))
    assert sorted(map(tuple, lossy_states(df, ["k"], strict).collect()), key=str) == whole
