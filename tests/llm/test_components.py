"""Connected components against a plain search, whatever the lots and tasks."""

import numpy as np
import pytest

from tracewright.llm import components as c
from tracewright.llm.common import Workspace, dealt_join


def plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for node in sorted(near):
        todo = [node] if node not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = node
                todo += near[x]
    return root


def chain(n):
    return [(i, i + 1) for i in range(n)]


def star(n):
    return [(0, i) for i in range(1, n)] + [(-5, 0)]


def scattered(n):
    draw = np.random.default_rng(7)
    return [tuple(map(int, p)) for p in draw.integers(-(1 << 62), 1 << 62, 60)[draw.integers(0, 60, (n, 2))]]


@pytest.mark.parametrize("edges", [chain(90), star(900), scattered(40), scattered(300)])
@pytest.mark.parametrize("lot", [7, 1 << 20])
def test_components(spark, monkeypatch, edges, lot):
    monkeypatch.setattr(c, "LOT", lot)
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges + [(None, 1), (3, 3)] + edges[:5], "a long, b long").repartition(5)
    rows = c.components(df, Workspace(spark, "test")).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.root for r in rows} == plain(edges)


def test_no_edges(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert c.components(df, Workspace(spark, "test")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_dealt_join_equals_join(spark, how):
    big = spark.createDataFrame([(1, i) for i in range(2000)] + [(2, 0), (3, 1), (3, 1)], "k long, x long")
    small = spark.createDataFrame([(1, "a"), (3, "b"), (4, "c")], "k long, y string")
    got = dealt_join(big, small, "k", big.count(), how).select("k", "x", "y").collect()
    assert sorted(got, key=str) == sorted(big.join(small, "k", how).select("k", "x", "y").collect(), key=str)
