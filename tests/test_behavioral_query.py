import random
import time

import pytest

from tracewright.operators import behaviour, discovery, filters
from tracewright.plans.queries import QUERIES, log

DATA = "/root/testdata/sf0.001"


def activities(rows):
    return {a for r in rows for a in (r.src, r.dst)}


def test_query_covers_every_activity(spark):
    events = log(spark, DATA)
    rows = QUERIES["behavioral_model"](spark, DATA).collect()
    assert activities(rows) == {r.activity for r in events.select("activity").distinct().collect()}
    assert {(r.src, r.dst) for r in rows} == {(r.src, r.dst) for r in discovery.directly_follows(events).select("src", "dst").distinct().collect()}


def test_filtered_log(spark):
    events = log(spark, DATA).transform(filters.excludes_activity_filter(["error", "signup"]))
    rows = discovery.behavioral_model(events).collect()
    assert activities(rows) == {"view", "click", "purchase"} and all(r.p_max >= r.p_min for r in rows)


def walked(relations, starts, ends):
    """The same by plain walks over all paths."""
    after = {r: [x for x in relations if x[0] == r[1]] for r in relations}
    before = {r: [x for x in relations if x[1] == r[0]] for r in relations}

    def distances(sources, step):
        found, now, depth = {}, set(sources), 0
        while now:
            found |= dict.fromkeys(now, depth)
            now = {x for r in now for x in step[r]} - found.keys()
            depth += 1
        return found

    first = [r for r in relations if r[0] in starts]
    p_min, f = distances(first, after), distances([r for r in relations if r[1] in ends], before)
    p_max = {}
    for source in first:
        for r, depth in distances([source], after).items():
            p_max[r] = max(depth, p_max.get(r, -1))
    todo = [(r, frozenset(), frozenset()) for r in first]
    met = set(todo)
    while todo:
        r, seen, again = todo.pop()
        p_max[r] = max(len(seen), p_max[r])
        if len(seen) < behaviour.DEEPEST:
            for x in after[r]:
                state = (x, seen, again | {r}) if r in seen else (x, seen | {r}, again)
                if x not in state[2] and state not in met:
                    met.add(state)
                    todo.append(state)
    return sorted((*r, p_min.get(r), p_max.get(r), f.get(r)) for r in relations)


GRAPHS = [
    (["ab", "bc", "cd"], "a", "d"),
    (["ec", "cb", "bx", "xc", "by", "yc", "bz", "zc"], "e", "z"),  # a loop through c and b, used twice at most
    (["aa"], "a", "a"),
    (["ab", "ba", "cd"], "a", "d"),
    (["ab", "bc", "ca", "bd", "de", "ed"], "ab", "e"),
    (["ab"], "", ""),
]


@pytest.mark.parametrize("k", range(len(GRAPHS) + 3))
@pytest.mark.parametrize("kept", [1, 16])
def test_same_as_walks(spark, monkeypatch, k, kept):
    monkeypatch.setattr(behaviour, "KEPT", kept)
    if k < len(GRAPHS):
        edges, starts, ends = GRAPHS[k]
        relations = [tuple(e) for e in edges]
    else:
        rng = random.Random(k)
        relations = list({(rng.choice("abcdefg"), rng.choice("abcdefg")) for _ in range(11)})
        starts, ends = relations[0][0], relations[-1][1]
    rel = spark.createDataFrame(relations, "src string, dst string")
    side = lambda names: spark.createDataFrame([(a,) for a in names], "activity string")
    got = sorted(map(tuple, behaviour.model_of(rel, side(starts), side(ends)).collect()))
    assert got == walked(relations, set(starts), set(ends))


def test_dense_graph(spark):
    """40 activities that all follow one another but for the start, which nothing leads to."""
    names = [f"x{i:02d}" for i in range(40)]
    rel = spark.createDataFrame([(a, b) for a in names for b in names if b != names[0]], "src string, dst string")
    side = lambda a: spark.createDataFrame([(a,)], "activity string")
    began = time.time()
    rows = behaviour.model_of(rel, side(names[0]), side(names[-1])).collect()
    assert time.time() - began < 120
    assert len(rows) == 40 * 39 and {r.p_max for r in rows if r.src != names[0]} == {6} and {(r.p_min, r.p_max) for r in rows if r.src == names[0]} == {(0, 0)}
