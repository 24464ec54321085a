from itertools import combinations

import corpus_pipeline
import numpy as np
from test_simhash import slow_groups

from tracewright.llm.near_copies import near_groups


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_near(rows):
    first = {i: c for i, _, c in slow_groups(rows)}
    sets = {i: shingle_set(t) for i, t in rows}
    for a, b in combinations(sets, 2):
        shared = len(sets[a] & sets[b])
        if shared and shared >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((first[a], first[b]))
            first = {i: low if c == high else c for i, c in first.items()}
    return first


def near_rows():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(25):
        base = list(rng.choice(words, 150))
        for j in range(6):  # each differs from the first, so most pairs of them are below 0.8
            text = list(base)
            for at in rng.choice(140, 3 if j else 0, replace=False):
                text[int(at)] = "changed"
            rows.append((int(1000 - 40 * k - j if k % 2 else 2000 + 40 * k + j), " ".join(text)))
    return rows + [(1, None), (2, ""), (3, "one two"), (4, "ONE\ttwo"), (5, "a b c d e " * 50), (6, "a b c d e " * 90)]


def test_near_groups(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "k long, text string")
    want = slow_near(rows)
    assert {r.doc_id: r.component_id for r in near_groups(docs, "k").collect()} == want
    assert len(set(want.values())) < len({c for _, _, c in slow_groups(rows)})  # SimHash alone leaves them apart


def test_many_partitions_write_few_files(spark, monkeypatch):
    """Tables of numbers are written by three tasks a core, however many partitions a shuffle has: every file
    starts processes beside the executor, and small ones came in thousands."""
    from tracewright.llm.common import Workspace

    rows, written = near_rows(), {}
    own = Workspace.save

    def save(self, df, name, *rest):
        out = own(self, df, name, *rest)
        if "/near-copies-" in self.root:
            written[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Workspace, "save", save)
    docs = spark.createDataFrame(rows, "k long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("40", "false")):
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in near_groups(docs, "k").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == slow_near(rows)
    assert {"sketches", "classes", "members", "open-members", "pairs-1", "near-1", "members-2", "left"} <= set(written)
    few = 3 * spark.sparkContext.defaultParallelism
    assert {name: n for name, n in written.items() if n > few and name not in ("simhash-groups", "pool-links")} == {}


def test_stage_drops_near_copies_beyond_radius_4(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()}
    assert kept == {i for i, c in slow_near(rows).items() if i == c}


def test_null_ids_and_empty_table(spark):
    text = near_rows()[0][1]
    docs = spark.createDataFrame([(None, text), (None, "x " + text), (7, text + " y"), (7, "other words")], "doc_id long, text string")
    assert corpus_pipeline.simhash_stage(spark, docs, "").count() == 2
    assert corpus_pipeline.simhash_stage(spark, docs.limit(0), "").count() == 0
