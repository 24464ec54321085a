from itertools import combinations

import numpy as np
import xxhash

from tracewright.llm.simhash import block_links, simhash_groups


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> i & 1 for h in hs) > len(hs)) << i for i in range(64)) if hs else 0


def slow_groups(rows, radius=4):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(fps)), 2):
        if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, fp, least.get(find(k))) for k, (i, fp) in enumerate(fps)), key=str)


def same(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash_groups(docs).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == slow_groups(rows)


def test_block_links_join_what_chains_join():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    flips = [(np.uint64(1) << rng.integers(0, 64, 6).astype(np.uint64)) for _ in range(300)]
    fps = np.unique(np.array([np.bitwise_xor.reduce(f[: 1 + k % 6], initial=base[k % 40]) for k, f in enumerate(flips)]))
    for radius in (1, 3, 4, 7):
        parent = list(range(len(fps)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in combinations(range(len(fps)), 2):
            if int(fps[a] ^ fps[b]).bit_count() <= radius:
                parent[find(a)] = find(b)
        want = len({find(x) for x in range(len(fps))})
        edges = block_links(fps, radius, tile=70)
        assert all(int(fps[a] ^ fps[b]).bit_count() <= radius for a, b in edges)
        assert len(edges) == len(fps) - want


def test_groups(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(30):
        base = list(rng.choice(words, 120))
        rows.append((k * 10, " ".join(base)))
        for j in range(k % 4):
            base[int(rng.integers(120))] = "changed"
            rows.append((k * 10 + 1 + j, " ".join(base).upper() if j == 1 else "\n".join(base)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE\ttwo"), (7, rows[0][1]), (None, "null id"), (None, rows[3][1]), (7, rows[0][1]), (1005, "a b c d " * 20000)]
    same(spark, rows)


def test_hot_bucket_is_dealt_in_cells(spark):
    from tracewright.llm.common import Workspace
    from tracewright.llm.components import components
    from tracewright.llm.simhash import links

    fps = [(1 << a) | (1 << b) for a in range(20, 40) for b in range(a)] + [-1, -2]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    work = Workspace(spark, "t")
    got = {r.node: r.root for r in components(links(df, work, 1, cell=16), work).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(fps, 2):
        if ((a ^ b) % (1 << 64)).bit_count() <= 1:
            parent[find(a)] = find(b)
    for a, b in combinations(fps, 2):
        assert (find(a) == find(b)) == (got.get(a, a) == got.get(b, b))


def test_empty(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
