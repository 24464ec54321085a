import hashlib
import random

import pyarrow as pa
import pytest

from tracewright.llm.substring import drop_repeated_words
from tracewright.llm.suffix_dedup import drop_repeated_bytes, loser_merge


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"x{i}" for i in range(400)]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [words(rng.randint(20, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = words(rng.randint(0, 150))
        for s in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            cut = sorted(rng.sample(range(len(s) + 1), 2)) if rng.random() < 0.4 else (0, len(s))
            t[at:at] = s[cut[0] : cut[1]]
        if rng.random() < 0.2:
            t += ["again"] * rng.randint(1, 120)
        if rng.random() < 0.2:
            t = t + t
        rows.append((i * 3, " ".join(t) if i % 2 else "\n".join(t)))
    for k in range(12):  # near copies
        t = rows[k % 5][1].split(" ")
        t[rng.randrange(len(t))] = "edited"
        rows.append((1000 + k, " ".join(t)))
    rows += [(2000 + k, rows[7][1]) for k in range(9)]
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "abc " * 40000)]
    rng.shuffle(rows)
    return rows


def slow_words(rows, width):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = {}
    for d, (_, w) in enumerate(docs):
        for p in range(len(w) - width + 1):
            seen.setdefault(tuple(w[p : p + width]), []).append((d, p))
    gone = [set() for _ in docs]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d].update(range(p, p + width))
    return sorted(
        ((i, len(w), len(gone[d]), b" ".join(x for k, x in enumerate(w) if k not in gone[d]).decode()) for d, (i, w) in enumerate(docs)),
        key=str,
    )


def slow_bytes(rows, width):
    docs = sorted(((i, (t or "").encode(), t) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2] is not None, r[1]))
    seen, out = set(), []
    for i, t, _ in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            s = t[p : p + width]
            if s in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(s)
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("extra", [[], [(0, "twice " * 50), (0, "twice " * 50), (None, "null id " * 60), (None, None)]])
@pytest.mark.parametrize("width,gram", [(35, 8), (12, 5)])
def test_words(spark, width, gram, extra):
    rows = corpus(width) + extra
    docs = spark.createDataFrame([(i, t, "l", 1) for i, t in rows], "doc_id long, text string, lang string, n_words int")
    got = drop_repeated_words(docs.repartition(5), width, gram)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_removed"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()), key=str) == slow_words(rows, width)


@pytest.mark.parametrize("extra", [[], [(0, "twice " * 50), (0, "twice " * 50), (None, "null id " * 60), (None, None)]])
@pytest.mark.parametrize("width,gram", [(100, 48), (100, 72), (30, 9)])
def test_bytes(spark, width, gram, extra):
    rows = corpus(width) + extra
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = drop_repeated_bytes(docs.repartition(5), width, gram).collect()
    mine = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)
    assert mine == slow_bytes(rows, width)


def test_frequent_code_in_small_lots():
    """However the rows are cut into lots, items whose code is met again are told, and a code of all
    rows sends one item for each lot to its part."""
    import numpy as np

    from tracewright.llm.dealing import answer, ask

    rng = np.random.default_rng(5)
    for both in (False, True):
        code = rng.integers(0, 400, 2000).astype(np.uint64) << np.uint64(55)
        code[::2] = 77 << 55
        x = rng.integers(0, 3, 2000).astype(np.uint64)
        key, p = rng.integers(-5, 5, 2000), np.arange(2000)
        pairs = list(zip(code.tolist(), x.tolist() if both else [0] * 2000))
        want = {i for i, c in enumerate(pairs) if pairs.count(c) > 1}
        for lots in (1, 7, 40):
            dealt = {}
            for i in range(lots):
                for row in ask(code[i::lots], key[i::lots], p[i::lots], x[i::lots], 8, both).to_pylist():
                    dealt.setdefault(row["part"], []).append(row)
            assert max(sum(len(r["p"]) // 4 for r in rows) for rows in dealt.values()) < 600
            got = []
            for rows in dealt.values():
                k, start, extra = answer([pa.RecordBatch.from_pylist(rows)], both)
                assert (key[start] == k).all() and (x[start] == extra).all()
                got += start.tolist()
            assert len(got) == len(set(got)) and set(got) == want


def test_grouped_runs(spark):
    import numpy as np

    from tracewright.llm.dealing import RUNS, by_key, grouped, numbers

    rng = np.random.default_rng(2)
    key, p, n = rng.integers(-3, 4, 500), rng.integers(0, 3000, 500), rng.integers(1, 9, 500)
    rows = [r for b in by_key(key, p, n, 4) for r in b.to_pylist()]
    got = grouped(spark.createDataFrame(rows, RUNS).repartition(3), 4, True).collect()
    assert sorted(r["__key"] for r in got) == sorted(set(key.tolist()))
    for r in got:
        runs = list(zip(numbers(r.p).tolist(), numbers(r.n).tolist()))
        assert all(a + m < b for (a, m), (b, _) in zip(runs, runs[1:]))
        want = {i for k, a, m in zip(key.tolist(), p.tolist(), n.tolist()) if k == r["__key"] for i in range(a, a + m)}
        assert {i for a, m in runs for i in range(a, a + m)} == want


def test_many_ranges(spark):
    """Range borders inside groups of one gram, small runs, blocks and groups change nothing."""
    from tracewright.llm.common import Workspace
    from tracewright.llm.dealing import numbers
    from tracewright.llm.suffix_dedup import later_windows

    rows = [(i, (t or "").encode()) for i, t in corpus(9)]
    texts = spark.createDataFrame(rows, "__key long, text binary").repartition(4)
    sets = []
    for sizes in ((60_000, 500, 300_000, 50_000), (50, 7, 20, 50_000), (60_000, 500, 300_000, 3), (50, 7, 20, 3)):
        got = later_windows(texts, Workspace(spark, "t"), 40, 16, *sizes).collect()
        sets.append({(r["__key"], i) for r in got for p, n in zip(numbers(r.p), numbers(r.n)) for i in range(p, p + n)})
    assert sets[0] and all(s == sets[0] for s in sets)


def merged_here(strings, splitters, group_rows, monkeypatch):
    """Rows that leave, windows found, and the sizes of groups compared, of ranges merged in this process."""
    import numpy as np

    from tracewright.llm import suffix_dedup as sd

    matrix = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), -1)
    keys = np.arange(len(strings))
    blocks = [sd.run_blocks(matrix[i::3], keys[i::3], np.full_like(keys[i::3], 60), i << 32, 100) for i in range(3)]
    parts = [r for b in sd.cut_blocks(iter(blocks), splitters) for r in b.to_pylist() if r["block"] >= 0]
    schema = next(sd.cut_blocks(iter(blocks), splitters)).schema
    sizes, cut, found, widths = [], [], 0, []
    own = sd.equal_windows
    monkeypatch.setattr(sd, "equal_windows", lambda group, *rest: sizes.append(len(group)) or own(group, *rest))
    for k in range(len(splitters) + 1):
        batch = pa.RecordBatch.from_pylist([r for r in parts if r["part"] == k], schema)
        for out in sd._merge_range(iter([batch]), 60, 16, splitters, 4, group_rows):
            rows = [r for r in out.to_pylist() if r["row"] is not None]
            widths.append(len(rows))
            cut += [(r["row"], r["key"]) for r in rows]
            found += sum(len(r["p"]) // 4 for r in out.to_pylist() if r["row"] is None)
    return cut, found, sizes, max(widths)


def test_frequent_gram(monkeypatch):
    """Of 200,000 rows of one gram none are held beyond the limit; all leave, once each, for the pass by windows.
    Borders may fall inside the gram, and rarer grams are compared where they are."""
    import numpy as np

    rng = np.random.default_rng(4)
    hot = [b"G" * 16 + bytes(x) for x in rng.integers(97, 123, (200_000, 44 + 44), np.uint8)]
    rare = [b"R" * 16 + bytes(x) for x in rng.integers(97, 123, (300, 44 + 44), np.uint8)]
    lengths = (44).to_bytes(2, "big") + (60).to_bytes(2, "big") + b"\0"
    strings = [s + lengths for s in hot + rare]
    middle = sorted(strings)[100_000][:30]
    for splitters in ([], [b"A"], [middle], [middle, b"GGGGz"]):
        cut, found, sizes, widest = merged_here(strings, splitters, 50_000, monkeypatch)
        assert sorted(cut) == sorted((s, i) for i, s in enumerate(strings[:200_000])) and found == 0
        assert sizes == [300] and widest <= 4096


def test_loser_merge():
    rng = random.Random(1)
    shares = lambda x, y: next((i for i in range(6) if x[i] != y[i]), 6)
    for _ in range(200):
        runs = []
        for _ in range(rng.randint(1, 9)):
            strings = sorted({bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(0, 12))})
            runs.append([(s, shares(strings[i - 1], s) if i else 0) for i, s in enumerate(strings)])
        out = list(loser_merge([iter(r) for r in runs]))
        got = [s for _, (s, _) in out]
        assert got == sorted(s for r in runs for s, _ in r)
        for (x, y), (n, _) in zip(zip(got, got[1:]), out[1:]):
            assert n == shares(x, y)


def test_names_that_clash(spark):
    rows = [(i, "one two three four five six " * 9, 1, "b", 2) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key int, __p string, N_Removed int")
    cut = drop_repeated_words(docs)
    assert cut.columns == ["doc_id", "text", "__key", "__p", "n_words", "n_removed"]
    assert {tuple(r) for r in cut.collect()} == {(i, "", 1, "b", 54, 54) for i in range(3)}
    docs = docs.toDF("doc_id", "text", "__key", "p", "n")
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in drop_repeated_bytes(docs, 20, 8).collect())[0][0] == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_words(docs).collect() == [] and drop_repeated_bytes(docs).collect() == []
