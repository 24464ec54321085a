import hashlib
import random

import pytest

from tracewright.llm.chat import conversation_digests, format_reply_trees, read_turns

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_round_trip_of_conversations(spark):
    rng = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "\\", "<", "|", "<\\|", "<\\\\", "\n", "é", "日", "<\\n", "n"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", text()]), text()) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"long {t}") for t in range(3000)]
    rows += [(60, 1, "user", None), (60, 1, "user", None), (60, None, None, "x"), (None, 2, "assistant", "null conv"), (61, -5, "assistant", "")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, node string")
    got = {r.conv_id: r for r in conversation_digests(df).collect()}
    probe = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        null = lambda v: (v is not None, v or type(v)() if v is not None else 0)
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (null(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(mine), len(loss))
        assert r.turns_sha256 == sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine))
        assert r.loss_sha256 == sha(loss) and r.formatted_chars >= sum(len(x[3] or "") for x in mine)


def test_branches_by_score(spark):
    rng = random.Random(3)
    rows, kids, info = [], {}, {}
    for tree in range(12):
        for node in range(rng.randint(1, 30)):
            parent = rng.randrange(node) if node and rng.random() < 0.95 else None
            if node and rng.random() < 0.03:
                parent = 999  # missing
            info[tree, node] = (parent if parent is not None and parent < node else None, rng.choice([0.0, 1.0, 2.5, -1.0]))
            rows.append((tree, node, parent, rng.choice(["user", "assistant"]), f"t{tree}n{node}", info[tree, node][1]))
    path = lambda t, n: ([] if info[t, n][0] is None else path(t, info[t, n][0])) + [n]
    inner = {(t, p) for (t, _), (p, _) in info.items() if p is not None}
    want = {}
    for tree in range(12):
        leaves = [n for t, n in info if t == tree and (t, n) not in inner]
        ranked = sorted(leaves, key=lambda n: (-sum(info[tree, k][1] for k in path(tree, n)), n))
        for b, n in enumerate(ranked[:2]):
            want[tree, b] = [f"t{tree}n{k}" for k in path(tree, n)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.branch): [t.text for t in r.turns] for r in read_turns(format_reply_trees(df, top=2)).collect()}
    assert got == want
    best = {r.tree: [t.text for t in r.turns] for r in read_turns(format_reply_trees(df)).collect()}
    assert best == {t: p for (t, b), p in want.items() if b == 0}


def test_cycle_and_empty(spark):
    schema = "tree long, node long, parent long, role string, text string, score double"
    with pytest.raises(ValueError):
        format_reply_trees(spark.createDataFrame([(1, 1, 2, "a", "b", 0.0), (1, 2, 1, "a", "b", 0.0)], schema))
    assert format_reply_trees(spark.createDataFrame([], schema)).collect() == []
