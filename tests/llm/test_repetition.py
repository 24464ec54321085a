import random

import numpy as np

from tracewright.llm.repetition import longest_repeats, repetition_rules, suffix_array


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randint(0, rng.choice([0, 1, 3, 30])) for _ in range(rng.randint(1, 60))]
        order, shared = suffix_array(np.array(s))
        suffixes = [s[i:] for i in order]
        assert suffixes == sorted(s[i:] for i in range(len(s)))
        for k in range(1, len(s)):
            a, b = suffixes[k - 1], suffixes[k]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        for i, n in enumerate(longest_repeats(np.array(s))):
            starts = lambda m: sum(s[j : j + m] == s[i : i + m] for j in range(len(s) - m + 1))
            assert (n == 0 or starts(n) > 1) and (i + n == len(s) or starts(n + 1) == 1)


def slow(text, least=5):
    words = (text or "").encode().split()
    n = len(words)

    def repeated(k):
        seen = {}
        for p in range(n - k + 1):
            seen.setdefault(tuple(words[p : p + k]), []).append(p)
        return [p for ps in seen.values() if len(ps) > 1 for p in ps]

    three = {p + i for p in repeated(3) for i in range(3)}
    longest = max((k for k in range(1, n + 1) if repeated(k)), default=0)
    span = {p + i for p in repeated(least) for i in range(least)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in lines
            lines.add(line)
    failed = n < 50 or 100 * len(three) > 50 * n
    chars = sum(len(w.decode()) for w in words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    kept = not failed and len(span) <= 0.3 * n and longest <= 60
    return n, chars, symbols, dup, len(three), longest, len(span), failed, kept


def test_rules(spark):
    rng = random.Random(4)
    rows = [(None, "null id"), (1, None), (2, ""), (3, " \n\n\t"), (4, "a\x1cb\xa0c d　e"), (4, "a\x1cb\xa0c d　e")]
    for i in range(60):
        vocab = [f"é{j}" if j % 5 == 0 else f"w{j}#" if j % 7 == 0 else f"w{j}" for j in range(rng.choice([3, 30, 3000]))]
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.5:
            lines += [rng.choice(lines) for _ in range(rng.randint(1, 4))]
        rows.append((10 + i, rng.choice(["\n", " \n"]).join(lines)))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int")
    got = repetition_rules(docs).collect()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words longest_repeat n_covered_words base_failed kept".split()
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=str) == sorted(((i, *slow(t)) for i, t in rows), key=str)


def test_long_and_empty(spark):
    docs = spark.createDataFrame([(1, "again and " * 150_000)], "doc_id long, text string")
    r = repetition_rules(docs).first()
    assert (r.n_words, r.n_repeat_words, r.longest_repeat, r.kept) == (300_000, 300_000, 299_998, False)
    assert repetition_rules(docs.where("false")).collect() == []
