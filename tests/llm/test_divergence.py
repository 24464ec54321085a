import random
import re
from collections import Counter, defaultdict

import pytest

from tracewright.llm.divergence import _shares, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string"


def brute(rows, least, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = TERM.findall(low)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        peers = sorted(s for k, s in groups if k == lang)
        share = lambda own: {t: 1 + 10**9 * (own[t] + 5) // (sum(own[k] for k in kept) + 5 * len(kept)) for t in kept}
        p = share(counts[lang, source])
        q = share(sum((counts[lang, s] for s in peers), Counter()))
        other = {s: share(counts[lang, s]) for s in peers if s != source}
        pairs = [(sum(abs(p[t] - o[t]) for t in kept), s) for s, o in other.items()]
        terms = [(p[t] - q[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("block,chunk", [(None, 1 << 14), (2, 5), (3, 1)])
def test_same_as_brute_force(spark, block, chunk):
    rng = random.Random(chunk)
    words = ["Alpha", "alpha", "bêta", "BÊTA", "x1y", "don't", "日本", "𝔘", "ﬀ", "İ", "q", "zz", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6))]
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["s0"] * 6 + ["s1", "s2", "s10", "é", "𝔘", None])
        pool = words[: rng.randint(3, len(words))]
        rows.append((" ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))), lang, source))
    rows += [(None, "en", "empty"), ("", "fr", "empty"), ("0 1 \x00", "de", "a"), ("ab", "de", "b"), ("same", "en", "s0"), ("same", "en", "s0"), ("lone", "xx", "only")]
    df = spark.createDataFrame([(i, *r, 1, "t") for i, r in enumerate(rows)], SCHEMA).repartition(4)
    got = source_divergence(df, least_docs=12, top=7, block=block, chunk=chunk).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 12, 7)


def test_long_text_and_no_rows(spark):
    long = "ab cd\x00EF " * 700_000
    rows = [(1, long, "en", "a", 1, ""), (2, "ab ab zz", "en", "b", 1, "")]
    got = source_divergence(spark.createDataFrame(rows, SCHEMA), least_docs=1).collect()
    assert sorted(tuple(r) for r in got) == brute([(r[1], r[2], r[3]) for r in rows], 1, 50)
    assert source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_of_large_counts():
    import numpy as np

    n, total = np.array([0, 5, 4 * 10**14, 9 * 10**14]), np.int64(9 * 10**14 + 40)
    assert _shares(n, total).tolist() == [1 + 10**9 * (int(k) + 5) // int(total) for k in n]
