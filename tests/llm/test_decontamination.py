import math
import random
import re

from pyspark.sql import functions as F

from tracewright.llm.decontamination import contained_items, drop_contaminated, sketches


def words(text):
    return [x for x in re.split(r"[^\w]+|_+", (text or "").lower()) if x]


def grams(text, sizes=(1, 2, 3, 4, 5)):
    w = words(text)
    return {tuple(w[i : i + k]) for k in sizes for i in range(len(w) - k + 1)}


def own_grams(text):
    """Of an item: five words, or all it has."""
    w = words(text)
    return grams(text, [min(len(w), 5)]) if w else set()


def slow(docs, items):
    merged = lambda rows, of: {i: set().union(*(of(t) for j, t in rows if j == i)) for i, _ in rows}
    held = merged(items, own_grams)
    out = []
    for d, ds in merged(docs, grams).items():
        for i, s in held.items():
            if s and len(ds & s) >= math.ceil(0.8 * len(s) - 1e-12):
                out.append((d, i, len(s), len(ds & s)))
    return sorted(out, key=str)


def test_containment(spark):
    rng = random.Random(8)
    vocab = [f"Wört{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 70)))) for i in range(25)]
    items += [(0, items[1][1]), (None, items[2][1]), (90, None), (91, ""), (92, "one two"), (93, "a b c d e " * 3)]
    items += [(94, "Lone"), (95, "two"), (96, items[3][1]), (97, items[3][1]), (98, "p q r s"), (98, "p q r s t u v")]
    docs = [(100, None), (101, ""), (102, "one two"), (None, items[4][1]), (None, "null"), (103, "word " * 30000)]
    docs += [(104, "a lone one-two"), (105, "p q r s t u v"), (106, "r s p q")]
    # Neither row has the shingles of the item, both together have.
    halves = items[3][1].split()
    docs += [(107, " ".join(halves[: len(halves) // 2 + 4])), (107, " ".join(halves[len(halves) // 2 :]))]
    for k in range(120):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 400))]
        if k % 2:
            s = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if s:
                    s[rng.randrange(len(s))] = "other"
            at = rng.randint(0, len(t))
            t[at:at] = [w.upper() + "," for w in s] if k % 4 == 1 else s
        docs.append((k, rng.choice([" ", "\n", " - "]).join(t)))
    docs.append((5, items[7][1]))
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").repartition(4)
    got = contained_items(d, spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    assert sorted(((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in rows), key=str) == slow(docs, items)
    assert len(rows) > 20
    bad = {r.doc_id for r in rows}
    kept = drop_contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (x for x in docs if x[0] not in bad)))


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert contained_items(docs.where("false"), items).collect() == []
    assert contained_items(docs, items.where("false")).collect() == []
    assert drop_contaminated(docs, items.where("false")).count() == 1


def test_short_items(spark):
    """Items of one to four words are one shingle; one without words matches nothing."""
    items = spark.createDataFrame([(1, "alpha"), (2, "beta Gamma"), (3, "x, y; z!"), (4, "k l m n"), (5, "..."), (6, None)], "item_id long, text string")
    docs = [(1, "ALPHA"), (2, "gamma beta"), (3, "so x y z it is"), (4, "k l m"), (5, "a k l m n b alpha"), (6, None), (7, "")]
    got = contained_items(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert sorted((r.doc_id, r.item_id, r.n_item_shingles, r.containment) for r in got.collect()) == [
        (1, 1, 1, 1.0), (3, 3, 1, 1.0), (5, 1, 1, 1.0), (5, 4, 1, 1.0),
    ]


def test_short_documents_pass_large_classes_over(spark):
    """No candidate is kept of a document that is too small for an item's size class."""
    rows = [(i, f"k{i}", [f"s{j}" for j in range(n)]) for i, n in enumerate((1, 5, 8, 40))]
    sets = spark.createDataFrame(rows, "i int, item string, hashes array<string>").selectExpr("*", "size(hashes) AS n_item")
    got = {r.item: (r.size_class, r.least, r.k) for r in sketches(sets, 0.8).groupBy("item", "size_class", "least").agg(F.count("*").alias("k")).collect()}
    assert got == {"k0": (0, 1, 1), "k1": (2, 4, 2), "k2": (3, 7, 4), "k3": (5, 26, 13)}
