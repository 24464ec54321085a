import random
import zlib

from tracewright.llm.toxicity import Settings, drop_toxic, toxicity

SMALL = Settings(steps=80)


def corpus(seed=1, n=1500):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    bad = ["idiotic", "worthless", "pathetic"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(w) // 20):
                b = rng.choice(bad)
                w[rng.randrange(len(w))] = b if i % 8 else b[:-1] + "k"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_filter(spark):
    rows, labels = corpus()
    rows += [(None, "null id"), (9001, None), (9002, ""), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    labels_df = spark.createDataFrame([*labels, (9003, None), (9004, 5), (None, 1)], "doc_id long, toxic int")
    got = toxicity(docs, labels_df, SMALL).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    kept = drop_toxic(docs, labels_df, SMALL)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in got if r.predicted} - {9001, 9002}
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - gone


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(n=120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    scores = [sorted((r.doc_id, r.score) for r in toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int"), SMALL).collect()) for x in (labels, flip)]
    assert scores[0] == scores[1]


def test_long_text_and_clashing_names(spark):
    """A toxic phrase in the middle of a text of two million characters still shows."""
    rows, labels = corpus(n=400)
    calm = "lena rosit tule nolar " * 50_000
    rows += [(5001, calm + "idiotic worthless pathetic idiotic " + calm), (5002, calm)]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, __score double, __Score_ string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity(docs.select("doc_id", "text"), labels, SMALL).collect()}
    assert score[5001] > score[5002] and score[5002] < 0.5
    kept = drop_toxic(docs, labels, SMALL)
    assert kept.columns == docs.columns and 5002 in {r.doc_id for r in kept.collect()}


def test_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity(docs, none).collect()] == [0]
    assert toxicity(docs.where("false"), none).collect() == []
    assert drop_toxic(docs, none).count() == 1
