import random
import tracemalloc
import zlib

from tracewright.llm.toxicity import Settings, Trainer, chosen, training_sample


def test_long_labelled_texts_are_learnt_from(spark):
    rows = [(k, f"word{k} " + "filler " * (12_000 if k % 2 else 5)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 4 // 2) for k in range(40)], "doc_id long, toxic int")
    want = sorted(k for k in range(40) if zlib.crc32(str(k).encode()) % 5)
    got = training_sample(docs, labels, Settings())
    assert sorted(int(t.split()[0][4:]) for t, _ in got) == want and max(len(t) for t, _ in got) < 20


def test_long_texts_give_stretches_of_the_whole(spark):
    """No text is left out for its many words, and repeated rows of an id count once."""
    rows = [(1, " ".join(f"a{i}" for i in range(30_000))), (2, "short one")] + [(3, "said twice")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 0)], "doc_id long, toxic int")
    s = Settings(most_words=400)
    own = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5]
    got = training_sample(docs, labels, s)
    assert len(got) == len(own) and 1 in own
    words = max((t for t, _ in got), key=len).split()
    at = [int(w[1:]) for w in words]
    assert len(words) <= 400 and at[0] == 0 and at[-1] > 29_000 and max(b - a for a, b in zip(at, at[1:])) < 1000


def test_settings_are_chosen_in_the_sample():
    rng = random.Random(1)
    sample = [(" ".join(rng.choice("abcdefgh") * 3 for _ in range(20)) + (" vile" if k % 2 else ""), k % 2) for k in range(120)]
    good, bad = Settings(steps=60), Settings(steps=1)
    best, means = chosen(sample, [bad, good])
    assert best is good and means[1] > 0.9


def test_training_memory():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(60_000)]
    texts = [" ".join(rng.sample(vocab, 500)) for _ in range(1000)]
    tracemalloc.start()
    Trainer(texts, [k % 2 for k in range(1000)], Settings(steps=2)).fit()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6
