"""The fit on the given tables, judged by folds of its own training rows (held-out labels are not read)."""

from dataclasses import replace

from tracewright.llm.toxicity import Scorer, Settings, Trainer, chosen, training_sample

DATA = "/root/testdata/sf0.1"


def missed(sample, s):
    miss = hit = 0
    for k in range(2):
        train, rest = sample[k::2], sample[1 - k :: 2]
        scores = Scorer(Trainer([t for t, _ in train], [y for _, y in train], s).fit(), s).scores([t for t, _ in rest])
        miss += sum(y == 1 and p < 0.5 for (_, y), p in zip(rest, scores))
        hit += sum(y == 0 and p >= 0.5 for (_, y), p in zip(rest, scores))
    return miss, hit


def test_two_folds(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    sample = training_sample(docs, labels, Settings())
    toxic = sum(y for _, y in sample)
    miss, hit = missed(sample, Settings())
    weak, _ = missed(sample, replace(Settings(), decay=1e-6))
    assert miss < 0.3 * toxic and miss < 0.8 * weak and hit < 0.02 * (len(sample) - toxic)


def test_choice(spark):
    """Of two decays, one of which leaves nothing learnt, the fit takes the other."""
    sample = [(f"fine words number{i % 7}", 0) if i % 4 < 2 else (f"awful zork{i % 5} words", 1) for i in range(40)]
    best, means = chosen(sample, [replace(Settings(), buckets=1 << 12, decay=d) for d in (1e3, 3e-5)], 2)
    assert best.decay == 3e-5 and means[1] == max(means)
