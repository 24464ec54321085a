"""Toxicity scores: bags of subword embeddings, averaged, into a linear softmax; trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import Rolling
from .common import free_name, slices
from .dealing import mix

_EDGE = ".,;:!?\"'()[]{}|*"


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the training sample (half for each label, as far as there are so many), and
    ``most_words`` the distinct words learnt from one text: a text with more gives stretches spread
    evenly over the whole of it, so no labelled text is left out for its length. Both bound the
    driver's memory. Everything else covers all data. ``neutral`` subwords that say nothing join every
    average, so that a short stretch is not judged by one word; ``toxic_share`` is the weight of all
    toxic rows together in training. ``stretch`` and ``toxic_share`` were picked by ``chosen``, which
    looks at training rows only. ``decay`` pulls embeddings to 0; of ``decays`` every fit takes the one
    that does best over two folds of its own sample, as what is right depends on the table (with none
    given, ``decay`` holds)."""

    buckets: int = 1 << 17
    size: int = 4
    grams: tuple[int, int] = (3, 5)
    stretch: int = 8
    neutral: int = 60
    toxic_share: float = 0.4
    decay: float = 3e-5
    decays: tuple[float, ...] = (3e-5, 1e-4)
    most_rows: int = 3000
    most_words: int = 4000
    steps: int = 50
    rate: float = 0.1
    seed: int = 11


def subwords(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every word and of each of its character n-grams, with marks for its
    ends; sorted by word."""
    marked = [f"<{w.strip(_EDGE)}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), "<u4").astype(np.uint64) + np.uint64(1)
    size = np.array([len(m) for m in marked], np.int64)
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(codes))
    found, which = [Rolling(codes).at(start, size)], [np.arange(len(words))]
    for n in range(s.grams[0], s.grams[1] + 1):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + codes[at + k]
        found.append(mix(h))
        which.append(word[at])
    which, found = np.concatenate(which), np.concatenate(found)
    order = np.argsort(which, kind="stable")
    return which[order], (found[order] % np.uint64(s.buckets)).astype(np.int64)


def _words(text: str) -> list[str]:
    """The distinct words in the order they come: a word said many times says no more."""
    return list(dict.fromkeys(text.lower().split()))


def _spread(words: list[str], s: Settings) -> list[str]:
    """At most about ``most_words`` of the words, in stretches spread evenly over all of them."""
    count, keep = -(-len(words) // s.stretch), max(1, s.most_words // s.stretch)
    if count <= keep:
        return words
    firsts = [i * count // keep * s.stretch for i in range(keep)]
    return [w for f in firsts for w in words[f : f + s.stretch]]


def _sums(values: np.ndarray, index: np.ndarray, at: np.ndarray, room: int = 1 << 17) -> np.ndarray:
    """Sums of ``values[index]`` over the ranges that begin at ``at``, of which about ``room`` rows are
    laid out at once."""
    cuts = np.unique(np.r_[0, np.searchsorted(at, np.arange(room, len(index), room)), len(at)])
    ends = np.r_[at, len(index)]
    return np.concatenate(
        [np.add.reduceat(values[index[ends[i] : ends[j]]], at[i:j] - ends[i], axis=0) for i, j in zip(cuts, cuts[1:])]
    )


class Trainer:
    """Embeddings and softmax weights, learnt together.

    A document is cut into stretches of words; the vector of a stretch is the average of its
    subwords' embeddings. At first all words of a document are one stretch, then its most toxic
    stretch stands for it, so that a few words show in a long text."""

    def __init__(self, texts: list[str], labels: list[int], s: Settings) -> None:
        self.s = s
        vocabulary: dict[str, int] = {}
        ids, lengths = [], []
        for t in texts:
            w = _words(t) or [""]
            ids.extend([vocabulary.setdefault(x, len(vocabulary)) for x in w])
            lengths.append(len(w))
        known, which, sub = list(vocabulary), [], []
        for i in range(0, len(known), 1 << 13):
            w, b = subwords(known[i : i + (1 << 13)], s)
            which.append((w + i).astype(np.int32))
            sub.append(b.astype(np.int32))
        which, self.sub = np.concatenate(which), np.concatenate(sub)
        self.sub_len = np.bincount(which, minlength=len(vocabulary))
        self.sub_at = np.cumsum(self.sub_len) - self.sub_len
        self.word = np.array(ids, np.int32)
        self.doc_len = np.array(lengths, np.int64)
        self.label = np.array(labels, np.float64)
        by_bucket = np.argsort(self.sub, kind="stable").astype(np.int32)
        self.sub_word = which[by_bucket]
        buckets = self.sub[by_bucket]
        self.bucket_at = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        self.used = buckets[self.bucket_at]
        self.by_word = np.argsort(self.word, kind="stable").astype(np.int32)
        self.word_at = np.searchsorted(self.word[self.by_word], np.arange(len(vocabulary)))

    def _stretches(self, size: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(first word of every stretch, its document)."""
        if size is None:
            return np.cumsum(self.doc_len) - self.doc_len, np.arange(len(self.doc_len))
        count = -(-self.doc_len // size)
        doc = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        return (np.cumsum(self.doc_len) - self.doc_len)[doc] + inner * size, doc

    def fit(self) -> np.ndarray:
        """The weight of every bucket (its embedding times the difference of the two softmax rows),
        and the bias as the last entry."""
        s, rng = self.s, np.random.default_rng(self.s.seed)
        table = rng.normal(0, 0.1, (s.buckets, s.size)).astype(np.float32)
        weight, bias = rng.normal(0, 0.1, (s.size, 2)).astype(np.float32), np.zeros(2, np.float32)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table[self.used], weight, bias)]
        share = np.where(self.label == 1, s.toxic_share / max(1, self.label.sum()), (1 - s.toxic_share) / max(1, (1 - self.label).sum()))
        for step in range(1, s.steps + 1):
            at, doc = self._stretches(None if step <= s.steps // 3 else s.stretch)
            words = _sums(table, self.sub, self.sub_at)
            total = _sums(words, self.word, at)
            count = (_sums(self.sub_len, self.word, at) + s.neutral)[:, None].astype(np.float32)
            hidden = total / count
            logits = hidden @ weight + bias
            gap = logits[:, 1] - logits[:, 0]
            order = np.lexsort((gap, doc))
            top = order[np.r_[doc[order][1:] != doc[order][:-1], True]]  # the most toxic stretch of each
            p = 1 / (1 + np.exp(-gap[top]))
            error = (p - self.label) * share
            d_logits = np.stack([-error, error], axis=1)
            d_weight, d_bias = hidden[top].T @ d_logits + 1e-5 * weight, d_logits.sum(0)
            d_stretch = np.zeros_like(hidden)
            d_stretch[top] = ((d_logits @ weight.T) / count[top]).astype(np.float32)
            place = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.r_[at, len(self.word)]))
            d_word = _sums(d_stretch, place[self.by_word], self.word_at)
            d_table = _sums(d_word, self.sub_word, self.bucket_at)
            part = table[self.used]
            d_table += s.decay * part
            for p_, g, m in zip((part, weight, bias), (d_table, d_weight, d_bias), moments):
                m[0][:] = 0.9 * m[0] + 0.1 * g
                m[1][:] = 0.999 * m[1] + 0.001 * g * g
                p_ -= s.rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
            table[self.used] = part
        # Buckets that no training word has say nothing.
        seen = np.zeros(s.buckets, bool)
        seen[self.used] = True
        slope = weight[:, 1] - weight[:, 0]
        return np.r_[np.where(seen, table @ slope, 0.0), bias[1] - bias[0]]


class Scorer:
    """Scores with one weight per bucket; sums of words met before are kept."""

    def __init__(self, weights: np.ndarray, s: Settings, most_words: int = 200_000) -> None:
        self.weights, self.s, self.most_words = weights, s, most_words
        self._at: dict[str, int] = {}
        self._sums = np.zeros((1 << 16, 2))

    def _learn(self, words: list[str]) -> None:
        base = len(self._at)
        while base + len(words) > len(self._sums):
            self._sums = np.concatenate([self._sums, np.zeros_like(self._sums)])
        which, bucket = subwords(words, self.s)
        self._sums[base : base + len(words), 0] = np.bincount(which, self.weights[bucket], len(words))
        self._sums[base : base + len(words), 1] = np.bincount(which, minlength=len(words))
        self._at.update(zip(words, range(base, base + len(words))))

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self._at) > self.most_words:
            self._at.clear()
        known = self._at
        rows = [_words(t) or [""] for t in texts]
        new = {w for r in rows for w in r if w not in known}
        if new:
            self._learn(list(new))
        places = [p for r in rows for p in map(known.__getitem__, r)]
        counts = [len(r) for r in rows]
        if not texts:
            return np.zeros(0)
        size = np.array(counts)
        parts = -(-size // self.s.stretch)
        doc = np.repeat(np.arange(len(size)), parts)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = (np.cumsum(size) - size)[doc] + inner * self.s.stretch
        sums = np.add.reduceat(self._sums[places], at, axis=0)
        gap = sums[:, 0] / (sums[:, 1] + self.s.neutral) + self.weights[-1]
        best = np.maximum.reduceat(gap, np.cumsum(parts) - parts)
        return 1 / (1 + np.exp(-np.clip(best, -700, 700)))


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels are never learnt from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> list[tuple[str, int]]:
    """Texts and labels of at most about ``most_rows`` documents that are not held out, by a hash of
    their ids, half for each label. Only the chosen ids are sent to the documents' scan, and only
    distinct words, one text for each id (of repeated ids the least), come back."""
    own = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
    own = own.where(F.col("__toxic").isin(0, 1) & ~held_out(F.col("__id"))).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    count = {r["__toxic"]: r["count"] for r in own.groupBy("__toxic").count().collect()}
    part = F.pmod(F.xxhash64("__id"), F.lit(1_000_000))
    keep = F.lit(False)
    for label, n in count.items():
        keep = keep | ((F.col("__toxic") == label) & (part < int(1_000_000 * min(1.0, s.most_rows / 2 / n))))
    # The sample is bounded by most_rows, so it may be broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").where("text IS NOT NULL")
    rows = texts.join(F.broadcast(own.where(keep)), "__id").select("__id", "text", "__toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (p for b in batches for p in slices(b, "text")):
            words = pa.array([" ".join(_spread(_words(t), s)) for t in p.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([p.column(0), words, p.column(2)], ["__id", "text", "__toxic"])

    rows = rows.mapInArrow(run, rows.schema).groupBy("__id", "__toxic").agg(F.min("text").alias("text")).collect()
    return [(r.text, r["__toxic"]) for r in sorted(rows, key=lambda r: r["__id"])]


def chosen(sample: list[tuple[str, int]], candidates: list[Settings], folds: int = 3) -> tuple[Settings, list[float]]:
    """The candidate with the best mean accuracy (of both labels alike) over folds of a training sample,
    each scored by weights learnt from the others; and all means."""
    means = []
    for s in candidates:
        right = {0: [], 1: []}
        for k in range(folds):
            train, rest = ([x for i, x in enumerate(sample) if (i % folds == k) == own] for own in (False, True))
            scorer = Scorer(Trainer([t for t, _ in train], [y for _, y in train], s).fit(), s)
            for (_, y), score in zip(rest, scorer.scores([t for t, _ in rest])):
                right[y].append((score >= 0.5) == y)
        means.append(float(np.mean([np.mean(r) for r in right.values() if r])))
    return candidates[int(np.argmax(means))], means


def fitted(docs: DataFrame, labels: DataFrame, settings: Settings) -> np.ndarray:
    """The weights, learnt on the driver from the bounded sample, with the decay chosen inside it (which needs
    two rows of each label in each fold)."""
    sample = training_sample(docs, labels, settings)
    if len({y for _, y in sample}) == 2:
        rare = [[y for _, y in sample[k::2]].count(label) for k in (0, 1) for label in (0, 1)]
        if settings.decays and min(rare) >= 2:
            settings, _ = chosen(sample, [replace(settings, decay=d) for d in settings.decays], 2)
        return Trainer([t for t, _ in sample], [y for _, y in sample], settings).fit()
    weights = np.zeros(settings.buckets + 1)
    weights[-1] = 1.0 if sample and sample[0][1] else -1e-9 if not sample else -1.0
    return weights


def with_scores(docs: DataFrame, weights: np.ndarray, settings: Settings, name: str) -> DataFrame:
    """docs with the score of every whole ``text`` as a last column."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # its size is fixed
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    kept: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Scorer(shared.value.astype(np.float64), settings))
        for part in (p for b in batches for p in slices(b, "text", 1 << 20)):
            score = kept[0].scores([t or "" for t in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], schema.names)

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text: the probability that it is toxic.

    The model is learnt on the driver from a bounded sample (see ``Settings``) of labelled rows that
    are not held out; texts alone are its input. A document's score is that of its most toxic
    stretch of words, so length does not thin it.

    Words are taken from whole texts of any length. Null and empty texts get the score of no words. Null ids are held out; repeated rows get equal
    scores. Labels other than 0 and 1 are left out. With no labels at all the score is 0.5 less a
    little (predicted 0). An empty table gives an empty result; other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_scores(rows, fitted(docs, labels, settings), settings, "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), limit: float = 0.5) -> DataFrame:
    """docs without those that score ``limit`` or more (see ``toxicity``); columns unchanged. Null and
    empty texts stay, as no word speaks against them."""
    (name,) = free_name(docs, "__score")
    scored = with_scores(docs, fitted(docs, labels, settings), settings, name)
    silent = F.coalesce(F.length(F.trim(F.col("text"))) == 0, F.lit(True))
    return scored.where((F.col(name) < limit) | silent).drop(name)
