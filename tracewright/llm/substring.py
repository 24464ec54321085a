"""Removal of word sequences that repeat anywhere in the corpus, by level-wise doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import Rolling, covered, open_segments
from .common import Workspace, free_name, keyed, slices
from .dealing import ITEMS, RUNS, answer, ask, by_key, grouped, numbers, parts_of
from .words import windows, word_values


def _levels(gram: int, window: int) -> list[int]:
    out = [gram]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def level_items(batches: Iterator[pa.RecordBatch], length: int, shift: int, last: bool, parts: int, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """``ITEMS`` of the candidates (runs p, n >> shift of window starts) of (key, text, p, n) rows: codes of the
    ``length`` words from each start; on the ``last`` level x is a second, independent code."""
    held, count = [], 0
    for part in (s for b in batches for s in slices(b, "text", 1 << 20)):
        keys, (first, size) = np.asarray(part.column(0), np.int64), ([numbers(d) for d in part.column(c).to_pylist()] for c in "pn")
        own = np.repeat(np.arange(len(keys)), [len(r) for r in first])
        *values, bounds = word_values(part.column("text").to_pylist(), *((0, 1) if last else (0,)))
        at, doc, p = windows(bounds, own, np.concatenate(first), np.concatenate(size) >> shift)
        codes = [Rolling(v).at(at, length) for v in values]
        held.append((codes[0], keys[doc], p, codes[-1] if last else np.zeros(len(at), np.uint64)))
        count += len(at)
        if count >= most:
            yield ask(*(np.concatenate(c) for c in zip(*held)), parts, last)
            held, count = [], 0
    if count:
        yield ask(*(np.concatenate(c) for c in zip(*held)), parts, last)


def repeated_windows(texts: DataFrame, work: Workspace, window: int, gram: int) -> DataFrame:
    """``SPANS`` of all windows of ``window`` words of (__key, text) that also start elsewhere.

    Level one looks at ``gram`` words: a window none of whose anchors (see ``anchors``) occurs again
    cannot repeat. Of all other windows, the first ``2 * gram`` words are looked at, then twice as
    many, up to ``window``; at each level only candidates whose words are met again go on. Codes of
    64 bits decide who goes on, where a chance match costs nothing but work; the last level, which
    decides what is removed, wants two independent ones equal.

    A level is one shuffle of packed codes and one of surviving runs by document. A passage of many
    documents sends one item for each lot of half a million to the task of its code."""
    parts, lengths = parts_of(texts.sparkSession), _levels(gram, window)[1:]
    alive = work.save(open_segments(texts, word_values, gram, window), "level-0")
    for k, length in enumerate(lengths):
        last = k == len(lengths) - 1

        def told(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            key, p, _ = answer(batches, last)
            yield from by_key(key, p, np.ones(len(p), np.int64), parts)

        rows = texts.join(alive.hint("merge"), "__key").select("__key", "text", "p", "n")
        items = rows.mapInArrow(lambda b, n=length, shift=0 if k else 16, last=last: level_items(b, n, shift, last, parts), ITEMS)
        runs = items.repartitionById(parts, "part").mapInArrow(told, RUNS)
        alive = work.save(grouped(runs, parts, True), f"level-{k + 1}")
        work.drop(f"level-{k}")
    return alive


def drop_repeated_words(
    docs: DataFrame, window: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_words", "n_removed")
) -> DataFrame:
    """docs with every word removed that lies in a window of ``window`` words whose words also start
    anywhere else, in the same document or another; kept words are joined by single spaces. Adds
    the numbers of words and of removed words, named by ``counts`` (columns of docs with these names are replaced).

    Words are runs of characters other than the six ASCII spaces, unchanged. Windows are judged on
    the input. Null texts have no words and become empty; null and repeated ids are allowed, each
    row is a document of its own, so the words of repeated rows of ``window`` words or more all go.
    A text of any length is one row and fits in a task. Other columns, whatever their names, are
    kept. An empty table gives an empty result."""
    work = Workspace(docs.sparkSession, "substring")
    docs = docs.drop(*counts)
    key, p, n = free_name(docs, "__key", "__p", "__n")
    own = keyed(docs, work, id_col, text_col, key)
    texts = own.select(F.col(key).alias("__key"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"))
    spans = repeated_windows(texts, work, window, gram).toDF(key, p, n)
    schema = T.StructType(
        [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema]
        + [T.StructField(c, T.LongType()) for c in counts]
    )
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for b in batches for s in slices(b, text_col)):
            texts, sizes, gone = [], [], []
            for text, first, size in zip(*(part.column(c).to_pylist() for c in (text_col, p, n))):
                words = (text or "").encode().split()
                sizes.append(len(words))
                if first is not None:
                    kept, last = [], 0
                    for a, b in covered(numbers(first), numbers(size), window):
                        kept += words[last:a]
                        last = b
                    words = kept + words[last:]
                gone.append(sizes[-1] - len(words))
                texts.append(b" ".join(words).decode())
            arrays = [part.column(i) for i in range(len(schema) - 2)] + [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return own.join(spans.hint("merge"), key, "left").select(*docs.columns, p, n).mapInArrow(cut, schema)
