"""Quality rules on repetition inside a document, from a suffix array over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, slices

SYMBOLS = "#*$%&|<>"


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lengths shared by neighbours; entry k is for suffixes k - 1 and k) of an
    integer sequence, by prefix doubling.

    A rank is the first place of a suffix's group; only groups of several suffixes are sorted again.
    Ranks of every doubling are kept, and give the shared lengths from the largest power down."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    fresh = np.r_[True, symbols[order[1:]] != symbols[order[:-1]]]
    place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = place
    split = np.zeros(n, np.int64)  # neighbours share at least this many
    levels, size = [rank.copy()], 1
    single = fresh & np.r_[fresh[1:], True]
    active = np.flatnonzero(~single)
    while len(active):
        at = order[active]
        second = rank[np.minimum(at + size, n)]
        by = np.lexsort((second, rank[at])) if n >= 1 << 31 else np.argsort(rank[at] * (n + 1) + second + 1, kind="stable")
        at, second = at[by], second[by]
        order[active] = at
        own = rank[at]
        same_group = np.r_[False, own[1:] == own[:-1]]
        differs = np.r_[True, second[1:] != second[:-1]] | ~same_group
        split[active[same_group & differs]] = size
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(differs, active, 0))
        levels.append(rank)
        single = differs & np.r_[differs[1:], True]
        active = active[~single]
        size *= 2
    shared = split
    pairs = np.flatnonzero(split >= 2)
    if len(pairs):
        a, b, known = order[pairs - 1], order[pairs], split[pairs].copy()
        top = known.copy()
        for k in range(len(levels) - 1, -1, -1):
            step = 1 << k
            fits = step < top
            equal = fits & (levels[k][np.minimum(a + known, n)] == levels[k][np.minimum(b + known, n)])
            known[equal] += step
        shared[pairs] = known
    return order, shared


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For every position, the length of the longest sequence from there that also starts elsewhere."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    order, shared = suffix_array(symbols)
    out = np.empty(len(symbols), np.int64)
    out[order] = np.maximum(shared, np.r_[shared[1:], 0])
    return out


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """True at every position that some span covers."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, n_covered_words long"
)


def _measure(keys: pa.Array, texts: list[str], least: int) -> pa.RecordBatch:
    ids: list[int] = []
    counts, chars, symbols, dups = [], [], [], []
    for text in texts:
        words = text.encode().split()
        local: dict[bytes, int] = {}
        base = len(ids)
        ids.extend([local.setdefault(w, base + len(local)) for w in words])  # no symbol is in two documents
        counts.append(len(words))
        chars.append(len(text) - sum(map(text.count, WORD_SPACE)))
        symbols.append(sum(map(text.count, SYMBOLS)))
        seen, again = set(), 0
        for line in text.split("\n"):
            if line.strip(WORD_SPACE):
                if line in seen:
                    again += 1
                else:
                    seen.add(line)
        dups.append(again)
    repeat = longest_repeats(np.array(ids, np.int64))
    n, size = len(repeat), np.array(counts, np.int64)
    three = np.flatnonzero(repeat >= 3)
    in_three = covered(three, np.full(len(three), 3), n)
    # A span is maximal if the one from the position before does not hold it.
    held = np.r_[False, repeat[:-1] == repeat[1:] + 1] if n else np.zeros(0, bool)
    spans = np.flatnonzero((repeat >= least) & ~held)
    in_span = covered(spans, repeat[spans], n)
    at = np.r_[0, np.cumsum(size)]
    total = lambda mask: np.r_[0, np.cumsum(mask)][at[1:]] - np.r_[0, np.cumsum(mask)][at[:-1]]
    longest = np.zeros(len(size), np.int64)
    some = np.flatnonzero(size)
    if len(some):
        longest[some] = np.maximum.reduceat(repeat, at[:-1][some])
    columns = [size, chars, symbols, dups, total(in_three), longest, total(in_span)]
    return pa.RecordBatch.from_arrays(
        [keys, *(pa.array(np.asarray(c, np.int64)) for c in columns)], [f.split()[0] for f in RESULT.split(", ")]
    )


def repetition_rules(
    docs: DataFrame,
    min_repeat: int = 5,
    max_fraction: float = 0.3,
    max_longest: int = 60,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts and a verdict for every whole text.

    A suffix array over the words of a document (many documents are sorted together, with words of
    their own each) and its shared lengths give the maximal repeated word sequences. ``kept`` is
    false for a document that fails the base rules (fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` percent of them in repeated 3-word windows), whose repeated sequences of
    ``min_repeat`` words or more cover over ``max_fraction`` of its words, or whose longest one has
    over ``max_longest`` words.

    Null texts have no words and fail. Null and repeated ids are kept, one row each. An empty table
    gives an empty result; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, "text", 1 << 20)):
            yield _measure(part.column(0), [t or "" for t in part.column(1).to_pylist()], min_repeat)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, failed = F.col("n_words"), F.col("base_failed")
    return (
        rows.mapInArrow(run, RESULT)
        .withColumn("base_failed", (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n))
        .withColumn("kept", ~failed & (F.col("n_covered_words") <= max_fraction * n) & (F.col("longest_repeat") <= max_longest))
    )
