"""Source divergence: how far the term shares of each source lie from those of every other source of a
language, and which terms set a source apart.

Every pair of groups is needed, so pairs are dealt out in two dimensions: the groups of a language are
cut into blocks, and the packed count vectors of a block go to each task (block, block) that needs
them. A task goes through the vocabulary in chunks and holds one chunk of two blocks at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..order import with_index
from .common import Workspace, slices

#: Fixed rule of the terms: ASCII letters (A-Z lower-cased) and all bytes of other characters; the rest parts them.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
UNIT = 1_000_000_000
_COUNTS = "lang string, source string, term string, n long, docs long"


def _stretches(text: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str, most: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group. A task adds
    up its own rows first and gives out what it has at about ``most`` terms, so that hot groups
    shrink before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                for a in range(0, len(terms), 20_000):
                    own = terms[a : a + 20_000]
                    columns = [pa.array(x, t) for x, t in (([lang] * len(own), pa.string()), ([source] * len(own), pa.string()), ([t.decode() for t in own], pa.string()), ([n[t] for t in own], pa.int64()), ([docs[t] for t in own], pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for part in (p for b in batches for p in slices(b, "text", 1 << 20)):
            for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for piece in _stretches(text.encode().translate(_LETTERS)):
                    terms = piece.split()
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
                size += len(n) - before
            if size >= most:
                yield from out()
                size = 0
        yield from out()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return rows.mapInArrow(run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 * size)), exact at any count."""
    dec = lambda c: c.cast("decimal(19,0)")
    top = F.lit(UNIT).cast("decimal(10,0)") * dec(n + 5)
    below = dec(total + 5 * size)
    return (F.lit(1) + F.call_function("div", top, below)).cast("long")


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays, with ``total`` = N + 5V: long division, three digits at a time."""
    found, rest = np.zeros(np.broadcast(n, total).shape, np.int64), n + 5
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // total
        rest = rest % total
    return found + 1


def source_divergence(
    docs: DataFrame,
    least_docs: int = 30,
    top: int = 50,
    block: int | None = None,
    chunk: int = 1 << 11,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source).

    ``pair`` rows: every other source of the language with the summed differences of all kept terms'
    smoothed shares. ``term`` rows: the ``top`` terms whose share is most above the language's. A
    language keeps the terms in at least ``least_docs`` of its documents.

    ``block`` groups make a block (by default so many that a language's groups make up to 32 blocks, 8
    to 128); about ``chunk`` terms make a chunk. A task holds one chunk of the vectors of two blocks,
    whatever the vocabulary. Counts are added up inside the tasks before they are shuffled, so neither a hot group nor a hot
    term meets in one task. The output has a row for every ordered pair of a language's sources.

    Null text, lang and source are read as ''. Groups without terms, and languages that keep none, have
    their pairs (all 0 without kept terms). Repeated documents count again; an empty table gives an empty
    result; other columns, and how the three are named, do not matter. Equal values are ranked by item in
    UTF-8 order. Long texts are cut into stretches between terms; what is held of one document are its
    distinct terms."""
    spark = docs.sparkSession
    work = Workspace(spark, "divergence")
    counts = work.save(term_counts(docs, lang_col, source_col, text_col), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    terms = work.save(kept.join(sizes, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / chunk)).cast("int")), "terms")
    inside = Window.partitionBy("lang", "chunk").orderBy("term")
    terms = terms.withColumn("place", (F.row_number().over(inside) - 1).cast("int"))
    rows = work.save(counts.join(terms, ["lang", "term"]).select("lang", "source", "chunk", "place", "term", "n", "lang_n", "v", "lang_total"), "kept")

    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source")))).distinct()
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = names.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = with_index(groups, "lang", "source", name="i")
    spread = groups.groupBy("lang").agg(F.min("i").alias("first"), F.count("*").alias("groups"))
    width = F.lit(block) if block else F.least(F.greatest(F.ceil(F.col("groups") / 32), F.lit(8)), F.lit(128))
    spread = spread.withColumn("width", width.cast("long")).withColumn("blocks", F.ceil(F.col("groups") / F.col("width")).cast("int"))
    groups = groups.join(spread, "lang").withColumn("place", F.col("i") - F.col("first"))
    groups = work.save(groups.withColumn("block", F.floor(F.col("place") / F.col("width")).cast("int")), "groups")

    pairs = _pair_values(rows, groups, terms)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    own = rows.join(groups.select("lang", "source", "total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    own = own.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    own = own.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(own.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _pair_values(rows: DataFrame, groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of groups of a language."""
    large = terms.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("size"))
    packed = rows.groupBy("lang", "source", "chunk").agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("counts"))
    packed = packed.join(large, ["lang", "chunk"]).join(groups.select("lang", "source", "place", "block", "blocks"), ["lang", "source"])
    none = lambda kind: F.lit(None).cast(kind)
    heads = groups.select("lang", "block", "blocks", F.lit(-1).alias("chunk"), "place", "source", "total", "v", none("int").alias("size"), none("array<int>").alias("places"), none("array<bigint>").alias("counts"))
    body = packed.select("lang", "block", "blocks", "chunk", "place", none("string").alias("source"), none("long").alias("total"), none("long").alias("v"), "size", "places", "counts")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    tiles = heads.unionByName(body).withColumn("other", F.explode(others))
    tiles = tiles.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("other", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: _Tile | None = None
        for batch in batches:
            lists = {k: batch.column(k) for k in ("places", "counts")}
            values = {k: c.flatten().to_numpy(zero_copy_only=False) for k, c in lists.items()}
            ends = np.cumsum([0, *(n or 0 for n in lists["places"].value_lengths().to_pylist())]).tolist()
            for r, a, b in zip(batch.drop_columns(list(lists)).to_pylist(), ends, ends[1:]):
                r |= {k: v[a:b] for k, v in values.items()}
                key = (r["lang"], r["a"], r["b"])
                if tile is None or tile.key != key:
                    if tile is not None:
                        yield from tile.rows()
                    tile = _Tile(key)
                tile.add(r)
        if tile is not None:
            yield from tile.rows()

    dealt = tiles.repartition("lang", "a", "b").sortWithinPartitions("lang", "a", "b", "chunk", "place")
    return dealt.mapInArrow(run, "lang string, source string, item string, value long")


class _Tile:
    """One block by one block: groups first, then chunk by chunk."""

    def __init__(self, key: tuple[str, int, int]) -> None:
        self.key = key
        self.heads: dict[int, dict] = {}
        self.chunk, self.size, self.seen = -1, 0, 0
        self.filled: dict[int, np.ndarray] = {}
        self.value: np.ndarray | None = None

    def add(self, r: dict) -> None:
        if r["chunk"] < 0:
            self.heads[r["place"]] = r
            return
        if self.value is None:
            self._open()
        if r["chunk"] != self.chunk:
            self._close()
            self.chunk, self.size = r["chunk"], r["size"]
        own = np.full(self.size, self.base[self.side[r["place"]]])
        own[r["places"]] = _shares(r["counts"].astype(np.int64), np.int64(self.total[self.side[r["place"]]]))
        self.filled[self.side[r["place"]]] = own

    def _open(self) -> None:
        self.order = sorted(self.heads)
        self.side = {place: k for k, place in enumerate(self.order)}
        heads = [self.heads[p] for p in self.order]
        self.block = np.array([h["block"] for h in heads])
        self.total = np.array([h["total"] + 5 * h["v"] for h in heads], np.int64)
        self.base = _shares(np.zeros(len(heads), np.int64), np.maximum(self.total, 1))
        self.value = np.zeros((len(heads), len(heads)), np.int64)
        _, a, b = self.key
        self.left, self.right = np.flatnonzero(self.block == a), np.flatnonzero(self.block == b)

    def _close(self) -> None:
        """Add the chunk that is held to all pairs of the tile."""
        if self.chunk < 0:
            return
        dense = np.repeat(self.base[:, None], self.size, 1)
        for k, own in self.filled.items():
            dense[k] = own
        for i in self.left.tolist():
            self.value[i, self.right] += np.abs(dense[self.right] - dense[i]).sum(1)
        self.seen += self.size
        self.filled.clear()
        self.chunk = -1

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.value is None:
            self._open()
        self._close()
        heads = [self.heads[p] for p in self.order]
        unseen = np.array([h["v"] for h in heads], np.int64) - self.seen  # terms that no group of the tile has
        lang, same = self.key[0], self.key[1] == self.key[2]
        out: list[tuple[str, str, str, int]] = []
        for i in self.left.tolist():
            for j in self.right.tolist():
                if i == j:
                    continue
                value = int(self.value[i, j]) + int(unseen[i]) * abs(int(self.base[i]) - int(self.base[j]))
                one, two = heads[i]["source"], heads[j]["source"]
                out.append((lang, one, two, value))
                if not same:
                    out.append((lang, two, one, value))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "item", "value"])
