"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, free_name, unique_ids

#: A word is a run of letters and digits of the lower-cased text.
_GAP = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once and not anew for every element of an inner array."""
    return F.transform(F.array(value), body)[0]


def _windows(w: Column, size: int, each: Callable[[Column], Column], kind: str) -> Column:
    starts = F.sequence(F.lit(0), F.size(w) - size)
    return F.when(F.size(w) >= size, F.transform(starts, each)).otherwise(F.array().cast(f"array<{kind}>"))


def _strings(w: Column, size: int) -> Column:
    return _windows(w, size, lambda i: F.array_join(F.slice(w, i + 1, size), " "), "string")


def _hashes(w: Column, size: int) -> Column:
    return _windows(w, size, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]), "bigint")


def item_shingles(text: Column, size: int) -> Column:
    """The distinct shingles of ``size`` words; of fewer words the whole item is the one shingle. None
    for an item without words."""

    def of(w: Column) -> Column:
        whole = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) < size, whole).otherwise(F.array_distinct(_strings(w, size)))

    return _let(words(text), of)


def text_shingles(text: Column, sizes: list[int], windows: Callable[[Column, int], Column] = _strings) -> Column:
    """The distinct shingles of each of ``sizes`` words, or their hashes."""
    return _let(words(text), lambda w: F.array_distinct(F.concat(*[windows(w, k) for k in sizes])))


def _hash(shingle: Column, size: int) -> Column:
    """The hash of a shingle's words, which are ``size`` or fewer."""

    def of(w: Column) -> Column:
        found = F.xxhash64(*[F.get(w, F.lit(k)) for k in range(size)])
        for n in range(size - 1, 0, -1):
            found = F.when(F.size(w) == n, F.xxhash64(*[F.get(w, F.lit(k)) for k in range(n)])).otherwise(found)
        return found

    return _let(F.split(shingle, " "), of)


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item, size_class, least, hash): the bottom-k MinHash sketch of each item.

    Items are partitioned by size (classes of powers of two). A class sets k: a text that holds
    ``threshold`` of an item's n shingles lacks at most n - ceil(threshold * n), so among any one
    more than that at least one is found. k is that number for the largest n of the class (or all
    of them), and the search then misses nothing. It also sets ``least``, the shingles that a text must
    have to hold ``threshold`` of the smallest item that the class may have: shorter texts pass it over."""
    bottom, top = F.pow(F.lit(2), F.col("size_class")), F.pow(F.lit(2), F.col("size_class") + 1) - 1
    k = F.least(F.col("n_item"), top - F.ceil(F.lit(threshold) * top) + 1).cast("int")
    return (
        items.withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))
        .withColumn("sketch", F.slice(F.array_sort("hashes"), 1, k))
        .withColumn("least", F.ceil(F.lit(threshold) * bottom))
        .select("item", "size_class", "least", F.explode("sketch").alias("hash"))
    )


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every document and item where the
    document holds at least ``threshold`` of the item's distinct shingles of ``size`` words.

    Items with equal shingles are searched as one. The items' sketches, by size class (see
    ``sketches``), meet the shingles of whole documents of any length that are large enough for the
    class. Candidates take their item's shingles, and those that the document holds are counted: no step
    pairs documents with items that are no candidates.

    An item with fewer than ``size`` words is one shingle, its whole text, which documents must hold in
    a row. Items without words match nothing, and so do null texts. Rows that share a doc_id (or an
    item_id) count as one text with the shingles of all of them; null ids are an id of their own. Empty
    tables give an empty result; other columns are not read."""
    work = Workspace(docs.sparkSession, "decontamination")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = (
        items.select(F.col(item_id_col).cast("long").alias("item_id"), F.explode(item_shingles(F.col(item_text_col), size)).alias("s"))
        .groupBy("item_id")
        .agg(F.array_sort(F.collect_set("s")).alias("shingles"))
    )
    own = work.save(own.withColumn("item", F.sha2(F.array_join("shingles", "\n"), 256)), "items")
    sets = own.groupBy("item").agg(F.first("shingles").alias("shingles")).withColumn("n_item", F.size("shingles"))
    sets = sets.withColumn("hashes", F.transform("shingles", lambda s: _hash(s, size)))
    sets = work.save(sets, "sets")
    sketch = work.save(sketches(sets, threshold), "sketches")
    lengths = sets.select(F.explode("shingles").alias("s")).select(F.size(F.split("s", " ")).alias("k")).distinct()
    sizes = sorted(r.k for r in lengths.collect()) or [size]  # at most ``size`` lengths

    hashed = texts.withColumn("hs", text_shingles(F.col("text"), sizes, _hashes)).withColumn("n_doc", F.size("hs").cast("long"))
    if not unique_ids(texts, "doc_id"):
        sums = hashed.groupBy(F.col("doc_id").alias("d")).agg(F.sum("n_doc").alias("n_doc"))
        hashed = hashed.drop("n_doc").join(sums, F.col("doc_id").eqNullSafe(F.col("d")))
    met = (
        hashed.select("doc_id", "n_doc", F.explode("hs").alias("h"))
        .join(sketch, (F.col("h") == F.col("hash")) & (F.col("n_doc") >= F.col("least")))
        .select("doc_id", "item")
        .distinct()
    )
    met = work.save(met, "candidates")

    wanted = met.select(F.col("doc_id").alias("d")).distinct()
    held = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    held = held.select(F.col("doc_id").alias("d"), F.explode(text_shingles(F.col("text"), sizes)).alias("t"))
    asked = met.join(sets.select("item", "n_item", F.explode("shingles").alias("s")), "item")
    shared = asked.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("s") == F.col("t")), "left_semi")
    found = shared.groupBy("doc_id", "item", F.col("n_item").cast("long").alias("n_item_shingles")).agg(F.count("*").alias("n_shared"))
    found = found.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_item_shingles")))
    return found.join(own.select("item", "item_id"), "item").select(
        "doc_id", "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold a benchmark item (see ``contained_items``); columns unchanged, whatever
    their names."""
    found = contained_items(docs, items, id_col=id_col, **options)
    work = Workspace(docs.sparkSession, "contaminated")
    (name,) = free_name(docs, "__gone")
    gone = work.save(found.select(F.col("doc_id").alias(name)).distinct(), "ids")
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_anti")
