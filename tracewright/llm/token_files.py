"""Token-id files: whole documents in ascending order, coded with a shared table (see ``rans``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, shuffle_cleanup, slices
from .encoding import encoder
from .rans import Block, Decoder, Frequencies, encode_blocks

#: One row of ``blocks``: ``part`` and ``block`` order the file; ``doc_ids``/``has_id``/``sizes`` list the
#: whole documents in it; the rest is the coded block with its checkpoints and checksum.
BLOCKS = (
    "part long, block long, before long, n long, lanes int, every int, doc_ids binary, has_id binary, sizes binary, "
    "states binary, places binary, words binary, check long"
)
_TYPES = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()] * 6 + [pa.int64()]


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes that hold every id on the way to the files: 2 for vocabularies of up to 65536, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(True), end_id + 1) <= 1 << 16 else 4


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text and ``end_id``, little-endian, ``width`` bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer, "ids", width), np.array([end_id], f"<u{width}").tobytes()
        for part in (p for b in batches for p in slices(b, "text", 1 << 20)):
            made = [data + tail for data in enc.ids([t or "" for t in part.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def frequencies(ids: DataFrame, width: int) -> Frequencies:
    """Counts of all ids of all rows; one row for each id and task is shuffled, and the driver gets
    one for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in (p for b in batches for p in slices(b, "ids")):
            own = np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), f"<u{width}"), minlength=len(total))
            own[: len(total)] += total
            total = own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return Frequencies.of(np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.int64))


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    block_ids: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text, append ``end_id`` and write all ids in ascending order of the document
    ids to the folder ``path``: ``table`` (the shared frequencies), ``blocks`` (about ``block_ids`` ids
    each, whole documents, every one decodable alone) and ``parts`` (ids before each part).

    Documents are dealt by ranges of ids, so a range is a task's work whatever the source; memory is
    bounded by a few blocks or one document. A lost task is coded again as a whole.

    Null texts hold ``end_id`` only. Null ids come first; rows of one id are ordered by a hash of
    their ids, and every row is a document of its own. An empty table gives empty files; other
    columns are not read."""
    spark = docs.sparkSession
    work = Workspace(spark, "token-files")
    width = id_width(tokenizer, end_id)
    ids = work.save(token_ids(docs, tokenizer, end_id, width, id_col, text_col), "ids")
    table = frequencies(ids, width)
    spark.createDataFrame(
        [(int(s), int(f), table.bits) for s, f in zip(table.symbols, table.share)], "symbol long, share long, bits int"
    ).coalesce(1).write.parquet(f"{path}/table")
    held = spark.sparkContext.broadcast(table)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        done: list[tuple[list, list[np.ndarray]]] = []
        keys: list = []
        rows: list[np.ndarray] = []
        size = total = 0

        def out() -> pa.RecordBatch:
            nonlocal block, before, total
            columns: list[list] = [[] for _ in _TYPES]
            coded = encode_blocks([np.concatenate(r) for _, r in done], held.value)
            for (own, r), b in zip(done, coded):
                row = (
                    part, block, before, b.n, b.lanes, b.every,
                    np.array([k or 0 for k in own], "<i8").tobytes(), np.array([k is not None for k in own], np.uint8).tobytes(),
                    np.array([len(x) for x in r], "<i8").tobytes(), b.states.astype("<u8").tobytes(),
                    b.places.astype("<i8").tobytes(), b.words.astype("<u4").tobytes(), b.check,
                )
                for c, v in zip(columns, row):
                    c.append(v)
                block, before = block + 1, before + b.n
            done.clear()
            total = 0
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _TYPES)], [f.split()[0] for f in BLOCKS.split(", ")]
            )

        for piece in (p for b in batches for p in slices(b, "ids")):
            for key, data in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                keys.append(key)
                rows.append(np.frombuffer(data, f"<u{width}"))
                size += len(rows[-1])
                if size >= block_ids:
                    done.append((keys, rows))
                    keys, rows, total, size = [], [], total + size, 0
                    if total >= 8 * block_ids:
                        yield out()
        if rows:
            done.append((keys, rows))
        if done:
            yield out()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids").asc()]
    ranged = ids.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    with shuffle_cleanup(spark):
        ranged.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    work.drop("ids")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    ends = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each task of the writing
    first = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends.select("part", first.alias("first")).coalesce(1).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files of ``write_token_files``; start
    counts the ids of all documents before it. Blocks are decoded in parallel and each is held
    against its checksum."""
    rows = spark.read.parquet(f"{path}/table").collect()
    table = Frequencies(np.array([r.symbol for r in rows], np.int64), np.array([r.share for r in rows], np.int64), rows[0].bits if rows else 12)
    order = np.argsort(table.symbols)
    held = spark.sparkContext.broadcast(Frequencies(table.symbols[order], table.share[order], table.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for piece in (p for b in batches for p in slices(b, "words", 1 << 20)):
            col = {n: piece.column(n).to_pylist() for n in piece.schema.names}
            blocks = [
                Block(
                    n, lanes, every, np.frombuffer(states, "<u8").reshape(-1, lanes), np.frombuffer(places, "<i8"),
                    np.frombuffer(words, "<u4"), check,
                )
                for n, lanes, every, states, places, words, check in zip(*(col[k] for k in "n lanes every states places words check".split()))
            ]
            keys, starts, sizes, data = [], [], [], []
            for k, ids in enumerate(decoder.decode(blocks)):
                own = np.frombuffer(col["sizes"][k], "<i8")
                ends = np.cumsum(own)
                has = np.frombuffer(col["has_id"][k], np.uint8)
                keys += [i if h else None for i, h in zip(np.frombuffer(col["doc_ids"][k], "<i8").tolist(), has.tolist())]
                starts += (ends - own + col["before"][k] + (col["first"][k] or 0)).tolist()
                sizes += own.tolist()
                raw = ids.astype("<u4").tobytes()
                data += [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), own.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (keys, starts, sizes)), pa.array(data, pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"],
            )

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    joined = blocks.join(spark.read.parquet(f"{path}/parts"), "part")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
