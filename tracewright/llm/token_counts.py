"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .encoding import encoder


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, in the library's own tokens without any
    added ones. Arrow batches are cut into runs of about 1 MB of text, long texts at safe
    boundaries (see ``encoding``); only lengths leave the function.

    A null text counts as empty: no bytes, no tokens. Null and repeated ids are kept, one row each.
    An empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "count")
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                counts = enc.counts([t or "" for t in part.column(1).to_pylist()])
                size = pc.cast(pc.fill_null(pc.binary_length(part.column(1)), 0), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), size, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
