"""The arrival index: every order-sensitive operator reads ``n``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count as count_from

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .workspace import written


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Rows of the table of runs up to which ``numbered_within`` counts where rows are.
MOST_RUNS = 100_000


def with_index(df: DataFrame, *order: str | Column, name: str = "n", ranged: bool = False, lean: bool = False) -> DataFrame:
    """df with ``name`` = 1, 2, ... in the given order (which should be total).

    Rows are range-partitioned and sorted, and numbered within each partition; the partitions'
    sizes (one row each) are summed up and joined back. No task holds more than a range. With ``ranged``
    df's partitions are ranges of that order already; ``lean`` is that of ``written``."""
    parts = (df if ranged else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    rows = written(parts.withColumn("__at", F.monotonically_increasing_id()), "index", lean)
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("__part")).count()
    sizes = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    # One row for each task of the write, so it may be broadcast.
    numbered = rows.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    inner = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, F.col("__before") + inner + 1).drop("__part", "__at", "__before")


def last_index(df: DataFrame, name: str = "n") -> int:
    return df.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]


def _counted(key: str, order: list[str]) -> Batches:
    """Rows with a number for their run and key (of no other task), their place among the run's rows of equal key, and whether they
    are the run's first or the batch's last of these. A run goes on while the first number stays, and the second rises, or the first
    goes up by one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, parts = None, {}, count_from(TaskContext.get().partitionId() << 32)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            places = [column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in order]
            a, b = places[0], places[1] if len(places) > 1 else np.zeros(batch.num_rows, np.int64)
            before = (a[0] - 2, 0) if last is None else last
            step = np.diff(a, prepend=before[0])
            stage = np.cumsum(~((step == 1) | ((step == 0) & (np.diff(b, prepend=before[1]) > 0))))
            coded = column(key).dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            joint = stage * len(names) + codes
            by = np.argsort(joint.astype(np.uint16) if joint.max() < 1 << 16 else joint, kind="stable")
            heads = np.flatnonzero(np.diff(joint[by], prepend=-1))
            sizes = np.diff(heads, append=len(by))
            stages, own = joint[by][heads] // len(names), joint[by][heads] % len(names)
            # A run that goes on keeps its keys' numbers and counts; any other begins them.
            known = [seen.get(names[k], (None, 0)) if s == 0 else (None, 0) for s, k in zip(stages, own)]
            run = [next(parts) if r is None else r for r, _ in known]
            upto = [c + int(size) for (_, c), size in zip(known, sizes)]
            rank, part, edge = np.empty(len(by), np.int64), np.empty(len(by), np.int64), np.zeros(len(by), bool)
            rank[by] = np.arange(1, len(by) + 1) - np.repeat(heads, sizes) + np.repeat([c for _, c in known], sizes)
            part[by] = np.repeat(run, sizes)
            edge[by[heads + sizes - 1]] = True
            edge |= rank == 1
            if stage[-1] > 0:
                seen = {}
            seen |= {names[k]: (r, c) for s, k, r, c in zip(stages, own, run, upto) if s == stage[-1]}
            last = (a[-1], b[-1])
            marks = {"__run": part, "__rank": rank, "__edge": edge}
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, marks.values())], [*batch.schema.names, *marks])

    return count


def numbered_within(df: DataFrame, key: str, *order: str, name: str = "n", made: tuple[Batches, StructType] | None = None) -> DataFrame:
    """df with ``name`` = 1, 2, ... among the rows of equal ``key``, in the order of a log's own numbers and, where
    rows share one, of a second column. Rows without a key are left out. ``made`` tells what to make of df's rows
    first, task by task, and the columns that gives.

    Rows read from a table written in order come in runs of numbers without a gap. Each task counts within its
    runs, and a row for each run and key tells how many went before, so no row is moved. Where the runs are
    many or overlap, rows in no order that is, these are numbered by key and order first."""
    make, schema = made or (None, df.schema)
    if make is None:
        df = df.where(F.col(key).isNotNull())
    count = _counted(key, list(order))
    marks = [StructField("__run", LongType()), StructField("__rank", LongType()), StructField("__edge", BooleanType())]
    rows = df.mapInArrow(count if make is None else lambda batches: count(make(batches)), StructType([*schema.fields, *marks]))
    rows = written(rows, "runs", lean=True)
    place = F.struct(*order)
    sizes = rows.where("__edge").groupBy("__run", key).agg(F.max("__rank").alias("__size"), F.min(place).alias("__first"), F.max(place).alias("__last"))
    sizes = written(sizes, "sizes")
    by = Window.partitionBy(key).orderBy("__first")  # over MOST_RUNS rows at most
    few = sizes.count() <= MOST_RUNS and sizes.withColumn("__past", F.lag("__last").over(by)).where("__past >= __first").isEmpty()
    if not few:
        found = with_index(rows.select(*schema.names), key, *order, name="__i", lean=True)
        first = found.groupBy(key).agg(F.min("__i").alias("__first"))
        return found.join(first, key).withColumn(name, F.col("__i") - F.col("__first") + 1).drop("__i", "__first")
    before = F.sum("__size").over(by.rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("__run", F.coalesce(before, F.lit(0)).alias("__before"))
    found = rows.join(F.broadcast(bases), "__run")
    return found.withColumn(name, F.col("__before") + F.col("__rank")).select(*schema.names, name)
