"""Helpers shared by the training-data operators: shared storage, Arrow plumbing, word rules."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII space, tab, LF, VT, FF and CR. ``bytes.split()``
#: cuts at exactly these six, so UTF-8 bytes are split rather than str (which knows more spaces).
WORD_SPACE = " \t\n\r\x0b\x0c"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a
    temporary folder of this process serves a local master (tests, one machine); a cluster, whose
    executors could not see that folder, is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """A new folder below the shared one for the written tables of one operator call.

    ``save`` cuts the lineage: the table is written once, so a lost executor costs a re-read and
    never a recomputation of what came before. ``drop`` removes tables that nothing reads any more;
    the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write df and read it back. Its shuffle files go at once instead of at some later GC."""
        with shuffle_cleanup(self.spark):
            df.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """While this holds, a finished query's shuffle files are removed when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes in ``column`` (a longer row stands
    alone), so that the Python objects made from one run stay small."""
    data = batch.column(column)
    if len(data) == 0:
        return
    width = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(width):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start, len(data) - start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers that one task writes without being long at it.
ROWS = 1 << 20


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df by fewer tasks, to be written: three a core, and one for each million of about ``rows`` rows of
    a few numbers. For every file an executor without Hadoop's native library starts three processes (to
    set its mode), so small partitions with a file each cost more than their rows. A task takes its
    partitions one after the other, each by itself."""
    return df.coalesce(max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)))


def dealt_join(big: DataFrame, small: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """big (n rows) joined with small (one row a key). The rows of a key that has over a thousandth of
    big are dealt out; there are at most a thousand such keys, which are broadcast. ``key`` may not be null."""
    hot = big.groupBy(key).count().where(F.col("count") > max(n // 1000, 256)).select(key, F.lit(32).alias("__parts"))
    hot, parts = F.broadcast(hot), F.coalesce("__parts", F.lit(1))
    one = big.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(*big.columns), parts).cast("int"))
    two = small.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return one.drop("__parts").join(two.drop("__parts"), [key, "__part"], how).drop("__part")


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    """True if no id is null or repeated; reads the id column only."""
    n, ids = docs.agg(F.count("*"), F.countDistinct(F.col(id_col))).first()
    return n == ids


def free_name(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as keep it apart from docs' columns (which Spark
    may compare without regard to case)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(docs: DataFrame, work: Workspace, id_col: str, text_col: str, name: str = "__key") -> DataFrame:
    """docs with a column ``name``, a unique long in the order of the ids.

    Unique ids are their own keys. Otherwise (null or repeated ids) the rows are range-partitioned
    by id and text, written, and numbered in that order: nulls first, equal ids by their texts."""
    key = F.col(id_col).cast("long")
    if unique_ids(docs, id_col):
        return docs.withColumn(name, key)
    order = [key.asc_nulls_first(), F.col(text_col).asc_nulls_first()]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return work.save(ranged.withColumn(name, F.monotonically_increasing_id()), "keyed")
