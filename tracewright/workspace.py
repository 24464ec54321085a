"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files when the query ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_stages = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder of this process, with a local
    master only: executors elsewhere could not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Passing:
    """Tables written inside go at its end, but for those written by ``keep``: for steps whose own tables nobody
    reads once their result is written. What is kept belongs to the next stage around, if there is one."""

    def __enter__(self) -> Passing:
        self.paths: list[tuple[SparkSession, str]] = []
        self.around = getattr(_stages, "now", None)
        _stages.now = self
        return self

    def __exit__(self, *_) -> None:
        _stages.now = self.around
        for spark, path in self.paths:
            _delete(spark, path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        _stages.now = self.around
        try:
            return written(df, name, lean=True)
        finally:
            _stages.now = self


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """df, written once and read back: what follows never runs the plan behind it again, and a lost
    executor costs a re-read. The files go when the driver ends, or the ``Passing`` they were written in.
    ``lean`` is for large tables: packed closely (numbers as differences), the shuffles behind it removed at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    stage = getattr(_stages, "now", None)
    if stage is not None:
        stage.paths.append((spark, path))
    if lean:
        with _set(spark, CLEANUP, "true"):
            df.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
