"""Sources of one's own: a Python generator of events as a data source, batch and streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def event_source(
    name: str, schema: str, produce: Callable[[int, int], Iterable[tuple]], shards: int = 1, step: int = 1000, newest: Callable[[], int] | None = None
) -> type[DataSource]:
    """A data source class: ``produce(start, stop)`` gives the rows with these offsets (fewer at the
    end), always on executors. Batch reads option ``stop`` rows in ``shards`` partitions. A stream goes up to
    ``newest()``, which the driver asks before every micro-batch (without it, option ``stop``), and reads
    what is new in partitions of ``step`` offsets; the checkpoint keeps the offset, so a restart reads each
    row once. Register it with ``spark.dataSource.register``."""

    class Shard(InputPartition):
        def __init__(self, start: int, stop: int) -> None:
            self.start, self.stop = start, stop

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.stop = int(options.get("stop", 0))

        def partitions(self) -> list[Shard]:
            edges = [self.stop * i // shards for i in range(shards + 1)]
            return [Shard(a, b) for a, b in zip(edges, edges[1:])]

        def read(self, partition: Shard) -> Iterable[tuple]:
            yield from produce(partition.start, partition.stop)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict) -> None:
            self.stop_at = int(options.get("stop", 0))

        def initialOffset(self) -> dict:
            return {"at": 0}

        def latestOffset(self) -> dict:
            return {"at": self.stop_at if newest is None else newest()}

        def partitions(self, start: dict, end: dict) -> list[Shard]:
            return [Shard(a, min(a + step, end["at"])) for a in range(start["at"], end["at"], step)]

        def read(self, partition: Shard) -> Iterable[tuple]:
            yield from produce(partition.start, partition.stop)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> Reader:
            return Reader(self.options)

        def streamReader(self, schema) -> StreamReader:
            return StreamReader(self.options)

    return Source


def read(spark: SparkSession, source: type[DataSource], **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()
