"""Sinks of one's own: rows become lines on executors, and a batch's lines are seen all at once or not at all."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


def _json(row: Row) -> str:
    return json.dumps(row.asDict(True), default=str, ensure_ascii=False)


class _Folder:
    """Parts lie in ``parts``; a batch's manifest in ``batches`` names those that count, and is put there by one
    rename. Any file system that Arrow opens by its path will do."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _open(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        for name in ("parts", "batches"):
            store.create_dir(posixpath.join(root, name))
        return store, root

    def put(self, rows: Iterator[Row], line: Callable[[Row], str]) -> Part:
        store, root = self._open()
        part = Part(uuid.uuid4().hex, 0)
        place = posixpath.join(root, "parts", part.name)
        try:
            with store.open_output_stream(place) as out:
                for row in rows:
                    out.write(line(row).encode() + b"\n")
                    part.rows += 1
        except BaseException:
            store.delete_file(place)
            raise
        return part

    def commit(self, parts: list[Part | None], batch: str) -> None:
        store, root = self._open()
        place = posixpath.join(root, "batches", batch)
        if store.get_file_info(place).type != fs.FileType.NotFound:
            return self.drop(parts)  # the batch was told before a restart; its first parts count
        staged = posixpath.join(root, "batches", f"_{batch}-{uuid.uuid4().hex}")
        with store.open_output_stream(staged) as out:
            out.write(json.dumps([p.name for p in parts if p is not None and p.rows]).encode())
        store.move(staged, place)

    def drop(self, parts: list[Part | None]) -> None:
        store, root = self._open()
        for part in parts:
            if part is not None:
                store.delete_file(posixpath.join(root, "parts", part.name))

    def counted(self) -> list[str]:
        store, root = self._open()
        found = []
        for info in sorted(store.get_file_info(fs.FileSelector(posixpath.join(root, "batches"))), key=lambda i: i.base_name):
            if not info.base_name.startswith("_"):
                with store.open_input_stream(info.path) as f:
                    found += json.loads(f.read())
        return [posixpath.join(self.path, "parts", name) for name in found]


def event_sink(name: str, line: Callable[[Row], str] = _json) -> type[DataSource]:
    """A data source class to write to, batch and streaming, with option ``path``: each task writes its rows
    as lines to a part of its own, and the driver then commits the batch by one manifest.

    A failed task takes its part away, a failed batch those of all its tasks; a batch that is tried again
    after a restart counts once, by its number. ``committed`` reads what counts."""

    class StreamWriter(DataSourceStreamWriter):
        def __init__(self, path: str) -> None:
            self.folder = _Folder(path)

        def write(self, iterator: Iterator[Row]) -> Part:
            return self.folder.put(iterator, line)

        def commit(self, messages: list, batchId: int) -> None:
            self.folder.commit(messages, f"{batchId:012d}")

        def abort(self, messages: list, batchId: int) -> None:
            self.folder.drop(messages)

    class Writer(DataSourceWriter):
        def __init__(self, path: str) -> None:
            self.folder = _Folder(path)

        def write(self, iterator: Iterator[Row]) -> Part:
            return self.folder.put(iterator, line)

        def commit(self, messages: list) -> None:
            self.folder.commit(messages, f"run-{uuid.uuid4().hex}")

        def abort(self, messages: list) -> None:
            self.folder.drop(messages)

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def streamWriter(self, schema, overwrite) -> StreamWriter:
            return StreamWriter(self.options["path"])

        def writer(self, schema, overwrite) -> Writer:
            return Writer(self.options["path"])

    return Sink


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches of a sink with JSON lines; uncommitted parts are not read."""
    parts = _Folder(path).counted()
    return spark.read.schema(schema).json(parts) if parts else spark.createDataFrame([], schema)
