"""A fluent handle on an event log."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.filters import Operator
from ..operators.windows import take


class EventLog:
    """A DataFrame with an arrival index ``n``; every method gives a new log, and nothing runs before a
    result is asked for. ``df`` is the way out."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @classmethod
    def of(cls, spark: SparkSession, *rows: tuple, schema: str = "value long") -> EventLog:
        return cls.from_iterable(spark, rows, schema)

    @classmethod
    def from_iterable(cls, spark: SparkSession, rows, schema: str = "value long") -> EventLog:
        items = [(i + 1, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        return cls(spark.createDataFrame(items, f"n long, {schema}"))

    @classmethod
    def empty(cls, spark: SparkSession, schema: str = "value long") -> EventLog:
        return cls.from_iterable(spark, [], schema)

    def pipe(self, *operators: Operator) -> EventLog:
        return EventLog(reduce(lambda df, op: op(df), operators, self.df))

    def filter(self, condition: Column | Callable[[DataFrame], Column]) -> EventLog:
        return EventLog(self.df.filter(condition(self.df) if callable(condition) else condition))

    def map(self, **columns: Column) -> EventLog:
        return EventLog(self.df.withColumns(columns))

    def map_not_null(self, name: str, value: Column) -> EventLog:
        """Adds a column and drops the rows where it is null."""
        return EventLog(self.df.withColumn(name, value).filter(F.col(name).isNotNull()))

    def flat_map(self, name: str, array: Column) -> EventLog:
        return EventLog(self.df.withColumn(name, F.explode(array)))

    def map_batches(self, function: Callable, schema: str) -> EventLog:
        """A Python function from an iterator of pandas frames to another, for what columns cannot say."""
        return EventLog(self.df.mapInPandas(function, schema))

    def map_with_state(self, step: Callable, schema: str) -> EventLog:
        """A map with a state of its own for each case: ``step(state, event)`` gives the next state and a
        list of rows (tuples of ``schema``); the state is None at first. Events come in the order of
        ``n``, a case is one task's work. Rows carry case_id ahead of the new columns."""
        names = [f.split()[0] for f in schema.split(",")]
        kind = self.df.schema["case_id"].dataType.simpleString()

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            state, out = None, []
            for event in pdf.itertuples(index=False):
                state, rows = step(state, event)
                out += [(event.case_id, *r) for r in rows]
            return pd.DataFrame(out, columns=["case_id", *names])

        ordered = self.df.withColumn("__n", F.row_number().over(Window.partitionBy("case_id").orderBy("n")))
        return EventLog(ordered.groupBy("case_id").applyInPandas(lambda p: run(p.sort_values("__n")), f"case_id {kind}, {schema}"))

    def tap(self, name: str, *metrics: Column) -> EventLog:
        """Passes rows through and reports metrics about them (see ``DataFrame.observe``)."""
        return EventLog(self.df.observe(name, *metrics))

    def merge(self, *others: EventLog, order: str = "ts") -> EventLog:
        """Interleaved by time; ties by the order of the logs."""
        from ..order import with_index

        return EventLog(with_index(_union(self, others).drop("n"), order, "__source", "__n").drop("__source", "__n"))

    def concat(self, *others: EventLog) -> EventLog:
        """All of this log, then the others one after another."""
        from ..order import with_index

        return EventLog(with_index(_union(self, others).drop("n"), "__source", "__n").drop("__source", "__n"))

    def share(self) -> EventLog:
        return EventLog(self.df.persist())

    def publish(self) -> tuple[EventLog, Connectable]:
        return self, Connectable(self.df)

    def take(self, k: int) -> EventLog:
        return self.pipe(take(k))

    def all_match(self, condition: Column) -> bool:
        """True on an empty log."""
        return self.df.filter(~F.coalesce(condition, F.lit(False))).isEmpty()

    def find_first(self, condition: Column | None = None):
        rows = self.df if condition is None else self.df.filter(condition)
        return next(iter(rows.orderBy("n").limit(1).collect()), None)

    find_any = find_first

    def to_list(self) -> list:
        return self.df.orderBy("n").collect()

    def sink(self, consume: Callable, close: Callable[[], None] | None = None) -> None:
        """Hands the rows to ``consume`` in order, one at a time, then closes. For small results; large
        ones are written with ``df.write``."""
        self.subscribe(consume, on_end=close)

    def subscribe(
        self, on_next: Callable, on_error: Callable | None = None, on_completed: Callable | None = None, on_end: Callable | None = None
    ) -> None:
        """Rows in order to ``on_next``; then ``on_completed``, or ``on_error`` with what went wrong (which
        is raised where no handler is given); ``on_end`` in either case."""
        try:
            for row in self.df.orderBy("n").toLocalIterator():
                on_next(row)
            if on_completed:
                on_completed()
        except Exception as e:
            if on_error is None:
                raise
            on_error(e)
        finally:
            if on_end:
                on_end()

    def print_sink(self, fmt: Callable = str) -> None:
        self.sink(lambda row: print(fmt(row)))


def _union(first: EventLog, others: tuple) -> DataFrame:
    parts = [log.df.withColumn("__n", F.col("n")).withColumn("__source", F.lit(i)) for i, log in enumerate([first, *others])]
    return reduce(DataFrame.unionByName, parts)


class Connectable:
    """Starts a streaming log's query when asked to."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.query = df, None

    def connect(self, each_batch: Callable[[DataFrame, int], None], **options):
        self.query = self.df.writeStream.options(**options).foreachBatch(each_batch).start()
        return self.query

    def disconnect(self) -> None:
        if self.query is not None:
            self.query.stop()

    @property
    def is_connected(self) -> bool:
        return self.query is not None and self.query.isActive
