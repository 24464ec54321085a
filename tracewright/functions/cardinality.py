from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def infer_cardinality(first: Column, second: Column) -> Column:
    """``1..1``, ``1..N``, ``N..1`` by the counts of two sides; anything else, zeros too, is ``N..M``."""
    one, many = lambda c: c == 1, lambda c: c > 1
    return (
        F.when(one(first) & one(second), "1..1")
        .when(one(first) & many(second), "1..N")
        .when(many(first) & one(second), "N..1")
        .otherwise("N..M")
    )
