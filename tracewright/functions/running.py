"""Running values over the rows of a few keys, however many rows a key has.

A window over a key puts all its rows in one task. Here a key's rows are cut into ranges of the order
column: windows run inside the ranges, what each range hands on (its sum, minimum, last and first
values) is one row for each key and range, a second window runs over those, and its results are
joined back as carries. A task sees at most a range of one key, or the ranges of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written

#: Values of the order column that make a range.
RANGE = 1 << 20


def running(rows: DataFrame, keys: list[str], order: str | list[str], size: int = RANGE, **values: tuple[str, Column | str]) -> DataFrame:
    """rows with a column for each of ``values``, name=(kind, column), over the rows of equal keys in the
    given order. The order must be total within a key, its first column a long that few rows of a key share.

    Kinds: ``sum`` up to and with the row, ``before`` the sum ahead of it (0 at first), ``min`` the minimum up to and with
    it, ``last`` the last value that is not null up to and with the row, ``lag`` and ``lead`` the value
    of the row before and after. Null keys are a key of their own; without keys all rows are one."""
    order = [order] if isinstance(order, str) else order
    names = {name: f"__{kind}_{name}" for name, (kind, _) in values.items()}
    part = rows.withColumn("__key", F.struct(*keys) if keys else F.lit(0)).withColumn("__range", F.floor(F.col(order[0]) / size))
    part = part.withColumns({names[name]: F.col(c) if isinstance(c, str) else c for name, (_, c) in values.items()})
    inner = Window.partitionBy("__key", "__range").orderBy(*order)
    outer = Window.partitionBy("__key").orderBy("__range")
    place = F.struct(*order)
    handed, carried, local, final = [], {}, {}, {}
    for name, (kind, _) in values.items():
        own, value, carry = f"__own_{name}", F.col(names[name]), F.col(f"__carry_{name}")
        upto, past = (lambda w: w.rowsBetween(Window.unboundedPreceding, 0)), (lambda w: w.rowsBetween(Window.unboundedPreceding, -1))
        if kind in ("sum", "before"):
            local[own] = F.sum(value).over(upto(inner) if kind == "sum" else past(inner))
            handed.append(F.sum(value).alias(own))
            carried[f"__carry_{name}"] = F.sum(own).over(past(outer))
            final[name] = F.coalesce(F.col(own), F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif kind == "min":
            local[own] = F.min(value).over(upto(inner))
            handed.append(F.min(value).alias(own))
            carried[f"__carry_{name}"] = F.min(own).over(past(outer))
            final[name] = F.least(F.col(own), carry)
        elif kind == "last":
            local[own] = F.last(value, ignorenulls=True).over(upto(inner))
            handed.append(F.max_by(value, F.when(value.isNotNull(), place)).alias(own))
            carried[f"__carry_{name}"] = F.last(own, ignorenulls=True).over(past(outer))
            final[name] = F.coalesce(F.col(own), carry)
        elif kind in ("lag", "lead"):
            step, best = (F.lag, F.max_by) if kind == "lag" else (F.lead, F.min_by)
            held = F.struct(value.alias("v"))
            local[own] = step(held).over(inner)
            handed.append(best(held, place).alias(own))
            carried[f"__carry_{name}"] = step(own).over(outer)
            final[name] = F.coalesce(F.col(own), carry)["v"]
        else:
            raise ValueError(f"no running value is called {kind}")
    # Both sides of the join come from here, so what is behind is run once.
    part = written(part.withColumns({f"__here_{name}": c for name, c in zip(values, local.values())}), "running", lean=True)
    ranges = part.groupBy("__key", "__range").agg(*handed).withColumns(carried).select("__key", "__range", *carried)
    out = part.join(ranges, ["__key", "__range"]).withColumns({own: F.col(f"__here_{name}") for name, own in zip(values, local)})
    return out.withColumns(final).select(*[c for c in rows.columns if c not in values], *values)


def as_of(left: DataFrame, right: DataFrame, on: str, keys: list[str] | None = None, size: int = RANGE, **values: str) -> DataFrame:
    """left with the values of the newest row of ``right`` whose ``on`` is at most its own (null where there
    is none), name=column of right. Both sides have ``on`` and the keys; of right, no two rows of a
    key share an ``on``. Nothing is paired: the sides are put in one order, and values are handed on."""
    keys = keys or []
    held = F.struct(*(F.col(c).alias(name) for name, c in values.items()))
    newer = right.select(*keys, on, held.alias("__held"), F.lit(0).alias("__side"), F.lit(0).cast("long").alias("__id"))
    kind = newer.schema["__held"].dataType
    older = left.select(*keys, on, F.lit(None).cast(kind).alias("__held"), F.lit(1).alias("__side"), F.monotonically_increasing_id().alias("__id"), F.struct(*left.columns).alias("__row"))
    both = older.unionByName(newer.withColumn("__row", F.lit(None).cast(older.schema["__row"].dataType)))
    found = running(both, keys, [on, "__side", "__id"], size, __held=("last", "__held"))
    rows = found.where("__side = 1").select("__row.*", "__held")
    return rows.select(*(c for c in left.columns if c not in values), *(F.col("__held")[name].alias(name) for name in values))
