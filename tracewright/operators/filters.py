"""Row filters. Each function gives an operator: a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Operator = Callable[[DataFrame], DataFrame]


def values_of(values: str | Iterable) -> list:
    """A bare string is one value, not a set of letters."""
    return [values] if isinstance(values, str) else list(values)


def keeps(condition: Column) -> Operator:
    """Rows for which the condition is true."""
    return lambda df: df.filter(condition)


def retains_activity_filter(names: str | Iterable[str]) -> Operator:
    return lambda df: df.filter(F.col("activity").isin(values_of(names)))


def excludes_activity_filter(names: str | Iterable[str]) -> Operator:
    return lambda df: df.filter(~F.coalesce(F.col("activity").isin(values_of(names)), F.lit(False)))


def _matches(df: DataFrame, attrs: str, name: str, values: list) -> Column:
    """The attribute is present and among the values. A column of this name serves as well as a map
    entry, and lets the scan skip all else."""
    if name in df.columns:
        return F.coalesce(F.col(name).isin(values), F.lit(False))
    entry = F.col(attrs)
    return F.coalesce(F.map_contains_key(entry, F.lit(name)) & entry[name].isin(values), F.lit(False))


def retains_on_event_attribute_equal_filter(name: str, values: str | Iterable) -> Operator:
    return lambda df: df.filter(_matches(df, "event_attrs", name, values_of(values)))


def excludes_on_event_attribute_equal_filter(name: str, values: str | Iterable) -> Operator:
    """Rows without the attribute stay."""
    return lambda df: df.filter(~_matches(df, "event_attrs", name, values_of(values)))


def retains_on_trace_attribute_equal_filter(name: str, values: str | Iterable) -> Operator:
    return lambda df: df.filter(_matches(df, "trace_attrs", name, values_of(values)))


def excludes_on_trace_attribute_equal_filter(name: str, values: str | Iterable) -> Operator:
    return lambda df: df.filter(~_matches(df, "trace_attrs", name, values_of(values)))
