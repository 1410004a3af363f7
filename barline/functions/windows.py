"""Windows over panels. Every one carries its order: rows of a panel have none of their own."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol(*extra: str) -> WindowSpec:
    """Rows of one symbol in time order."""
    return Window.partitionBy(*extra, "symbol").orderBy("datetime")


def rolling(n: int, spec: WindowSpec | None = None) -> WindowSpec:
    """The last n rows, this one included."""
    return (spec or by_symbol()).rowsBetween(1 - n, 0)


def cumulative(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, 0)


def full(column: Column, value: Column, n: int, spec: WindowSpec) -> Column:
    """value where the window holds n non-null values of column; null while it warms up."""
    return F.when(F.count(column).over(spec) == n, value)


def filled(column: Column, spec: WindowSpec, backward: bool = True) -> Column:
    """The last known value; before the first one, with backward, the first to come. Only rows before a
    partition's first value lack a last known one, and what comes to them is that first value: one frame of the
    whole partition gives it, in one pass over the rows."""
    forward = F.last(column, ignorenulls=True).over(cumulative(spec))
    if not backward:
        return forward
    return F.coalesce(forward, F.first(column, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days between two timestamps, rounded down; not the difference of the calendar dates."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / F.lit(86_400_000_000)).cast("long")
