"""Null-safe arithmetic, guarded rolling windows and exact percentile ranks."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def change(a: Column, b: Column) -> Column:
    """a / b - 1, null where b is zero."""
    return F.try_divide(a, b) - 1


def last_rows(n: int, by: str = "symbol", order: str = "session_no") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)


def up_to_here(by: str = "symbol", order: str = "session_no") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def guarded(value: Column, counted: Column, n: int, over: WindowSpec) -> Column:
    """A rolling value that needs n non-null inputs in its window."""
    return F.when(F.count(counted).over(over) == n, value)


def rolling(kind: str, x: Column, n: int, over: WindowSpec | None = None) -> Column:
    """Guarded rolling mean, sum, min, max or population deviation of x over n rows."""
    over = over or last_rows(n)
    f = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop}[kind]
    return guarded(f(x).over(over), x, n, over)


def lagged(x: Column, n: int, by: str = "symbol", order: str = "session_no") -> Column:
    return F.lag(x, n).over(Window.partitionBy(by).orderBy(order))


def rank_pct(x: str, by: list[str]) -> Column:
    """Average rank over the number of non-null values of the partition; null stays null."""
    # one order, so one sort, serves all three
    ordered = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    ties = F.count(x).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    n = F.count(x).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(F.col(x).isNotNull(), (F.rank().over(ordered) + (ties - 1) / 2) / n)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in pairs]))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(x, F.lit(low))))
