"""Row-frame functions over an ordered series.

A ``Series`` names the key columns and the ordering of a panel. Every function here takes one and
returns a Column, so that all frames over the same series share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import as_col, excess_ratio, ratio


class Series:
    def __init__(self, keys: Sequence[str] = ("asset",), order: str | Sequence[str] = "d"):
        self.keys = tuple(keys)
        self.order = (order,) if isinstance(order, str) else tuple(order)

    @property
    def rows(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def reversed(self):
        return Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order])

    def last(self, n: int):
        return self.rows.rowsBetween(-(n - 1), 0)

    def next(self, n: int):
        return self.rows.rowsBetween(1, n)

    @property
    def so_far(self):
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def before(self):
        return self.rows.rowsBetween(Window.unboundedPreceding, -1)


DAILY = Series(("asset",), "d")
PERIODIC = Series(("asset",), "period_end")


def lag(c: str | Column, s: Series, n: int = 1) -> Column:
    return F.lag(as_col(c), n).over(s.rows)


def lead(c: str | Column, s: Series, n: int = 1) -> Column:
    return F.lead(as_col(c), n).over(s.rows)


def diff(c: str | Column, s: Series, n: int = 1) -> Column:
    return as_col(c) - lag(c, s, n)


def lag_return(c: str | Column, s: Series, n: int = 1) -> Column:
    """c / c[n rows ago] - 1. Forward fill ``c`` first for the padded variant."""
    return excess_ratio(as_col(c), lag(c, s, n))


def ffill(c: str | Column, s: Series) -> Column:
    return F.last(as_col(c), ignorenulls=True).over(s.so_far)


def rolling(agg: Callable[[Column], Column], c: str | Column, n: int, s: Series,
            min_periods: int | None = None) -> Column:
    """``agg`` over the last n rows, missing until ``min_periods`` values are in the frame."""
    c = as_col(c)
    frame = s.last(n)
    need = n if min_periods is None else min_periods
    return F.when(F.count(c).over(frame) >= need, agg(c).over(frame))


def rolling_mean(c, n: int, s: Series) -> Column:
    return rolling(F.avg, c, n, s)


def rolling_std(c, n: int, s: Series) -> Column:
    return rolling(F.stddev_samp, c, n, s)


def rolling_sum(c, n: int, s: Series) -> Column:
    return rolling(F.sum, c, n, s)


def rolling_max(c, n: int, s: Series, min_periods: int | None = None) -> Column:
    return rolling(F.max, c, n, s, min_periods)


def zscore(c: str | Column, n: int, s: Series) -> Column:
    return ratio(as_col(c) - rolling_mean(c, n, s), rolling_std(c, n, s))


def growth(r: str | Column, s: Series) -> Column:
    """Running product of 1 + r: the equity curve of one unit."""
    return F.product(F.lit(1.0) + as_col(r)).over(s.so_far)


def running_max(c: str | Column, s: Series) -> Column:
    return F.max(as_col(c)).over(s.so_far)


def forward_growth(r: str | Column, h: int, s: Series) -> Column:
    """Return compounded over the next h rows, missing when fewer than h follow."""
    r = as_col(r)
    frame = s.next(h)
    full = F.count(r).over(frame) == h
    return F.when(full, F.product(F.lit(1.0) + r).over(frame) - F.lit(1.0))
