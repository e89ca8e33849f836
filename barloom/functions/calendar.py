"""Calendar period keys, all as DATE columns holding the last day of the period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_end(d: str | Column) -> Column:
    return F.last_day(d)


def week_end(d: str | Column) -> Column:
    """Friday that closes the Saturday-to-Friday week of ``d``."""
    return F.next_day(F.date_sub(d, 1), "FRI")


def month_number(d: str | Column) -> Column:
    """Months on a continuous integer axis, for RANGE frames and month arithmetic."""
    return F.year(d) * 12 + F.month(d)


def months_before(d: str | Column, n: int) -> Column:
    """``d`` moved back ``n`` months, clipped to the end of a shorter month."""
    return F.add_months(d, -n)
