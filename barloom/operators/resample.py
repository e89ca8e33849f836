"""Calendar resampling: last value per period on a dense calendar, last row per period.

The month or week key is aggregated first (partial results per map task), so an asset's series has
one row per period before the window that fills the calendar sees it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.functions.frames import PERIODIC, Series, ffill, lag_return

STEP = {"month": "interval 1 month", "week": "interval 7 days"}


def period_key(freq: str, d: str | Column = "d") -> Column:
    return calendar.month_end(d) if freq == "month" else calendar.week_end(d)


def last_valid(df: DataFrame, freq: str, values: Sequence[str], s: Series = Series()) -> DataFrame:
    """Last non-missing value of each column per period that has rows."""
    (day,) = s.order
    return df.groupBy(*s.keys, period_key(freq, day).alias("period_end")).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(day))).alias(v) for v in values]
    )


def dense(df: DataFrame, freq: str, values: Sequence[str], s: Series = PERIODIC) -> DataFrame:
    """Add an all-missing row for every period between the first and last one of a series.

    Each row emits itself and the empty periods up to its successor, so no calendar join is needed.
    """
    following = F.lead("period_end").over(s.rows)
    if freq == "month":
        start, stop = F.trunc("period_end", "MM"), F.add_months(F.trunc(following, "MM"), -1)
    else:
        start, stop = F.col("period_end"), F.date_sub(following, 7)
    span = F.sequence(start, F.coalesce(stop, start), F.expr(STEP[freq]))
    rows = df.withColumn("_span", span).select("*", F.posexplode("_span").alias("_gap", "_at"))
    at = F.last_day("_at") if freq == "month" else F.col("_at")
    return rows.select(
        *s.keys, at.alias("period_end"),
        *[F.when(F.col("_gap") == 0, F.col(v)).alias(v) for v in values],
    )


def resample_last(df: DataFrame, freq: str, values: Sequence[str], s: Series = Series()) -> DataFrame:
    """Dense calendar of last non-missing values, month end or week ending Friday."""
    return dense(last_valid(df, freq, values, s), freq, values, Series(s.keys, "period_end"))


def last_row(df: DataFrame, freq: str, s: Series = Series()) -> DataFrame:
    """Last physical row of each period, missing cells included; no rows for empty periods."""
    keyed = df.withColumn("period_end", period_key(freq, s.order[0]))
    latest = Window.partitionBy(*s.keys, "period_end").orderBy(*[F.desc(c) for c in s.order])
    return keyed.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") == 1).drop("_rank")


def period_returns(bars: DataFrame, freq: str = "month", price: str = "adj_close",
                   s: Series = Series()) -> DataFrame:
    """Close-to-close return per period.

    Months stay dense and a month without a price returns 0 (the price is carried); weeks without a
    price are left out, so the next return spans the gap.
    """
    p = Series(s.keys, "period_end")
    if freq == "week":
        weeks = last_valid(bars, "week", [price], s).filter(F.col(price).isNotNull())
        return weeks.withColumn("ret", lag_return(price, p))
    months = resample_last(bars, "month", [price], s)
    return months.withColumn("_held", ffill(price, p)).withColumn("ret", lag_return("_held", p)).drop("_held")
