"""Walk-forward folds, training-window statistics, scaling and class weights.

A fold never materialises its training rows: bounds are arithmetic on row positions, and statistics over
training rows are window frames that end before the test row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.functions.frames import PERIODIC, Series
from barloom.functions.scalars import as_col, recode


def with_position(df: DataFrame, s: Series = PERIODIC) -> DataFrame:
    """Row position from 0 and row count of each series."""
    return df.withColumns({
        "pos": (F.row_number().over(s.rows) - 1).cast("bigint"),
        "n_rows": F.count(F.lit(1)).over(Window.partitionBy(*s.keys)),
    })


def with_kfold(df: DataFrame, k: int = 5, s: Series = PERIODIC) -> DataFrame:
    """Expanding k-fold split: the fold a row is tested in, and where that fold's test block starts.

    Blocks have floor(n / (k + 1)) rows and end at the last row; rows before the first block are only
    ever trained on and get no fold.
    """
    df = with_position(df, s)
    size = F.floor(F.col("n_rows") / (k + 1))
    first = F.col("n_rows") - size * k
    fold = F.when((F.col("pos") >= first) & (size > 0),
                  F.floor(F.try_divide(F.col("pos") - first, size)) + 1)
    return df.withColumn("fold", fold.cast("bigint")).withColumn(
        "test_lo", (first + (F.col("fold") - 1) * size).cast("bigint"))


def kfold_table(df: DataFrame, k: int = 5, s: Series = PERIODIC) -> DataFrame:
    """One row per series and fold: position bounds of training and test rows and the test dates."""
    folds = with_kfold(df, k, s).filter(F.col("fold").isNotNull())
    at = s.order[-1]
    return folds.groupBy(*s.keys, "fold").agg(
        F.lit(0).cast("bigint").alias("train_lo"), (F.min("pos") - 1).alias("train_hi"),
        F.min("pos").alias("test_lo"), F.max("pos").alias("test_hi"),
        F.min(at).alias("test_from"), F.max(at).alias("test_to"),
    )


def rolling_folds(df: DataFrame, window: int = 60, s: Series = PERIODIC) -> DataFrame:
    """Each row from position ``window`` on is tested on the ``window`` rows before it."""
    at = s.order[-1]
    return with_position(df, s).withColumns({
        "train_lo": F.col("pos") - window, "train_hi": F.col("pos") - 1,
        "train_from": F.lag(at, window).over(s.rows), "train_to": F.lag(at, 1).over(s.rows),
    }).filter(F.col("pos") >= window)


def expanding_folds(df: DataFrame, min_train: int = 60, s: Series = PERIODIC) -> DataFrame:
    """Each row from position ``min_train`` on is tested on everything before it."""
    at = s.order[-1]
    return with_position(df, s).withColumns({
        "train_lo": F.lit(0).cast("bigint"), "train_hi": F.col("pos") - 1,
        "train_from": F.first(at).over(s.so_far), "train_to": F.lag(at, 1).over(s.rows),
    }).filter(F.col("pos") >= min_train)


def _calendar_frames(s: Series, years: int):
    """The two month ranges that ``[t - years, t - 1 month]`` can mean on month-end stamps.

    Going back a month from the end of a shorter month misses the end of the longer one before it, so
    the last training month is then one earlier.
    """
    months = Window.partitionBy(*s.keys).orderBy("_month")
    reaches = F.dayofmonth("period_end") >= F.dayofmonth(F.last_day(F.add_months("period_end", -1)))
    return months.rangeBetween(-12 * years, -1), months.rangeBetween(-12 * years, -2), reaches


def over_calendar(agg: Column, s: Series = PERIODIC, years: int = 5) -> Column:
    """``agg`` over the calendar training window of a row; the data needs the ``_month`` number."""
    near, far, reaches = _calendar_frames(s, years)
    return F.when(reaches, agg.over(near)).otherwise(agg.over(far))


def calendar_folds(df: DataFrame, years: int = 5, min_rows: int = 24, s: Series = PERIODIC) -> DataFrame:
    """Rows whose training window ``[t - years, t - 1 month]`` holds at least ``min_rows`` rows."""
    keyed = df.withColumn("_month", calendar.month_number("period_end"))
    return keyed.withColumns({
        "train_start": F.add_months("period_end", -12 * years),
        "train_end": F.add_months("period_end", -1),
        "n_train": over_calendar(F.count(F.lit(1)), s, years),
        "train_from": over_calendar(F.min("period_end"), s, years),
        "train_to": over_calendar(F.max("period_end"), s, years),
    }).filter(F.col("n_train") >= min_rows).drop("_month")


def training_stats(df: DataFrame, value: str, s: Series = PERIODIC, window: int = 60, years: int = 5) -> DataFrame:
    """Row count and mean of ``value`` over the expanding, trailing and calendar training windows."""
    trailing = s.rows.rowsBetween(-window, -1)
    keyed = df.withColumn("_month", calendar.month_number("period_end"))
    count, mean = F.count(value), F.avg(value)
    return keyed.withColumns({
        "n_expanding": count.over(s.before), "mean_expanding": mean.over(s.before),
        "n_trailing": count.over(trailing), "mean_trailing": mean.over(trailing),
        "n_calendar": over_calendar(count, s, years), "mean_calendar": over_calendar(mean, s, years),
    }).drop("_month")


def nonzero(scale: str | Column) -> Column:
    """A scale to divide by: constant features are only centred."""
    scale = as_col(scale)
    return F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def expanding_scale(df: DataFrame, features: Sequence[str], min_train: int = 60, s: Series = PERIODIC) -> DataFrame:
    """Standardise each row by the mean and population deviation of the rows before it."""
    df = with_position(df, s)
    return df.withColumns({
        f"z_{c}": (F.col(c) - F.avg(c).over(s.before)) / nonzero(F.stddev_pop(c).over(s.before))
        for c in features
    }).filter(F.col("pos") >= min_train)


def fold_scale(df: DataFrame, features: Sequence[str], k: int = 5, s: Series = PERIODIC) -> DataFrame:
    """Standardise the test rows of each k-fold block by the rows before the block.

    The training statistics of a block are the running ones at its first row, carried over the block.
    """
    df = with_kfold(df, k, s)
    block = Window.partitionBy(*s.keys, "fold").orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
    staged = df.withColumns({
        **{f"_m_{c}": F.avg(c).over(s.before) for c in features},
        **{f"_d_{c}": F.stddev_pop(c).over(s.before) for c in features},
    }).filter(F.col("fold").isNotNull())
    out = staged.withColumns({
        f"z_{c}": (F.col(c) - F.first(f"_m_{c}").over(block)) / nonzero(F.first(f"_d_{c}").over(block))
        for c in features
    })
    return out.drop(*[f"_{k}_{c}" for k in "md" for c in features])


def robust_scale(df: DataFrame, features: Sequence[str], window: int = 60, s: Series = PERIODIC) -> DataFrame:
    """Scale each row by the exact median and quartile range of the ``window`` rows before it."""
    trailing = s.rows.rowsBetween(-window, -1)
    df = with_position(df, s).withColumns({
        f"_q_{c}": F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(trailing)
        for c in features
    }).filter(F.col("pos") >= window)
    return df.withColumns({
        f"z_{c}": (F.col(c) - F.col(f"_q_{c}")[1]) / nonzero(F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0])
        for c in features
    }).drop(*[f"_q_{c}" for c in features])


def balanced_weights(df: DataFrame, label: str, classes: Mapping[str, str], over) -> DataFrame:
    """Weight of every class over a training frame: n / (classes present * class count).

    ``classes`` maps a label value to its output column; ``over`` is the window frame.
    """
    hits = {out: F.count(F.when(F.col(label) == value, 1)).over(over) for value, out in classes.items()}
    staged = df.withColumns({f"_c_{out}": h for out, h in hits.items()})
    counts = [F.col(f"_c_{out}") for out in classes.values()]
    present = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    total = sum(counts, F.lit(0))
    staged = staged.withColumns({"_present": present, "_total": total})
    return staged.withColumns({
        out: F.try_divide(F.col("_total"), F.col("_present") * F.col(f"_c_{out}")) for out in classes.values()
    }).drop("_present", "_total", *[f"_c_{out}" for out in classes.values()])


def label_codes(df: DataFrame, label: str, fixed: Mapping[str, int]) -> DataFrame:
    """Distinct labels with their alphabetical code, their fixed code and their count."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy(F.lit(0)).orderBy(label)
    return counts.withColumns({
        "alphabetical_code": (F.row_number().over(ordered) - 1).cast("bigint"),
        "fixed_code": recode(label, fixed).cast("bigint"),
    })
