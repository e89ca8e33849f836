"""Row frames over very long series, cut into blocks that overlap by the frames' reach.

A daily series is short, and a window partitioned by asset is the cheapest plan for it. Where one key may
hold too many rows for a task, rows are numbered from per-year counts, cut into blocks of consecutive rows,
and the last rows of each block are copied in front of the next one. Every block is then a window group of
bounded size, and frames that reach no further back than the copied rows see exactly what they would see in
the whole series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import Series


def number_rows(df: DataFrame, s: Series, out: str = "row_nr") -> DataFrame:
    """Row number from 1: the rows of earlier years plus the position inside the year."""
    (day,) = s.order
    keyed = df.withColumn("_year", F.year(day))
    per_year = keyed.groupBy(*s.keys, "_year").agg(F.count(F.lit(1)).alias("_rows"))
    years = Series(s.keys, "_year")
    offsets = per_year.select(
        *s.keys, "_year", F.coalesce(F.sum("_rows").over(years.before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*s.keys, "_year").orderBy(day)
    numbered = keyed.withColumn("_inside", F.row_number().over(inside)).join(offsets, [*s.keys, "_year"])
    return numbered.withColumn(out, F.col("_offset") + F.col("_inside")).drop("_year", "_inside", "_offset")


def in_blocks(df: DataFrame, s: Series, reach: int, frames: Callable[[DataFrame, Series], DataFrame],
              rows: int = 4096, row_nr: str = "row_nr") -> DataFrame:
    """Apply ``frames(df, series)`` block by block.

    ``frames`` may use row frames and lags that look back at most ``reach`` rows in total; ``df`` must
    carry row numbers from 1. Each row is copied at most once.
    """
    if not 0 <= reach <= rows:
        raise ValueError(f"a block of {rows} rows cannot lend {reach} rows to the next one")
    pos = F.col(row_nr) - 1
    block, inside = F.floor(pos / rows), pos % rows
    homes = F.when(inside >= rows - reach, F.array(block, block + 1)).otherwise(F.array(block))
    spread = df.withColumns({"_home": block, "_homes": homes}).withColumn("_block", F.explode("_homes"))
    done = frames(spread.drop("_homes"), Series((*s.keys, "_block"), s.order))
    return done.filter(F.col("_block") == F.col("_home")).drop("_block", "_home")
