"""Running values from the first row on, over series too long for one window group.

A running product, sum, maximum or last known value of a row is made of two parts: the rows of its own block
and all earlier blocks. The first is a window over a block of bounded size; the second is a window over one
row per block, joined back on the block. Both parts merge, so the result is that of a window over the whole
series, whatever the blocks are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import Series, ffill
from barloom.functions.scalars import as_col


def _either(merge: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """``merge`` of two parts, or the one that is there: a part without values is missing."""
    return lambda earlier, own: F.coalesce(merge(earlier, own), earlier, own)


@dataclass(frozen=True)
class Scan:
    """A running value: ``fold`` of a block's rows so far, ``total`` of a block, and how two parts merge."""

    values: Column
    fold: Callable[[Column], Column]
    total: Callable[[Column, Column], Column]
    merge: Callable[[Column, Column], Column]


def growth_scan(r: str | Column) -> Scan:
    """Running product of 1 + r; rows without a return leave it as it is."""
    return Scan(F.lit(1.0) + as_col(r), F.product, lambda v, day: F.product(v), _either(lambda a, b: a * b))


def sum_scan(c: str | Column) -> Scan:
    return Scan(as_col(c), F.sum, lambda v, day: F.sum(v), _either(lambda a, b: a + b))


def max_scan(c: str | Column) -> Scan:
    return Scan(as_col(c), F.max, lambda v, day: F.max(v), F.greatest)


def last_scan(c: str | Column) -> Scan:
    """The last value that was there, this row's included."""
    return Scan(as_col(c), lambda v: F.last(v, ignorenulls=True),
                lambda v, day: F.max_by(v, F.when(v.isNotNull(), day)), lambda earlier, own: F.coalesce(own, earlier))


def scan(df: DataFrame, s: Series, outputs: Mapping[str, Scan], rows: int = 4096, row_nr: str = "row_nr") -> DataFrame:
    """``df`` with a column for each scan over all rows of the series so far.

    ``df`` carries row numbers from 1 (``number_rows``) and is read twice, so settle what is costly to make. It
    is shuffled once, on key and block, and no window group is longer than ``rows``. The table of carried
    values has a row for each block; Spark broadcasts it or merges it on the partitioning of the windows,
    as its measured size asks for. Missing values count for nothing; a row before the first value is missing.
    """
    if rows < 1:
        raise ValueError("a block has at least one row")
    (day,) = s.order
    blocks = df.withColumns({"_block": F.floor((F.col(row_nr) - 1) / rows), **{f"_v_{c}": x.values for c, x in outputs.items()}})
    inner = Series((*s.keys, "_block"), day)
    totals = blocks.groupBy(*inner.keys).agg(
        *[x.total(F.col(f"_v_{c}"), F.col(day)).alias(f"_t_{c}") for c, x in outputs.items()])
    over = Series(s.keys, "_block")
    carried = totals.select(*inner.keys, *[x.fold(F.col(f"_t_{c}")).over(over.before).alias(f"_c_{c}") for c, x in outputs.items()])
    own = blocks.withColumns({f"_o_{c}": x.fold(F.col(f"_v_{c}")).over(inner.so_far) for c, x in outputs.items()})
    whole = own.join(carried, [*inner.keys], "left")
    return whole.select(*[F.col(f"`{c}`") for c in df.columns if c not in outputs],
                        *[x.merge(F.col(f"_c_{c}"), F.col(f"_o_{c}")).alias(c) for c, x in outputs.items()])


def held(df: DataFrame, s: Series, columns: Mapping[str, str], block_rows: int | None = None) -> DataFrame:
    """``df`` with {output: column} filled forward, in one window per series or, for long ones, in blocks."""
    if block_rows is None:
        return df.withColumns({out: ffill(c, s) for out, c in columns.items()})
    return scan(df, s, {out: last_scan(c) for out, c in columns.items()}, block_rows)
