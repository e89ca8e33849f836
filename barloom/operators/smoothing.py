"""Exponentially weighted means as an exact two-level scan.

``y[0] = x[0]``, ``y[t] = a x[t] + (1 - a) y[t-1]`` is a chain of affine steps, and affine steps compose.
Within one calendar year of a series the chain is a running weighted sum; across years it only needs
each year's closing value. So the recursion becomes two window passes without any Python, and no row
waits for more than the closings of the years before it.

A missing value carries the mean on. The next value then weighs ``a / (a + (1 - a)^g)``, where g is the number
of rows since the last value; without gaps that is a.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import Series


def alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def _kept(span: float, gap: Column) -> Column:
    """Weight of the old mean when a value comes ``gap`` rows after the last one."""
    old = F.pow(F.lit(1.0 - alpha(span)), gap)
    return old / (old + F.lit(alpha(span)))


def _sources(outputs: Mapping[str, tuple[str, float]], pad: Mapping[str, str]) -> list[str]:
    return sorted({c for c, _ in outputs.values()} | set(pad.values()))


def _year_sums(df: DataFrame, outputs: Mapping[str, tuple[str, float]], sources: list[str], s: Series) -> DataFrame:
    """What a row knows of its own year: its position, per source the first and last value so far with their
    positions, and per output the affine step (``_p_`` factor, ``_s_`` sum) from the year's first value to it."""
    (day,) = s.order
    year = Window.partitionBy(*s.keys, "_year").orderBy(day)
    upto = year.rowsBetween(Window.unboundedPreceding, 0)
    earlier = year.rowsBetween(Window.unboundedPreceding, -1)
    staged = df.withColumn("_n", F.row_number().over(year).cast("double"))
    at = {c: F.when(F.col(c).isNotNull(), F.col("_n")) for c in sources}
    staged = staged.withColumns({
        **{f"_first_{c}": F.first(c, ignorenulls=True).over(upto).cast("double") for c in sources},
        **{f"_last_{c}": F.last(c, ignorenulls=True).over(upto) for c in sources},
        **{f"_begin_{c}": F.min(at[c]).over(upto) for c in sources},
        **{f"_end_{c}": F.max(at[c]).over(upto) for c in sources},
        **{f"_prev_{c}": F.max(at[c]).over(earlier) for c in sources},
    })
    # the year's first value is left to the carry: it takes no part in the factor or the sum
    moves = {c: F.col(c).isNotNull() & F.col(f"_prev_{c}").isNotNull() for c, _ in outputs.values()}
    kept = {o: F.when(moves[c], _kept(span, F.col("_n") - F.col(f"_prev_{c}"))).otherwise(F.lit(1.0))
            for o, (c, span) in outputs.items()}
    staged = staged.withColumns({f"_k_{o}": k for o, k in kept.items()})
    staged = staged.withColumns({f"_p_{o}": F.product(f"_k_{o}").over(upto) for o in outputs})
    added = {o: F.when(moves[c], (F.lit(1.0) - F.col(f"_k_{o}")) * F.col(c) / F.col(f"_p_{o}")).otherwise(F.lit(0.0))
             for o, (c, _) in outputs.items()}
    return staged.withColumns({f"_s_{o}": F.col(f"_p_{o}") * F.sum(x).over(upto) for o, x in added.items()})


def _closing(outputs: Mapping[str, tuple[str, float]], sources: list[str]) -> list[Column]:
    return [F.col("_n").alias("n"), *[F.col(f"_{k}_{c}").alias(f"{k}_{c}") for c in sources for k in ("first", "last", "begin", "end")],
            *[F.col(f"_{k}_{o}").alias(f"{k}_{o}") for o in outputs for k in ("p", "s")]]


def _started(mean: Column, idle: Column, first: Column, begin: Column, span: float) -> Column:
    """Mean at a year's first value, from the mean at the end of the years before and the rows since its last value."""
    kept = _kept(span, begin + idle)
    return F.when(mean.isNull(), first).otherwise(kept * mean + (F.lit(1.0) - kept) * first)


def _carried(closings: str, out: str, column: str, span: float) -> Column:
    """(mean, idle): mean at the end of the listed years, missing before any value, and rows since its last value."""
    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0.0).alias("idle"))

    def year(acc, e):
        has = e[f"first_{column}"].isNotNull()
        begun = _started(acc["mean"], acc["idle"], e[f"first_{column}"], e[f"begin_{column}"], span)
        return F.struct(F.when(has, e[f"p_{out}"] * begun + e[f"s_{out}"]).otherwise(acc["mean"]).alias("mean"),
                        F.when(has, e["n"] - e[f"end_{column}"]).otherwise(acc["idle"] + e["n"]).alias("idle"))

    return F.aggregate(closings, start, year)


def _combined(out: str, column: str, span: float, carry: Column) -> Column:
    begun = _started(carry["mean"], carry["idle"], F.col(f"_first_{column}"), F.col(f"_begin_{column}"), span)
    return F.when(F.col(f"_first_{column}").isNull(), carry["mean"]).otherwise(
        F.col(f"_p_{out}") * begun + F.col(f"_s_{out}"))


def _last_of(closings: str, column: str) -> Column:
    """Last value of a column in the listed years."""
    return F.aggregate(closings, F.lit(None).cast("double"),
                       lambda acc, e: F.when(e[f"last_{column}"].isNotNull(), e[f"last_{column}"]).otherwise(acc))


def ewm(df: DataFrame, outputs: Mapping[str, tuple[str, float]], s: Series = Series(),
        pad: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``{name: (column, span)}`` means, and ``{name: column}`` with values carried over missing ones.

    The order column must be a date with one row per key and day: a year then holds at most 366 rows
    and the weights stay finite for every span of 2 and more. A mean is missing before the first value.
    """
    (day,) = s.order
    pad = pad or {}
    sources = _sources(outputs, pad)
    keyed = df.withColumn("_year", F.year(day))
    # one physical sort (keys, year, day) serves these windows and the ones inside a year
    whole = Window.partitionBy(*s.keys).orderBy("_year", day)
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    following = F.lead("_year").over(whole)
    keyed = keyed.withColumn("_closes", following.isNull() | (following != F.col("_year")))
    staged = _year_sums(keyed, outputs, sources, s)
    closing = F.struct(*_closing(outputs, sources))
    staged = staged.withColumn("_closings", F.collect_list(F.when(F.col("_closes"), closing)).over(earlier))
    staged = staged.withColumns({f"_carry_{o}": _carried("_closings", o, c, span) for o, (c, span) in outputs.items()})
    done = staged.withColumns({
        **{o: _combined(o, c, span, F.col(f"_carry_{o}")) for o, (c, span) in outputs.items()},
        **{o: F.coalesce(F.col(f"_last_{c}"), _last_of("_closings", c)) for o, c in pad.items()}})
    return done.select(*df.columns, *outputs, *pad)


def ewm_by_year(df: DataFrame, outputs: Mapping[str, tuple[str, float]], s: Series = Series(),
                pad: Mapping[str, str] | None = None) -> DataFrame:
    """The same means without a window over a whole series.

    Only the closing values of each year are brought together per key; the rows stay partitioned by
    (key, year) and receive their carry by a join. The input is read twice, so pass a stored table.
    """
    (day,) = s.order
    pad = pad or {}
    sources = _sources(outputs, pad)
    staged = _year_sums(df.withColumn("_year", F.year(day)), outputs, sources, s)
    closings = staged.groupBy(*s.keys, "_year").agg(F.max_by(F.struct(*_closing(outputs, sources)), "_n").alias("_closing"))
    years = Series(s.keys, "_year")
    carries = closings.withColumn("_closings", F.collect_list("_closing").over(years.before)).select(
        *s.keys, "_year", *[_carried("_closings", o, c, span).alias(f"_carry_{o}") for o, (c, span) in outputs.items()],
        *[_last_of("_closings", c).alias(f"_pad_{o}") for o, c in pad.items()])
    joined = staged.join(carries, [*s.keys, "_year"])
    done = joined.withColumns({
        **{o: _combined(o, c, span, F.col(f"_carry_{o}")) for o, (c, span) in outputs.items()},
        **{o: F.coalesce(F.col(f"_last_{c}"), F.col(f"_pad_{o}")) for o, c in pad.items()}})
    return done.select(*df.columns, *outputs, *pad)


def macd(df: DataFrame, price: str = "adj_close", fast: int = 12, slow: int = 26, signal: int = 9,
         extra: Mapping[str, tuple[str, float]] | None = None, s: Series = Series(), scan=ewm,
         pad: Mapping[str, str] | None = None) -> DataFrame:
    """MACD line, its signal line and their difference.

    The signal is a mean of the line, which has a value on every row from the first price on, so it is a scan
    of its own. Both scans share the exchange on the keys.
    """
    lines = scan(df, {"_fast": (price, fast), "_slow": (price, slow), **(extra or {})}, s, pad)
    lines = lines.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    lines = scan(lines, {"macd_signal": ("macd", signal)}, s)
    return lines.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
