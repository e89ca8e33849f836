"""Technical indicators and the daily feature bundles.

Bundles add their columns in stages (changes, frames over changes, frames over frames). Every stage uses
the same partitioning and ordering, so a bundle costs one exchange on the asset and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import (
    DAILY, Series, diff, ffill, lag_return, rolling_max, rolling_mean, rolling_std, rolling_sum, zscore,
)
from barloom.functions.scalars import clip_above, clip_below, excess_ratio, ratio
from barloom.operators.blocks import in_blocks, number_rows
from barloom.operators.smoothing import ewm, ewm_by_year, macd

# Names of the bundle columns.
EQUITY_FEATURES = (
    "daily_return", "rolling_volatility_10d", "rolling_volatility_20d", "rolling_volatility_60d",
    "sma_20", "sma_50", "sma_200", "ema_20", "price_over_sma20", "price_over_sma50", "price_over_sma200",
    "mom_20d", "mom_60d", "weekly_return_5d", "rsi_14", "intraday_range", "intraday_range_10d_ma",
    "drawdown_60d",
)
CRYPTO_FEATURES = (
    "ret_1d", "vol_21d", "vol_63d", "px_over_sma_10", "px_over_sma_50", "px_over_sma_200", "rsi_14",
    "macd", "macd_signal", "ret_5d", "ret_21d", "ret_63d", "vol_zscore_21d",
)
WARM_UP_ROWS = 200
EQUITY_REACH, CRYPTO_REACH = 200, 273


def gains_losses(price: str, s: Series, first: str) -> dict[str, Column]:
    """Positive and negative parts of the daily change.

    ``first="zero"`` counts the undefined first change as no move, ``first="null"`` leaves it missing.
    """
    d = diff(price, s)
    if first == "zero":
        return {"_gain": F.when(d > 0, d).otherwise(F.lit(0.0)), "_loss": F.when(d < 0, -d).otherwise(F.lit(0.0))}
    return {"_gain": clip_below(d), "_loss": -clip_above(d)}


def rsi_from(gain: str, loss: str, n: int, s: Series) -> Column:
    """Relative strength: 100 without losses, missing when the window did not move at all."""
    up, down = rolling_mean(gain, n, s), rolling_mean(loss, n, s)
    hundred = F.lit(100.0)
    return F.when(down == 0, F.when(up > 0, hundred)).otherwise(
        hundred - hundred / (F.lit(1.0) + ratio(up, down)))


def rsi(df: DataFrame, price: str = "adj_close", n: int = 14, first: str = "null", out: str | None = None,
        s: Series = DAILY) -> DataFrame:
    staged = df.withColumns(gains_losses(price, s, first))
    return staged.withColumn(out or f"rsi_{n}", rsi_from("_gain", "_loss", n, s)).drop("_gain", "_loss")


def rolling_drawdown(price: str, n: int, s: Series) -> Column:
    return excess_ratio(F.col(price), rolling_max(price, n, s, min_periods=1))


#: Name of the price carried over missing ones, from which changes over 1, 5, 21 and 63 rows are taken.
HELD = "_held"


def equity_frames(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """The columns of the equity bundle that look back a fixed number of rows (200 at most)."""
    price = "adj_close"
    df = df.withColumns({
        "daily_return": lag_return(HELD, s),
        "mom_20d": lag_return(price, s, 20),
        "mom_60d": lag_return(price, s, 60),
        "weekly_return_5d": lag_return(HELD, s, 5),
        "intraday_range": ratio(F.col("high") - F.col("low"), "close"),
        "drawdown_60d": rolling_drawdown(price, 60, s),
        **{f"sma_{n}": rolling_mean(price, n, s) for n in (20, 50, 200)},
        **gains_losses(price, s, "zero"),
    })
    return df.withColumns({
        **{f"rolling_volatility_{n}d": rolling_std("daily_return", n, s) for n in (10, 20, 60)},
        **{f"price_over_sma{n}": excess_ratio(F.col(price), F.col(f"sma_{n}")) for n in (20, 50, 200)},
        "intraday_range_10d_ma": rolling_mean("intraday_range", 10, s),
        "rsi_14": rsi_from("_gain", "_loss", 14, s),
    }).drop("_gain", "_loss", HELD)


def equity_indicators(bars: DataFrame, s: Series = DAILY, block_rows: int | None = None) -> DataFrame:
    """Daily equity bundle before any row is dropped, with the row number of each bar.

    ``block_rows`` switches to blocks for series too long for one window group; pass a stored table then.
    """
    means, held = {"ema_20": ("adj_close", 20)}, {HELD: "adj_close"}
    if block_rows is None:
        return equity_frames(ewm(bars, means, s, held).withColumn("row_nr", F.row_number().over(s.rows)), s)
    return in_blocks(number_rows(ewm_by_year(bars, means, s, held), s), s, EQUITY_REACH, equity_frames, block_rows)


def equity_features(bars: DataFrame, s: Series = DAILY, block_rows: int | None = None) -> DataFrame:
    """Daily equity bundle after the warm-up rows, complete rows only."""
    df = equity_indicators(bars, s, block_rows)
    ready = df.filter(F.col("row_nr") > WARM_UP_ROWS).dropna("any", subset=list(EQUITY_FEATURES))
    return ready.drop("row_nr")


def crypto_frames(df: DataFrame, variant: str, s: Series = DAILY) -> DataFrame:
    """The columns of the crypto bundle that look back a fixed number of rows (273 at most)."""
    price = "adj_close"
    smas = (10, 21, 50, 200) if variant == "monthly" else (10, 50, 200)
    df = df.withColumns({
        **{f"ret_{n}d": lag_return(HELD, s, n) for n in (1, 5, 21, 63)},
        **{f"sma_{n}": rolling_mean(price, n, s) for n in smas},
        **gains_losses(price, s, "null"),
    })
    scale = F.sqrt(F.lit(252.0)) if variant == "monthly" else F.lit(1.0)
    df = df.withColumns({
        **{f"vol_{n}d": rolling_std("ret_1d", n, s) * scale for n in (21, 63)},
        **{f"px_over_sma_{n}": excess_ratio(F.col(price), F.col(f"sma_{n}")) for n in (10, 50, 200)},
        "rsi_14": rsi_from("_gain", "_loss", 14, s),
    }).drop("_gain", "_loss", HELD)
    score = zscore("volume", 21, s) if variant == "monthly" else zscore("vol_21d", 252, s)
    return df.withColumn("vol_zscore_21d", score)


def crypto_features(bars: DataFrame, variant: str = "monthly", s: Series = DAILY,
                    block_rows: int | None = None) -> DataFrame:
    """Daily crypto bundle.

    ``monthly`` annualises the volatilities and scores today's volume against 21 days, ``weekly`` keeps
    raw volatilities and scores the 21-day volatility against 252 days. ``block_rows`` as for equities.
    """
    if variant not in ("monthly", "weekly"):
        raise ValueError(f"variant must be monthly or weekly, got {variant!r}")
    if block_rows is None:
        df = crypto_frames(macd(bars, s=s, pad={HELD: "adj_close"}), variant, s)
    else:
        numbered = number_rows(macd(bars, s=s, scan=ewm_by_year, pad={HELD: "adj_close"}), s)
        df = in_blocks(numbered, s, CRYPTO_REACH, lambda part, series: crypto_frames(part, variant, series), block_rows)
    averages = [c for c in df.columns if c.startswith("sma_")] if variant == "monthly" else []
    return df.select(*bars.columns, *CRYPTO_FEATURES, *averages)


def monthly_return_features(returns: DataFrame, ret: str = "ret", s: Series | None = None) -> DataFrame:
    """Return sums and deviations over 1, 3 and 6 months, as known at the end of the month."""
    s = s or Series(("asset",), "period_end")
    return returns.withColumns({
        "ret_1m": F.col(ret),
        **{f"ret_{n}m": rolling_sum(ret, n, s) for n in (3, 6)},
        **{f"vol_{n}m": rolling_std(ret, n, s) for n in (3, 6)},
    })


def up_day_share(df: DataFrame, month: Column, ret: str = "daily_return",
                 keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Share of up days in the calendar month of each row, on every row of that month."""
    up = F.coalesce((F.col(ret) > 0).cast("double"), F.lit(0.0))
    staged = df.withColumn("_month", month)
    return staged.withColumn(
        "month_pos_frac", F.avg(up).over(Window.partitionBy(*keys, "_month"))).drop("_month")


def widen_quotes(quotes: DataFrame, tickers: dict[str, str], field: str = "adj_close",
                 keys: Sequence[str] = ()) -> DataFrame:
    """One field of a tidy multi-ticker table as one column per ticker, carried forward by date.

    ``tickers`` maps the quoted name to the output column. The pivot is a conditional aggregation on
    (keys, day). The carry runs over the tidy rows, one series per ticker, so no task holds a whole market.
    A day on which only some tickers have a row gets the other ones' last values: every day of the table is
    put before each ticker's carry.
    """
    kept = quotes.filter((F.col("field") == field) & F.col("ticker").isin(*tickers))
    tidy = kept.groupBy(*keys, "d", "ticker").agg(F.max("value").alias("value"))
    every = tidy.select(*keys, "d").distinct().withColumn("ticker", F.explode(F.array(*[F.lit(t) for t in tickers])))
    filled = every.join(tidy, [*keys, "d", "ticker"], "left")
    carried = filled.withColumn("value", ffill("value", Series((*keys, "ticker"), "d")))
    return carried.groupBy(*keys, "d").agg(
        *[F.max(F.when(F.col("ticker") == t, F.col("value"))).alias(name) for t, name in tickers.items()])


def align_macro(df: DataFrame, macro: DataFrame, columns: Sequence[str], s: Series = DAILY) -> DataFrame:
    """Macro values by exact date, then carried forward along each asset's own dates.

    A value on a day the asset did not trade is not seen by it. The macro table has one row per day and
    is joined before the window, whose exchange on the asset then serves the carry and later frames.
    """
    (day,) = s.order
    joined = df.join(macro.select(F.col("d").alias(day), *columns), day, "left")
    return joined.withColumns({c: ffill(c, s) for c in columns})


def macro_features(df: DataFrame, macro: DataFrame, s: Series = DAILY) -> DataFrame:
    """Volatility-index and ten-year-rate columns of the daily equity data."""
    df = align_macro(df, macro, ("VIX", "TNX"), s)
    df = df.withColumns({
        "vix_level": F.col("VIX"),
        "vix_5d_change": lag_return("VIX", s, 5),
        "vix_20d_ma": rolling_mean("VIX", 20, s),
        "vix_20d_vol": rolling_std("VIX", 20, s),
        "rate_10y": F.col("TNX") / F.lit(10.0),
    })
    return df.withColumn("rate_10y_20d_change", diff("rate_10y", s, 20)).drop("VIX", "TNX")


def enrich(labelled: DataFrame, macro: DataFrame, s: Series = DAILY) -> DataFrame:
    """Macro, MACD and breadth columns on top of the labelled daily data."""
    df = macd(macro_features(labelled, macro, s), s=s)
    return up_day_share(df, F.last_day(s.order[0]), keys=s.keys)
