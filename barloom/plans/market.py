"""Queries over sources, cleaning, calendar and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.functions.frames import PERIODIC, Series, diff, ffill, lag, lag_return, lead
from barloom.functions.scalars import clip_above, clip_below, indicator
from barloom.operators.indicators import widen_quotes
from barloom.operators.resample import last_row, period_returns, resample_last
from barloom.plans import sql_parts as q
from barloom.plans.registry import Shape, query
from barloom.session import scratch_path
from barloom.sources import files
from barloom.sources.bars import (
    between_days, brand_bars, day_bounds, macro_quotes, segment_bars, table,
)

PRICES = ["open", "high", "low", "close", "adj_close", "volume"]
TICKERS = {"^VIX": "VIX", "^TNX": "TNX"}


@query(Shape("asset d", r6="open high low close adj_close volume"), "bars", "bars")
def bars_segments(spark, sf_dir):
    """Daily bars of the market segments."""
    return segment_bars(spark, sf_dir)


@query(Shape("asset d open high low close adj_close volume"), "brand_bars", "brand_bars")
def bars_brands(spark, sf_dir):
    """Daily bars of the part brands."""
    return brand_bars(spark, sf_dir)


@query(Shape("d", r6="VIX TNX"), "macro", "macro")
def macro_wide(spark, sf_dir):
    """One field of the tidy macro quotes, one column per ticker, carried forward."""
    return widen_quotes(macro_quotes(spark, sf_dir), TICKERS)


@query(Shape("d", r6="VIX TNX"), "macro bars",
       "SELECT * FROM macro WHERE d BETWEEN (SELECT min(d) FROM bars) AND (SELECT max(d) FROM bars)")  # every day has both
def macro_in_range(spark, sf_dir):
    """Macro rows inside the date range of the bars, the range pushed to the scan as literals."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    lo, hi = day_bounds(orders)
    return widen_quotes(macro_quotes(spark, sf_dir, str(lo), str(hi)), TICKERS)


def stored_text_bars(spark, sf_dir):
    """Segment bars as positional text files with cells that do not parse and rows without values.

    Days with a single trade get a close of "n/a", days with two trades have every cell blank.
    """
    bars = segment_bars(spark, sf_dir)
    cells = {c: F.when(F.col("volume") == 2, F.lit("")).otherwise(F.col(c).cast("string")) for c in PRICES}
    cells["close"] = F.when(F.col("volume") == 1, F.lit("n/a")).otherwise(cells["close"])
    text = bars.select("asset", "d", *[cell.alias(c) for c, cell in cells.items()])
    path = scratch_path(spark, "prices")
    return files.write_positional(text, path)


@query(Shape("asset d", r6="open high low close adj_close volume"), "bars", """
SELECT asset, d, open, high, low, CASE WHEN volume <> 1 THEN close END AS close, adj_close, volume
FROM bars WHERE volume <> 2""")
def csv_positional(spark, sf_dir):
    """Positional text files back to bars: header lines, bad cells and empty rows repaired."""
    return files.read_positional(spark, stored_text_bars(spark, sf_dir))


@query(Shape("asset period_end", r6="ret"), "month_ret", "month_ret")
def csv_detected_columns(spark, sf_dir):
    """Monthly returns from headed files whose date and price columns are found by name."""
    named = segment_bars(spark, sf_dir).select(
        "asset", F.col("volume").alias("Trades"), F.col("d").alias("Datetime"), F.col("adj_close").alias("Adj_Close"))
    path = files.write_table(named, scratch_path(spark, "detected"), fmt="csv", header="true")
    return period_returns(files.read_prices(spark, path)).filter(F.col("ret").isNotNull())


@query(Shape("asset d", r6="open high low close adj_close volume"), "bars", "bars")
def csv_ohlcv(spark, sf_dir):
    """Full bars from headed files with all required columns."""
    named = segment_bars(spark, sf_dir).select(
        "asset", F.col("d").alias("Date"), *[F.col(n).alias(c) for c, n in files.PRICE_COLUMNS.items()])
    path = files.write_table(named, scratch_path(spark, "ohlcv"), fmt="csv", header="true")
    return files.read_ohlcv(spark, path)


@query(Shape("asset d", r6="adj_close"), "bars", "bars")
def csv_mixed_headers(spark, sf_dir):
    """Files of two different headers in one folder, each read by its own, some with dates in another form."""
    bars = segment_bars(spark, sf_dir).select("asset", "d", "close", "volume")
    path = scratch_path(spark, "mixed")
    one = bars.filter("asset < 'F'").select("asset", F.col("d").alias("Date"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    two = bars.filter("asset >= 'F'").select("asset", F.date_format("d", "MM/dd/yyyy").alias("Date"), F.col("volume").alias("Volume"),
                                             F.col("close").alias("Close"))
    for part in (one, two):
        files.write_table(part, path, fmt="csv", mode="append", header="true")
    return files.read_prices(spark, path)


@query(Shape("asset d", r6="open high low close adj_close volume"), "bars", "bars")
def csv_repeated_dates(spark, sf_dir):
    """Files in which days come twice: the row of larger volume is the day's bar."""
    bars = segment_bars(spark, sf_dir)
    twice = bars.unionByName(bars.filter("day(d) % 2 = 0").withColumns({"volume": F.col("volume") - 1, "close": F.col("close") + 1}))
    named = twice.select("asset", F.col("d").alias("Date"), *[F.col(n).alias(c) for c, n in files.PRICE_COLUMNS.items()])
    path = files.write_table(named, scratch_path(spark, "twice"), fmt="csv", header="true")
    return files.read_ohlcv(spark, path)


@query(Shape("d", r6="adj_close"), "bars", "SELECT d, close AS adj_close FROM bars WHERE asset = 'MACHINERY'")
def csv_found_file(spark, sf_dir):
    """The price file of a folder, found by name, then read by its header."""
    bars = segment_bars(spark, sf_dir, segments=["MACHINERY"])
    folder = scratch_path(spark, "folder")
    bars.select(F.col("d").alias("Date"), F.col("close").alias("Close")).coalesce(1).write.csv(folder, header=True)
    return files.read_prices(spark, files.find_price_file(spark, folder, ["SPY_prices.csv", "prices.csv"]), keys=())


@query(Shape("asset d", r6="close"), "bars",
       "SELECT * FROM bars WHERE d BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def stored_bars_range(spark, sf_dir):
    """Bars stored by asset and read back for a closed date range with the filter pushed down."""
    path = files.write_table(segment_bars(spark, sf_dir), scratch_path(spark, "bars"))
    return between_days(files.read_labelled(spark, path), "1996-01-01", "1998-12-31")


@query(Shape("asset d", r6="open high low close volume"), "bars", """
SELECT * FROM bars WHERE d BETWEEN DATE '1996-02-01' AND DATE '1999-10-31' AND asset IN ('BUILDING', 'MACHINERY')""")
def bars_selected(spark, sf_dir):
    """Bars of chosen assets and dates, both choices pushed to the raw scans."""
    return segment_bars(spark, sf_dir, "1996-02-01", "1999-10-31", ["BUILDING", "MACHINERY"])


@query(Shape("file_name", n="found"), "bars", """
SELECT 'asset=' || asset AS file_name, count(*) AS found FROM bars GROUP BY 1""")
def csv_discovery(spark, sf_dir):
    """Rows per discovered source folder when many assets are loaded at once."""
    path = stored_text_bars(spark, sf_dir)
    parts = F.split(F.col("_metadata.file_path"), "/")
    lines = spark.read.schema(files.text_schema(files.POSITIONAL)).option("pathGlobFilter", "*.csv").csv(path)
    named = lines.select(F.element_at(parts, -2).alias("file_name"), F.col("date").try_cast("date").alias("d"))
    return named.filter(F.col("d").isNotNull()).groupBy("file_name").agg(F.count(F.lit(1)).alias("found"))


@query(Shape("asset period_end", r6=" ".join(PRICES)), "month_px", "month_px")
def monthly_resample(spark, sf_dir):
    """Month-end bars on a dense calendar, last non-missing value per column."""
    return resample_last(segment_bars(spark, sf_dir), "month", PRICES)


@query(Shape("asset period_end", r6="close volume"), "bars", f"""
WITH w AS (SELECT asset, {q.WEEK.format(d='d')} AS period_end, d, close, volume FROM bars),
span AS (SELECT asset, min(period_end) AS lo, max(period_end) AS hi FROM w GROUP BY asset),
cal AS (SELECT asset, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS period_end FROM span)
SELECT c.asset, c.period_end, arg_max(w.close, w.d) AS close, arg_max(w.volume, w.d) AS volume
FROM cal c LEFT JOIN w ON w.asset = c.asset AND w.period_end = c.period_end GROUP BY c.asset, c.period_end""")
def weekly_resample(spark, sf_dir):
    """Friday week ends on a dense calendar, last non-missing value per column."""
    return resample_last(segment_bars(spark, sf_dir), "week", ["close", "volume"])


@query(Shape("asset period_end d", r6="close volume"), "bars", """
SELECT asset, last_day(d) AS period_end, d, close, volume FROM bars
QUALIFY row_number() OVER (PARTITION BY asset, last_day(d) ORDER BY d DESC) = 1""")
def month_last_row(spark, sf_dir):
    """Last physical bar of each month."""
    return last_row(segment_bars(spark, sf_dir), "month")


@query(Shape("d month_end week_end month_key five_years_back one_month_back", n="month_nr"), "bars", f"""
SELECT DISTINCT d, last_day(d) AS month_end, {q.WEEK.format(d='d')} AS week_end, strftime(d, '%Y-%m') AS month_key,
  CAST(last_day(d) - INTERVAL 60 MONTH AS DATE) AS five_years_back,
  CAST(last_day(d) - INTERVAL 1 MONTH AS DATE) AS one_month_back, year(d) * 12 + month(d) AS month_nr FROM bars""")
def period_keys(spark, sf_dir):
    """Calendar keys of every bar date, offsets clipped to the length of the month."""
    days = segment_bars(spark, sf_dir).select("d").distinct()
    return days.withColumns({
        "month_end": calendar.month_end("d"), "week_end": calendar.week_end("d"),
        "month_key": F.date_format("d", "yyyy-MM"), "month_nr": calendar.month_number("d"),
        "five_years_back": calendar.months_before(calendar.month_end("d"), 60),
        "one_month_back": calendar.months_before(calendar.month_end("d"), 1),
    })


_KEPT = {"any": "close IS NOT NULL AND busy IS NOT NULL", "all": "close IS NOT NULL OR busy IS NOT NULL",
         "subset": "close IS NOT NULL"}


@query(Shape("rule asset", n="n_rows"), "month_px",
       "WITH px AS (SELECT *, CASE WHEN volume > 1 THEN volume END AS busy FROM month_px) " + " UNION ALL ".join(
           f"SELECT '{rule}' AS rule, asset, count(*) AS n_rows FROM px WHERE {cond} GROUP BY asset"
           for rule, cond in _KEPT.items()))
def missing_data_rules(spark, sf_dir):
    """Rows that survive dropping on any, on all and on one of the columns of gappy month ends."""
    months = resample_last(segment_bars(spark, sf_dir), "month", ["close", "volume"])
    close, busy = F.col("close").isNotNull(), F.col("volume") > 1
    kept = {"any": close & busy, "all": close | busy, "subset": close}
    counts = months.groupBy("asset").agg(*[F.count_if(rule).alias(name) for name, rule in kept.items()])
    return counts.unpivot("asset", list(kept), "rule", "n_rows").filter("n_rows > 0")


@query(Shape("asset period_end", r6="adj_close held ret"), "month_held month_ret0", """
SELECT h.*, r.ret FROM month_held h JOIN month_ret0 r ON r.asset = h.asset AND r.period_end = h.period_end""")
def monthly_returns_padded(spark, sf_dir):
    """Monthly returns with the price carried over months without one."""
    months = resample_last(segment_bars(spark, sf_dir), "month", ["adj_close"])
    return months.withColumn("held", ffill("adj_close", PERIODIC)).withColumn("ret", lag_return("held", PERIODIC))


@query(Shape("asset period_end", r6="adj_close ret"), "week_ret0", "week_ret0")
def weekly_returns(spark, sf_dir):
    """Weekly returns over the weeks that have a price."""
    return period_returns(segment_bars(spark, sf_dir), "week")


@query(Shape("asset d", n="up", r6="ret1 ret5 ret21 diff1 diff20 next_close gain drop_"), "bars", f"""
SELECT asset, d, {q.chg('close')} AS ret1, {q.chg('close', 5)} AS ret5, {q.chg('close', 21)} AS ret21,
  close - {q.lag('close')} AS diff1, close - {q.lag('close', 20)} AS diff20,
  lead(close) OVER (PARTITION BY asset ORDER BY d) AS next_close,
  CASE WHEN close - {q.lag('close')} < 0 THEN 0.0 ELSE close - {q.lag('close')} END AS gain,
  CASE WHEN close - {q.lag('close')} > 0 THEN 0.0 ELSE close - {q.lag('close')} END AS drop_,
  CASE WHEN close > {q.lag('close')} THEN 1 ELSE 0 END AS up FROM bars""")
def lagged_changes(spark, sf_dir):
    """Returns, differences, shifts, clipped moves and the up-day indicator of daily closes."""
    s = Series()
    df = segment_bars(spark, sf_dir).withColumns({
        "ret1": lag_return("close", s), "ret5": lag_return("close", s, 5), "ret21": lag_return("close", s, 21),
        "diff1": diff("close", s), "diff20": diff("close", s, 20), "next_close": lead("close", s),
        "up": indicator(F.col("close") > lag("close", s)),
    })
    return df.withColumns({"gain": clip_below("diff1"), "drop_": clip_above("diff1")})
