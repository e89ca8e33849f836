"""Queries over rolling windows, indicators, feature bundles and macro data."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.frames import (
    PERIODIC, Series, forward_growth, growth, lag_return, rolling_max, rolling_mean, rolling_std, rolling_sum,
    running_max, zscore,
)
from barloom.functions.scalars import excess_ratio
from barloom.operators.blocks import in_blocks, number_rows
from barloom.operators.indicators import (
    crypto_features, enrich, equity_features, macro_features,
    monthly_return_features, rolling_drawdown, rsi, up_day_share, widen_quotes,
)
from barloom.operators.resample import period_returns
from barloom.operators.scans import growth_scan, last_scan, max_scan, scan, sum_scan
from barloom.operators.smoothing import macd
from barloom.plans import sql_parts as q
from barloom.plans.market import TICKERS
from barloom.plans.registry import Shape, query
from barloom.session import scratch_path, settle
from barloom.sources.bars import brand_bars, macro_quotes, segment_bars, settled_bars
from barloom.sources.panels import store_panel


@query(Shape("asset d", r6="std10 std60 sum5 mean20 z21 max60"), "eq0", f"""
SELECT asset, d, {q.roll('stddev_samp', 'daily_return', 10)} AS std10, {q.roll('stddev_samp', 'daily_return', 60)} AS std60,
  {q.roll('sum', 'daily_return', 5)} AS sum5, {q.roll('avg', 'daily_return', 20)} AS mean20,
  {q.div(f"volume - {q.roll('avg', 'volume', 21)}".replace('CASE', '(CASE').replace('END', 'END)'), q.roll('stddev_samp', 'volume', 21))} AS z21,
  max(adj_close) {q.over(59)} AS max60 FROM eq0""")
def rolling_stats(spark, sf_dir):
    """Full-window rolling deviations, sums, means and scores, and a rolling maximum."""
    s = Series()
    df = segment_bars(spark, sf_dir).withColumn("daily_return", lag_return("adj_close", s))
    return df.withColumns({
        "std10": rolling_std("daily_return", 10, s), "std60": rolling_std("daily_return", 60, s),
        "sum5": rolling_sum("daily_return", 5, s), "mean20": rolling_mean("daily_return", 20, s),
        "z21": zscore("volume", 21, s), "max60": rolling_max("adj_close", 60, s, min_periods=1),
    })


@query(Shape("asset d", r3="ema_20 macd macd_signal macd_hist"), "ewm", "SELECT *, e20 AS ema_20 FROM ewm")
def ewm_macd(spark, sf_dir):
    """Exponential average and MACD lines of daily closes."""
    return macd(segment_bars(spark, sf_dir), extra={"ema_20": ("adj_close", 20)})


@query(Shape("asset d", r6="rsi_14"), "eq1", f"SELECT asset, d, {q.rsi('gain0', 'loss0')} AS rsi_14 FROM eq1")
def rsi_zero_first(spark, sf_dir):
    """Relative strength that counts the undefined first change as no move."""
    return rsi(segment_bars(spark, sf_dir), first="zero")


@query(Shape("asset d", r6="rsi_14"), "eq1", f"SELECT asset, d, {q.rsi('gain1', 'loss1')} AS rsi_14 FROM eq1")
def rsi_null_first(spark, sf_dir):
    """Relative strength that keeps the undefined first change missing."""
    return rsi(segment_bars(spark, sf_dir), first="null")


@query(Shape("asset d", r6="drawdown_60d drawdown_all"), "bars", f"""
SELECT asset, d, adj_close / max(adj_close) {q.over(59)} - 1 AS drawdown_60d,
  adj_close / max(adj_close) {q.over('all')} - 1 AS drawdown_all FROM bars""")
def drawdown_daily(spark, sf_dir):
    """Distance of the close from its 60-row and its all-time high."""
    s = Series()
    return segment_bars(spark, sf_dir).withColumns({
        "drawdown_60d": rolling_drawdown("adj_close", 60, s),
        "drawdown_all": excess_ratio("adj_close", running_max("adj_close", s)),
    })


DRAWDOWN_SHAPE = Shape("asset d", r6="drawdown_60d drawdown_all")


@query(DRAWDOWN_SHAPE, "bars", f"""
SELECT asset, d, adj_close / max(adj_close) {q.over(59)} - 1 AS drawdown_60d,
  adj_close / max(adj_close) {q.over('all')} - 1 AS drawdown_all FROM bars""")
def drawdown_blocks(spark, sf_dir):
    """The same distances computed in blocks; the all-time high is carried from block to block."""
    s = Series()
    bars = settle(number_rows(settled_bars(spark, sf_dir), s))
    near = in_blocks(bars, s, 59, lambda df, part: df.withColumn("drawdown_60d", rolling_drawdown("adj_close", 60, part)), 512)
    tops = scan(near, s, {"top": max_scan("adj_close")}, 512)
    return tops.withColumn("drawdown_all", excess_ratio("adj_close", "top"))


@query(Shape("asset d", r6="equity equity_drawdown last_rise", n="rises"), "eq0", f"""
SELECT asset, d, equity, equity / max(equity) {q.over('all')} - 1 AS equity_drawdown, last_rise, rises FROM (
  SELECT asset, d, product(1 + daily_return) {q.over('all')} AS equity,
    last_value(CASE WHEN daily_return > 0 THEN adj_close END IGNORE NULLS) {q.over('all')} AS last_rise,
    sum(CASE WHEN daily_return > 0 THEN 1 ELSE 0 END) {q.over('all')} AS rises FROM eq0)""")
def equity_daily_blocks(spark, sf_dir):
    """Daily equity, its drawdown, the last close that rose and the number of rises, carried from block to block."""
    s = Series()
    bars = number_rows(settled_bars(spark, sf_dir), s)
    moves = settle(in_blocks(bars, s, 1, lambda df, part: df.withColumn("daily_return", lag_return("adj_close", part)), 512))
    rose = F.col("daily_return") > 0
    curves = scan(moves, s, {"equity": growth_scan("daily_return"), "last_rise": last_scan(F.when(rose, F.col("adj_close"))),
                             "rises": sum_scan(F.when(rose, 1).otherwise(0))}, 512)
    return scan(curves, s, {"top": max_scan("equity")}, 512).withColumn("equity_drawdown", excess_ratio("equity", "top"))


EQUITY_SHAPE = Shape(
    "asset d",
    r6="daily_return rolling_volatility_10d rolling_volatility_20d rolling_volatility_60d price_over_sma20 "
       "price_over_sma50 price_over_sma200 mom_20d mom_60d weekly_return_5d rsi_14 intraday_range "
       "intraday_range_10d_ma drawdown_60d sma_20 sma_50 sma_200", r3="ema_20")


@query(EQUITY_SHAPE, "eq_ready", "eq_ready")
def equity_features_daily(spark, sf_dir):
    """Daily equity bundle after warm-up, complete rows only."""
    return equity_features(segment_bars(spark, sf_dir))


@query(EQUITY_SHAPE, "eq_ready", "eq_ready")
def equity_features_blocks(spark, sf_dir):
    """The daily equity bundle computed in overlapping blocks, for series too long for one window group."""
    return equity_features(settled_bars(spark, sf_dir), block_rows=512)


@query(EQUITY_SHAPE, "eq_ready", "eq_ready")
def equity_features_stored(spark, sf_dir):
    """The daily equity bundle over bars stored in buckets by asset: the windows need no exchange."""
    path = scratch_path(spark, "panel")
    return equity_features(store_panel(segment_bars(spark, sf_dir), path.rsplit("/", 1)[1].replace("-", "_"), path, buckets=8))


BRAND_SHAPE = Shape("asset d", r6="daily_return rolling_volatility_20d price_over_sma50 price_over_sma200 mom_60d "
                                  "rsi_14 intraday_range_10d_ma drawdown_60d")


def _brand_equity_sql() -> str:
    names = ("eq0", "eq1")
    steps = [q.PARTS[n][1].replace("bars", "brand_bars") for n in names]
    return ("WITH " + ", ".join(steps) + f""", ready AS (SELECT *, {q.roll('stddev_samp', 'daily_return', 20)} AS rolling_volatility_20d,
  adj_close / sma_50 - 1 AS price_over_sma50, adj_close / sma_200 - 1 AS price_over_sma200,
  {q.roll('avg', 'intraday_range', 10)} AS intraday_range_10d_ma, {q.rsi('gain0', 'loss0')} AS rsi_14 FROM eq1)
SELECT * FROM ready WHERE row_nr > 200 AND rsi_14 IS NOT NULL""")


@query(BRAND_SHAPE, "brand_bars", _brand_equity_sql())
def equity_features_brands(spark, sf_dir):
    """Daily equity bundle over the wide brand panel."""
    return equity_features(brand_bars(spark, sf_dir))


CRYPTO_SHAPE = Shape(
    "asset d", r6="ret_1d ret_5d ret_21d ret_63d vol_21d vol_63d px_over_sma_10 px_over_sma_50 px_over_sma_200 "
                  "rsi_14 vol_zscore_21d", r3="macd macd_signal")


@query(CRYPTO_SHAPE, "cf_m", "cf_m")
def crypto_features_monthly(spark, sf_dir):
    """Daily crypto bundle with annualised volatility and a volume score."""
    return crypto_features(segment_bars(spark, sf_dir), "monthly")


@query(CRYPTO_SHAPE, "cf_w", "cf_w")
def crypto_features_weekly(spark, sf_dir):
    """Daily crypto bundle with raw volatility and a volatility score."""
    return crypto_features(segment_bars(spark, sf_dir), "weekly")


@query(CRYPTO_SHAPE, "cf_w", "cf_w")
def crypto_features_blocks(spark, sf_dir):
    """The weekly variant of the crypto bundle computed in overlapping blocks."""
    return crypto_features(settled_bars(spark, sf_dir), "weekly", block_rows=512)


@query(Shape("asset d", r6="month_pos_frac"), "eq0", """
SELECT asset, d, avg(CASE WHEN daily_return > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
  OVER (PARTITION BY asset, last_day(d)) AS month_pos_frac FROM eq0""")
def breadth(spark, sf_dir):
    """Share of up days in the month of each bar."""
    df = segment_bars(spark, sf_dir).withColumn("daily_return", lag_return("adj_close", Series()))
    return up_day_share(df, F.last_day("d"))


_ALIGNED = f"""SELECT asset, d, last_value(VIX IGNORE NULLS) {q.over('all')} AS v, last_value(TNX IGNORE NULLS) {q.over('all')} AS t
  FROM (SELECT b.asset, b.d, m.VIX, m.TNX FROM bars b LEFT JOIN macro m ON m.d = b.d)"""
_MACRO = f"""SELECT asset, d, v AS vix_level, {q.chg('v', 5)} AS vix_5d_change, {q.roll('avg', 'v', 20)} AS vix_20d_ma,
  {q.roll('stddev_samp', 'v', 20)} AS vix_20d_vol, t / 10.0::DOUBLE AS rate_10y,
  t / 10.0::DOUBLE - {q.lag('t / 10.0::DOUBLE', 20)} AS rate_10y_20d_change FROM ({_ALIGNED})"""


@query(Shape("asset d", r6="vix_level vix_5d_change vix_20d_ma vix_20d_vol rate_10y rate_10y_20d_change"),
       "bars macro", _MACRO)
def macro_align(spark, sf_dir):
    """Macro columns by exact date, carried along each asset's own dates."""
    macro = widen_quotes(macro_quotes(spark, sf_dir), TICKERS)
    return macro_features(segment_bars(spark, sf_dir), macro)


@query(Shape("asset d", r6="vix_level rate_10y month_pos_frac", r3="macd macd_signal macd_hist"), "bars macro ewm eq0", f"""
SELECT m.asset, m.d, m.vix_level, m.rate_10y, e.macd, e.macd_signal, e.macd_hist, p.month_pos_frac
FROM ({_MACRO}) m JOIN ewm e ON e.asset = m.asset AND e.d = m.d JOIN (
  SELECT asset, d, avg(CASE WHEN daily_return > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    OVER (PARTITION BY asset, last_day(d)) AS month_pos_frac FROM eq0) p ON p.asset = m.asset AND p.d = m.d""")
def enriched_daily(spark, sf_dir):
    """Macro, MACD and breadth columns added to the daily data in one pass."""
    df = segment_bars(spark, sf_dir).withColumn("daily_return", lag_return("adj_close", Series()))
    return enrich(df, widen_quotes(macro_quotes(spark, sf_dir), TICKERS))


@query(Shape("asset period_end", r6="ret_1m ret_3m ret_6m vol_3m vol_6m"), "month_feats", "month_feats")
def month_return_features(spark, sf_dir):
    """Return sums and deviations over one, three and six months."""
    returns = period_returns(segment_bars(spark, sf_dir)).filter(F.col("ret").isNotNull())
    return monthly_return_features(returns)


@query(Shape("asset period_end", sig="fwd growth"), "week_ret", f"""
SELECT asset, period_end, CASE WHEN count(ret) {q._ahead} = 4 THEN product(1 + ret) {q._ahead} - 1 END AS fwd,
  product(1 + ret) {q.over('all', 0, 'period_end')} AS growth FROM week_ret""")
def forward_compound_4w(spark, sf_dir):
    """Return compounded over the next four weeks, and the running growth so far."""
    weeks = period_returns(segment_bars(spark, sf_dir), "week").filter(F.col("ret").isNotNull())
    return weeks.withColumns({"fwd": forward_growth("ret", 4, PERIODIC), "growth": growth("ret", PERIODIC)})


