"""Hand-sized series with expected values, and pandas as a second opinion on longer ones."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.functions.frames import PERIODIC, Series, ffill, forward_growth, lag_return, rolling_mean, rolling_std
from barloom.functions.scalars import first_argmax, infer_choice, row_max
from barloom.operators.indicators import align_macro, crypto_features, equity_features, rolling_drawdown, rsi, widen_quotes
from barloom.operators.resample import last_row, period_returns, resample_last
from barloom.operators.smoothing import ewm, ewm_by_year, macd
from tests.conftest import collect

S = Series()
CLOSES = [100, 102, 101, 101, 104, 103, 103, 99, 100]
DAYS = [dt.date(2024, 1, d) for d in (25, 26, 29, 30, 31)] + [dt.date(2024, 2, d) for d in (1, 2, 5, 6)]


def bars_of(spark, closes, days, asset="A"):
    rows = [(asset, d, float(c), float(c), float(c), float(c), float(c), 1.0) for d, c in zip(days, closes)]
    return spark.createDataFrame(
        rows, "asset string, d date, open double, high double, low double, close double, adj_close double, volume double")


def near(got, want, tol=1e-8):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if w is None:
            assert g is None
        else:
            assert g == pytest.approx(w, rel=tol, abs=tol)


@pytest.fixture(scope="module")
def daily(spark):
    return bars_of(spark, CLOSES, DAYS)


def column(df, expr, order="d"):
    return [r["x"] for r in collect(df.withColumn("x", expr), (order,))]


def test_changes_and_rolling(daily):
    near(column(daily, lag_return("close", S)),
         [None, .02, -.00980392, 0, .02970297, -.00961538, 0, -.03883495, .01010101], 1e-7)
    near(column(daily, rolling_mean("close", 3, S)),
         [None, None, 101, 101.33333333, 102, 102.66666667, 103.33333333, 101.66666667, 100.66666667])
    near(column(daily, rolling_std("close", 3, S)),
         [None, None, 1, .57735027, 1.73205081, 1.52752523, .57735027, 2.30940108, 2.081666], 1e-7)
    near(column(daily, rolling_drawdown("close", 4, S)),
         [0, 0, -.00980392, -.00980392, 0, -.00961538, -.00961538, -.04807692, -.02912621], 1e-7)


def test_ewm_small(daily):
    rows = collect(ewm(daily, {"x": ("close", 3)}), ("d",))
    near([r["x"] for r in rows], [100, 101, 101, 101, 102.5, 102.75, 102.875, 100.9375, 100.46875])


def test_rsi_variants(daily):
    null_first = [r["rsi_3"] for r in collect(rsi(daily, n=3, first="null"), ("d",))]
    zero_first = [r["rsi_3"] for r in collect(rsi(daily, n=3, first="zero"), ("d",))]
    near(null_first, [None, None, None, 66.666667, 75, 75, 75, 0, 20], 1e-7)
    near(zero_first, [None, None, 66.666667, 66.666667, 75, 75, 75, 0, 20], 1e-7)


@pytest.mark.parametrize("closes, last", [([1, 2, 3, 4], 100.0), ([2, 2, 2, 2], None), ([4, 3, 2, 1], 0.0)])
def test_rsi_edges(spark, closes, last):
    df = bars_of(spark, closes, DAYS[:4])
    assert collect(rsi(df, n=3, first="null"), ("d",))[-1]["rsi_3"] == last


def test_period_ends(daily):
    months = collect(resample_last(daily, "month", ["close"]), ("period_end",))
    assert [(r["period_end"], r["close"]) for r in months] == [(dt.date(2024, 1, 31), 104), (dt.date(2024, 2, 29), 100)]
    weeks = collect(resample_last(daily, "week", ["close"]), ("period_end",))
    assert [(r["period_end"], r["close"]) for r in weeks] == [
        (dt.date(2024, 1, 26), 102), (dt.date(2024, 2, 2), 103), (dt.date(2024, 2, 9), 100)]


def test_gap_month_is_flat(spark):
    df = bars_of(spark, [10, 12, 9], [dt.date(2024, 1, 31), dt.date(2024, 3, 29), dt.date(2024, 4, 30)])
    months = collect(period_returns(df), ("period_end",))
    assert [r["adj_close"] for r in months] == [10, None, 12, 9]
    near([r["ret"] for r in months], [None, 0.0, .2, -.25])


def test_last_row_keeps_missing_cells_and_resample_does_not(spark):
    df = bars_of(spark, [1, 2], [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]).withColumn(
        "close", F.when(F.col("d") < "2024-01-03", F.col("close")))
    assert collect(last_row(df, "month"), ("period_end",))[0]["close"] is None
    assert collect(resample_last(df, "month", ["close"]), ("period_end",))[0]["close"] == 1.0


def test_week_ends(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 6),), (dt.date(2024, 1, 12),)], "d date")
    assert [r[0] for r in df.select(calendar.week_end("d")).collect()] == [
        dt.date(2024, 1, 5), dt.date(2024, 1, 12), dt.date(2024, 1, 12)]


def test_calendar_clipping(spark):
    days = [dt.date(2020, 4, 30), dt.date(2020, 3, 31), dt.date(2020, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [tuple(r) for r in df.select(calendar.months_before("d", 1), calendar.months_before("d", 60)).collect()]
    assert [g[0] for g in got] == [dt.date(2020, 3, 30), dt.date(2020, 2, 29), dt.date(2020, 1, 29)]
    assert got[2][1] == dt.date(2015, 2, 28)


def test_choice_inference(spark):
    df = spark.createDataFrame(
        [(.02, 0., 0., .02), (.02, 0., 0., 0.), (.02, .02, .01, 0.), (.02, 0., 0., .03), (.02, 0., 0., None)],
        "bh double, mom double, mr double, ml double")
    got = [r[0] for r in df.select(infer_choice("ml", {"BH": "bh", "Momentum": "mom", "MR": "mr"})).collect()]
    assert got == ["BH", "Momentum", "Cash/0", "Unknown", "None"]


def test_argmax_ties_and_missing(spark):
    df = spark.createDataFrame([(1., 1., 0.), (None, 2., 2.), (None, None, None), (0., 1., 2.)], "a double, b double, c double")
    named = {"a": "a", "b": "b", "c": "c"}
    assert [r[0] for r in df.select(first_argmax(named)).collect()] == ["a", "b", None, "c"]
    assert [r[0] for r in df.select(row_max(list(named))).collect()] == [1., 2., None, 2.]


def random_series(n, seed, drop=0.3):
    rng = np.random.default_rng(seed)
    days = pd.date_range("2001-03-05", periods=n, freq="D").date
    keep = rng.random(n) > drop
    price = np.exp(np.cumsum(rng.normal(0, .03, n))) * 50
    return [d for d, k in zip(days, keep) if k], price[keep]


@pytest.mark.parametrize("seed, drop", [(1, 0.0), (2, 0.4), (3, 0.97)])
def test_ewm_across_years_equals_recursion(spark, seed, drop):
    days, price = random_series(1500, seed, drop)
    df = bars_of(spark, price, days)
    rows = collect(ewm(df, {f"e{n}": ("adj_close", n) for n in (2, 9, 12, 20, 26)}), ("d",))
    for n in (2, 9, 12, 20, 26):
        want = pd.Series(price).ewm(span=n, adjust=False).mean()
        np.testing.assert_allclose([r[f"e{n}"] for r in rows], want, rtol=1e-12)


def test_macd_signal_equals_chained_means(spark):
    days, price = random_series(1200, 5)
    rows = collect(macd(bars_of(spark, price, days)), ("d",))
    p = pd.Series(price)
    line = p.ewm(span=12, adjust=False).mean() - p.ewm(span=26, adjust=False).mean()
    signal = line.ewm(span=9, adjust=False).mean()
    np.testing.assert_allclose([r["macd"] for r in rows], line, atol=1e-11)
    np.testing.assert_allclose([r["macd_signal"] for r in rows], signal, atol=1e-11)
    np.testing.assert_allclose([r["macd_hist"] for r in rows], line - signal, atol=1e-11)


def test_equity_bundle_equals_pandas(spark):
    days, price = random_series(700, 7)
    rows = collect(equity_features(bars_of(spark, price, days)), ("d",))
    p = pd.Series(price)
    r = p.pct_change()
    delta = p.diff()
    gain = delta.where(delta > 0, 0.0).rolling(14).mean()
    loss = (-delta).where(delta < 0, 0.0).rolling(14).mean()
    want = pd.DataFrame({
        "daily_return": r, "rolling_volatility_60d": r.rolling(60).std(), "price_over_sma200": p / p.rolling(200).mean() - 1,
        "mom_60d": p / p.shift(60) - 1, "rsi_14": 100 - 100 / (1 + gain / loss), "ema_20": p.ewm(span=20, adjust=False).mean(),
        "drawdown_60d": p / p.rolling(60, min_periods=1).max() - 1,
    }).iloc[200:]
    assert len(rows) == len(want)
    for c in want:
        np.testing.assert_allclose([row[c] for row in rows], want[c], rtol=1e-9, atol=1e-11)


def test_crypto_weekly_score_equals_pandas(spark):
    days, price = random_series(800, 8)
    rows = collect(crypto_features(bars_of(spark, price, days), "weekly"), ("d",))
    vol = pd.Series(price).pct_change().rolling(21).std()
    want = (vol - vol.rolling(252).mean()) / vol.rolling(252).std()
    got = [math.nan if r["vol_zscore_21d"] is None else r["vol_zscore_21d"] for r in rows]
    np.testing.assert_allclose(got, want, rtol=1e-7, atol=1e-9)
    with pytest.raises(ValueError):
        crypto_features(bars_of(spark, price, days), "hourly")


def test_macro_is_carried_only_from_own_dates(spark):
    df = bars_of(spark, [1, 2, 3], [dt.date(2024, 1, 2), dt.date(2024, 1, 5), dt.date(2024, 1, 8)])
    macro = spark.createDataFrame([(dt.date(2024, 1, 2), 10.), (dt.date(2024, 1, 4), 99.), (dt.date(2024, 1, 8), 12.)], "d date, VIX double")
    assert [r["VIX"] for r in collect(align_macro(df, macro, ["VIX"]), ("d",))] == [10., 10., 12.]


def test_wide_quotes_carry_over_year_ends(spark):
    quotes = spark.createDataFrame([
        ("a", dt.date(2021, 12, 30), "adj_close", 1.), ("b", dt.date(2021, 12, 31), "adj_close", 5.),
        ("b", dt.date(2023, 1, 2), "adj_close", 6.), ("a", dt.date(2023, 1, 3), "adj_close", 2.),
        ("a", dt.date(2023, 1, 3), "volume", 7.)], "ticker string, d date, field string, value double")
    rows = collect(widen_quotes(quotes, {"a": "A", "b": "B"}), ("d",))
    assert [(r["A"], r["B"]) for r in rows] == [(1., None), (1., 5.), (1., 6.), (2., 6.)]


def test_forward_growth_needs_all_rows(spark):
    df = spark.createDataFrame([("A", i, r) for i, r in enumerate([.1, -.5, -1.5, .2])], "asset string, period_end int, r double")
    near(column(df, forward_growth("r", 2, PERIODIC), "period_end"), [.5 * -.5 - 1, -.5 * 1.2 - 1, None, None])
    near(column(df, ffill("r", PERIODIC), "period_end"), [.1, -.5, -1.5, .2])


def gappy():
    """Missing values first, inside a year, for a year's last and first days, and for a whole year."""
    days = pd.bdate_range("2019-12-02", "2023-02-10")
    rng = np.random.default_rng(4)
    x = pd.Series(100 + rng.normal(size=len(days)).cumsum(), index=days)
    x.iloc[:3] = np.nan
    x[rng.random(len(days)) < .15] = np.nan
    x.loc["2020-12-20":"2021-01-08"] = np.nan
    x.loc["2022-01-01":"2022-12-31"] = np.nan
    return x


@pytest.mark.parametrize("scan", [ewm, ewm_by_year])
def test_means_over_missing_values_equal_pandas(spark, scan):
    x = gappy()
    df = spark.createDataFrame([("A", d.date(), None if np.isnan(v) else float(v)) for d, v in x.items()], "asset string, d date, adj_close double")
    rows = collect(scan(df, {"e3": ("adj_close", 3), "e20": ("adj_close", 20)}, pad={"held": "adj_close"}), ("d",))
    for name, want in {"e3": x.ewm(span=3, adjust=False).mean(), "e20": x.ewm(span=20, adjust=False).mean(), "held": x.ffill()}.items():
        near([r[name] for r in rows], [None if np.isnan(v) else v for v in want])
    line = x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
    rows = collect(macd(df, scan=scan), ("d",))
    near([r["macd_signal"] for r in rows], [None if np.isnan(v) else v for v in line.ewm(span=9, adjust=False).mean()])


def test_small_gap_and_equal_spans(spark):
    df = spark.createDataFrame([("A", d, c) for d, c in zip(DAYS, [100., 102., None, 104., 103.])], "asset string, d date, adj_close double")
    near([r["x"] for r in collect(ewm(df, {"x": ("adj_close", 3)}), ("d",))], [100, 101, 101, 103, 103])
    x = pd.Series([100., 102., np.nan, 104., 103.])
    line = x.ewm(span=9, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
    rows = collect(macd(df, fast=9, slow=26, signal=9), ("d",))
    near([r["macd_signal"] for r in rows], list(line.ewm(span=9, adjust=False).mean()))


def test_changes_carry_the_price_over_gaps(spark):
    closes = [100., 102., None, 104., 103.] * 60
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=300)]
    rows = [("A", d, c, c, c, c, c, 1.0) for d, c in zip(days, closes)]
    bars = spark.createDataFrame(rows, "asset string, d date, open double, high double, low double, close double, adj_close double, volume double")
    held = pd.Series(closes, dtype=float).ffill()
    got = collect(crypto_features(bars, "weekly"), ("d",))
    for name, n in (("ret_1d", 1), ("ret_5d", 5), ("ret_21d", 21)):
        near([r[name] for r in got], [None if np.isnan(v) else v for v in held / held.shift(n) - 1])
