"""Backtests end to end on the segment panel."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.operators.learning import boosting, forest, logistic
from barloom.plans import backtests
from barloom.session import scratch_path
from barloom.sources.bars import settled_bars
from tests.conftest import collect


@pytest.fixture(scope="module")
def bars(spark, sf_dir):
    return settled_bars(spark, sf_dir)


def test_monthly_backtest_and_its_tables(spark, bars):
    test = backtests.equity_monthly(bars, forest(3, 3), refit_every=12)
    rows = collect(test.return_matrix(), ("asset", "period_end"))
    assert len(rows) == backtests.rules_of(bars).count()
    assert all(min(abs(r["ml"] - r[c]) for c in ("bh", "mom", "mr")) < 1e-12 or r["ml"] == 0 for r in rows)
    assert all(r["oracle"] >= max(r["bh"], r["mom"], r["mr"]) for r in rows)
    path = scratch_path(spark, "saved")
    test.save(path)
    assert spark.read.parquet(f"{path}/returns").count() == len(rows)
    assert spark.read.parquet(f"{path}/equity").count() == len(rows)
    table = collect(spark.read.parquet(f"{path}/performance"), ("asset", "strategy"))
    assert len(table) == 25 and {r["strategy"] for r in table} == set(backtests.WITH_ML.values())


def test_point_in_time_features_are_one_period_old(bars):
    now = {(r["asset"], r["period_end"]): r for r in backtests.monthly_return_features(backtests.rules_of(bars)).collect()}
    order = sorted(now)
    before = {b: a for a, b in zip(order, order[1:]) if a[0] == b[0]}
    rows = backtests.month_dataset(bars, "point_in_time").collect()
    assert rows
    for r in rows:
        old = now[before[(r["asset"], r["period_end"])]]
        assert r["ret_1m"] == old["ret_1m"] and r["vol_6m"] == old["vol_6m"]


def test_other_backtests_run_on_their_predicted_periods(bars):
    switch = backtests.binary_switch(bars, logistic(max_iter=20), refit_every=12)
    assert switch.strategies["ml"] == "ML Binary"
    assert switch.return_matrix().count() == backtests.binary_predictions(bars, logistic(max_iter=20), refit_every=12).count()
    week = backtests.crypto_weekly(bars, forest(2, 2), min_train=10, refit_every=40, alignment="point_in_time")
    returns = week.return_matrix()
    assert not returns.isEmpty()
    assert returns.filter(F.col("oracle") < F.col("ml") - 1e-12).isEmpty()


def test_monthly_crypto_needs_two_years(bars):
    data = backtests.crypto_month_dataset(bars)
    pred = backtests.crypto_month_predictions(bars, boosting(1, .1, 1), refit_every=24)
    first = data.agg(F.min("period_end")).first()[0]
    assert pred.filter(F.months_between("period_end", F.lit(first)) < 24).isEmpty()
