"""Folds, scaling and the models trained on them."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.frames import PERIODIC
from barloom.operators.folds import calendar_folds, expanding_folds, kfold_table, rolling_folds
from barloom.operators.clusters import cluster_regimes
from barloom.operators.learning import (
    boosting, calendar_splits, expanding_splits, fit_predict, forest, kfold_splits, logistic,
    monthly_models, period_list, rolling_splits, walk_forward, weekly_models, daily_models,
)
from barloom.session import settle
from tests.conftest import collect


def month_ends(n, year=2010):
    out = []
    for i in range(1, n + 1):
        y, m = divmod(i, 12)
        out.append(dt.date(year + y, m + 1, 1) - dt.timedelta(1))
    return out


@pytest.fixture(scope="module")
def months(spark):
    rows = [(a, d, float(i % 7), float((i * i) % 5)) for a in ("A", "B") for i, d in enumerate(month_ends(73))]
    return spark.createDataFrame(rows, "asset string, period_end date, x double, z double")


def test_kfold_positions(months):
    rows = collect(kfold_table(months), ("asset", "fold"))[:5]
    assert [r["test_lo"] for r in rows] == [13, 25, 37, 49, 61]
    assert [r["test_hi"] for r in rows] == [24, 36, 48, 60, 72]
    assert all(r["train_lo"] == 0 and r["train_hi"] == r["test_lo"] - 1 for r in rows)
    splits = kfold_splits(month_ends(73))
    assert [(s.test_from, s.test_to) for s in splits] == [(r["test_from"], r["test_to"]) for r in rows]


def test_too_short_series_has_no_folds(spark, months):
    assert kfold_table(months.filter(F.col("period_end") < "2010-06-01")).isEmpty()
    with pytest.raises(ValueError, match="too few"):
        kfold_splits(month_ends(5))
    with pytest.raises(ValueError, match="more than 60"):
        expanding_splits(month_ends(60), 60)
    with pytest.raises(ValueError, match="more than 60"):
        rolling_splits(month_ends(60))


def test_splits_never_overlap():
    periods = month_ends(100)
    for splits in (expanding_splits(periods, 60, 7), rolling_splits(periods, 60, 7), calendar_splits(periods, refit_every=7),
                   kfold_splits(periods), expanding_splits(periods, 60, 7, embargo=4)):
        tested = []
        for s in splits:
            assert s.train_from <= s.train_to < s.test_from <= s.test_to
            tested += [p for p in periods if s.test_from <= p <= s.test_to]
        assert tested == sorted(set(tested)) and tested[-1] == periods[-1]
    late = expanding_splits(periods, 60, 7, embargo=4)[0]
    assert periods.index(late.test_from) - periods.index(late.train_to) == 5


def test_calendar_window_clips(spark, months):
    folds = {r["period_end"]: r for r in collect(calendar_folds(months), ("asset", "period_end"))}
    april = folds[dt.date(2014, 4, 30)]
    assert april["train_end"] == dt.date(2014, 3, 30) and april["train_to"] == dt.date(2014, 2, 28)
    assert folds[dt.date(2014, 5, 31)]["train_to"] == dt.date(2014, 4, 30)
    assert min(f["n_train"] for f in folds.values()) >= 24
    split = {s.test_from: s for s in calendar_splits(month_ends(73))}
    assert set(split) == set(folds)
    for d, s in split.items():
        assert s.train_to == folds[d]["train_end"] and s.train_from == folds[d]["train_start"]


def test_fold_rows(months):
    assert expanding_folds(months).count() == rolling_folds(months).count() == 26
    row = collect(rolling_folds(months), ("asset", "pos"))[0]
    assert (row["train_lo"], row["train_hi"], row["train_to"]) == (0, 59, month_ends(60)[-1])


def test_logistic_regression_is_at_the_optimum(spark):
    """Mean-loss gradient of the fitted weights, computed by hand with balanced weights and C = 1."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [1, 5] + [2, -1]
    y = (x[:, 0] * 1.5 - x[:, 1] * .3 + rng.normal(size=300) > 2.5).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, y int").coalesce(1)
    p = np.array([r["p_active"] for r in fit_predict(df, df, ["a", "b"], "y", logistic()).collect()])
    z = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    logit = np.log(p / (1 - p))
    coef = np.linalg.lstsq(np.c_[z, np.ones(300)], logit, rcond=None)[0]
    grad = z.T @ (w * (p - y)) + coef[:2]
    assert np.abs(grad).max() < 1e-2 and abs((w * (p - y)).sum()) < 1e-2


def test_predictions_cover_every_test_row(spark, months):
    data = settle(months.withColumn("y", (F.col("x") % 3).cast("int")))
    splits = expanding_splits(period_list(data), 60, refit_every=7)
    for model in (logistic(), forest(5, 3), boosting(2, .1, 2)):
        rows = collect(walk_forward(data, ["x", "z"], "y", model, splits), ("asset", "period_end"))
        assert [(r["asset"], r["period_end"]) for r in rows] == [(a, d) for a in ("A", "B") for d in month_ends(73)[60:]]
        assert {r["y_pred"] for r in rows} <= {0, 1, 2}
        assert all(r["y_true"] == int(data_x % 3) for r, data_x in zip(rows, [i % 7 for i in range(60, 73)] * 2))


def test_one_class_window_predicts_that_class(spark, months):
    one = months.withColumn("y", F.lit(2))
    rows = fit_predict(one, one, ["x"], "y", boosting(2)).select("y_pred").distinct().collect()
    assert [r[0] for r in rows] == [2]
    assert fit_predict(one.filter("x < 0"), one, ["x"], "y", boosting(2)) is None
    with pytest.raises(ValueError, match="no split"):
        walk_forward(one.filter("x < 0"), ["x"], "y", boosting(2), kfold_splits(month_ends(73)))


def test_regimes_are_ordered_and_complete(spark):
    rng = np.random.default_rng(5)
    rows = [("A", d, float(c * 10 + rng.normal()), float(rng.normal())) for d, c in zip(month_ends(60), [2, 0, 1] * 20)]
    df = spark.createDataFrame(rows, "asset string, period_end date, x double, z double")
    got = collect(cluster_regimes(settle(df), ["x"], starts=3), ("period_end",))
    assert [r["regime"] for r in got] == [2, 0, 1] * 20


def test_published_settings():
    assert [m.name for m in daily_models()] == [m.name for m in monthly_models()] == [m.name for m in weekly_models()]
    lr = logistic(0.5, 500)
    assert (lr.c, lr.steps, lr.scaler) == (0.5, 500, "standard")
    rf = forest()
    assert (rf.trees, rf.depth, rf.leaf) == (200, None, 5)
    gb = boosting()
    assert (gb.rounds, gb.rate, gb.depth, gb.subsample) == (200, .05, 3, 1.0)


def test_frames_before_a_row_exclude_it(months):
    rows = collect(months.withColumn("n", F.count("x").over(PERIODIC.before)), ("asset", "period_end"))
    assert [r["n"] for r in rows[:4]] == [0, 1, 2, 3]
