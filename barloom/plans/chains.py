"""Chains from labelled daily rows to models: month-end datasets, their checks and cross-validated scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators.indicators import EQUITY_FEATURES
from barloom.operators.clusters import cluster_regimes
from barloom.operators.learning import (
    compare_models, daily_models, expanding_splits, kfold_splits, logistic, period_list, weekly_models,
)
from barloom.operators.resample import last_row, last_valid
from barloom.operators.strategies import lag_features, target_active_wins, target_not_default
from barloom.plans import sql_parts as q
from barloom.plans.backtests import coded, crypto_monthly, crypto_week_dataset, labelled_daily, rules_of
from barloom.plans.choices import LABELLED_DAILY
from barloom.plans.learning import PERF, mean_scores
from barloom.plans.registry import Shape, query
from barloom.session import settle
from barloom.sources.bars import segment_bars, settled_bars
from barloom.sources.checks import complete_rows

FEATURES = " ".join(EQUITY_FEATURES)


def month_rows(bars):
    """Last physical row of each month of the labelled daily table, with the label-not-hold target."""
    return last_row(labelled_daily(bars), "month").withColumn("y", target_not_default())


def wide_months(bars):
    """Month-end last value of every numeric daily column, known a month earlier, beside the month's target."""
    months = last_valid(labelled_daily(bars), "month", list(EQUITY_FEATURES))
    rules = rules_of(bars).withColumn("go_active", target_active_wins()).select("asset", "period_end", "go_active")
    joined = lag_features(months.join(rules, ["asset", "period_end"]), EQUITY_FEATURES)
    return complete_rows(joined.select("asset", "period_end", "go_active", *EQUITY_FEATURES), EQUITY_FEATURES, "go_active")


@query(Shape("asset period_end d best_strategy", n="y", r6=FEATURES), "eq_ready", LABELLED_DAILY + """
SELECT *, last_day(d) AS period_end, CASE WHEN best_strategy = 'buy_hold' THEN 0 ELSE 1 END AS y FROM labelled
QUALIFY row_number() OVER (PARTITION BY asset, last_day(d) ORDER BY d DESC) = 1""")
def month_rows_binary(spark, sf_dir):
    """Dataset of the monthly binary cross-validation."""
    return month_rows(segment_bars(spark, sf_dir))


_WIDE = ", ".join(f"arg_max({c}, d) AS {c}" for c in EQUITY_FEATURES)
_LAGGED = ", ".join(f"lag(m.{c}) OVER (PARTITION BY m.asset ORDER BY m.period_end) AS {c}" for c in EQUITY_FEATURES)


@query(Shape("asset period_end", n="go_active", r6=FEATURES), "eq_ready rules_m", f"""
WITH m AS (SELECT asset, last_day(d) AS period_end, {_WIDE} FROM eq_ready GROUP BY 1, 2),
j AS (SELECT m.asset, m.period_end, CASE WHEN greatest(r.mom, r.mr) > r.bh THEN 1 ELSE 0 END AS go_active, {_LAGGED}
  FROM m JOIN rules_m r ON r.asset = m.asset AND r.period_end = m.period_end)
SELECT * FROM j WHERE {" AND ".join(f"{c} IS NOT NULL" for c in EQUITY_FEATURES)}""")
def wide_binary_dataset(spark, sf_dir):
    """Dataset of the binary backtest on all daily features."""
    return wide_months(segment_bars(spark, sf_dir))


SCORES = Shape("model", n="folds", sig="accuracy balanced_accuracy")


@query(SCORES)
def cv_monthly_binary(spark, sf_dir):
    """Logistic regression on the months' last rows: leave holding or not, five expanding folds."""
    data = settle(complete_rows(month_rows(segment_bars(spark, sf_dir)), EQUITY_FEATURES, "y"), "period_end")
    return mean_scores(compare_models(data, EQUITY_FEATURES, "y", [logistic()], kfold_splits(period_list(data))))


def daily_scores(spark, sf_dir, models):
    rows = labelled_daily(segment_bars(spark, sf_dir)).dropna("any", subset=["best_strategy"])
    codes = F.create_map(*[F.lit(x) for i, n in enumerate(("buy_hold", "momentum", "mean_reversion")) for x in (n, i)])
    data = settle(rows.withColumn("y", codes[F.col("best_strategy")]), "d")
    folds = kfold_splits(period_list(data, "d"))
    return mean_scores(compare_models(data, EQUITY_FEATURES, "y", models, folds, period="d"))


@query(SCORES)
def cv_daily_logistic(spark, sf_dir):
    """Logistic regression on the labelled daily rows, five expanding folds over the days."""
    return daily_scores(spark, sf_dir, [logistic()])


@query(SCORES)
def cv_daily_comparison(spark, sf_dir):
    """Logistic regression, forest and boosting on the same rows and folds."""
    return daily_scores(spark, sf_dir, daily_models())


def weekly_scores(spark, sf_dir, models):
    data = settle(coded(crypto_week_dataset(segment_bars(spark, sf_dir))), "period_end")
    features = q.CRYPTO
    return mean_scores(compare_models(data, features, "y", models, kfold_splits(period_list(data))))


@query(SCORES)
def cv_weekly_logistic(spark, sf_dir):
    """Logistic regression (C of a half, 500 iterations) on the weekly set, five expanding folds."""
    return weekly_scores(spark, sf_dir, [logistic(0.5, 500)])


@query(SCORES)
def cv_weekly_comparison(spark, sf_dir):
    """Logistic regression, forest and boosting on the same set and folds."""
    return weekly_scores(spark, sf_dir, weekly_models())


@query(Shape("asset period_end", n="fold y_true y_pred go_active", sig="p_active"))
def walkforward_wide_binary(spark, sf_dir):
    """Probability of leaving holding from all daily features, expanding, refitted each month."""
    data = settle(wide_months(segment_bars(spark, sf_dir)), "period_end")
    splits = expanding_splits(period_list(data), 60)
    pred = compare_models(data, EQUITY_FEATURES, "go_active", [logistic()], splits).drop("model")
    return pred.withColumn("go_active", (F.col("p_active") >= 0.55).cast("int"))


@query(Shape("asset period_end best_strategy", n="regime"))
def regimes_month_rows(spark, sf_dir):
    """K-means market regimes of the months' last daily features."""
    data = settle(complete_rows(month_rows(segment_bars(spark, sf_dir)), EQUITY_FEATURES))
    return cluster_regimes(data, EQUITY_FEATURES)


@query(Shape("regime", n="size", sig=" ".join(f"mean_{c}" for c in EQUITY_FEATURES)))
def regimes_month_profile(spark, sf_dir):
    """Size and feature means of each of these regimes."""
    data = settle(complete_rows(month_rows(segment_bars(spark, sf_dir)), EQUITY_FEATURES))
    return cluster_regimes(data, EQUITY_FEATURES).groupBy("regime").agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in EQUITY_FEATURES])


@query(PERF)
def perf_crypto_monthly(spark, sf_dir):
    """Monthly crypto backtest end to end."""
    return crypto_monthly(settled_bars(spark, sf_dir)).performance()
