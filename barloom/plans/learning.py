"""Queries that train models walk-forward on the pooled panel.

All queries run with the published settings: every round and tree, a refit at each period. Boosted runs take
long (the README has what was measured).
What is exact about a walk-forward run, its windows, scaling and class weights, is checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators.indicators import CRYPTO_FEATURES
from barloom.operators.clusters import cluster_regimes
from barloom.operators.learning import (
    boosting, compare_models, daily_models, kfold_splits, logistic, monthly_models, period_list,
    rolling_splits,
)
from barloom.operators.metrics import accuracy, shares
from barloom.plans.backtests import (
    MONTH_FEATURES, binary_predictions, binary_switch, coded, crypto_month_dataset, crypto_month_predictions,
    crypto_weekly, equity_monthly, month_dataset, month_predictions,
)
from barloom.plans.registry import Shape, query
from barloom.session import settle
from barloom.sources.bars import segment_bars, settled_bars

PREDICTIONS = Shape("asset period_end", n="fold y_true y_pred")
PERF = Shape("asset strategy", n="periods", sig="total_return annualized_return annualized_vol sharpe", r6="max_drawdown")


@query(Shape("asset period_end", n="fold y_true y_pred go_active", sig="p_active"))
def walkforward_lr_binary(spark, sf_dir):
    """Probability of leaving holding, from an expanding logistic regression, with its decision."""
    pred = binary_predictions(segment_bars(spark, sf_dir))
    return pred.withColumn("go_active", (F.col("p_active") >= 0.55).cast("int"))


@query(PERF)
def perf_binary_switch(spark, sf_dir):
    """Performance of the probability-gated switch beside the static rules, over its test months."""
    return binary_switch(settled_bars(spark, sf_dir)).performance()


@query(PREDICTIONS)
def walkforward_gbt(spark, sf_dir):
    """Boosted trees that pick next month's rule, expanding window of sixty months and more."""
    return month_predictions(segment_bars(spark, sf_dir), boosting(200, 0.05, 3))


@query(PREDICTIONS)
def walkforward_lr_point_in_time(spark, sf_dir):
    """The same choice from lagged features and labels that are known before the tested month."""
    return month_predictions(segment_bars(spark, sf_dir), logistic(), alignment="point_in_time")


@query(PERF)
def perf_adaptive(spark, sf_dir):
    """Performance of following the boosted choice, zero before the first prediction."""
    return equity_monthly(settled_bars(spark, sf_dir)).performance()


@query(PREDICTIONS)
def walkforward_gbt_calendar(spark, sf_dir):
    """Boosted trees on the five calendar years before each month."""
    return crypto_month_predictions(settled_bars(spark, sf_dir))


@query(PERF)
def perf_adaptive_weekly(spark, sf_dir):
    """Weekly adaptive performance: boosted trees on 104 weeks and more."""
    return crypto_weekly(settled_bars(spark, sf_dir)).performance()


def mean_scores(predictions):
    """Mean of the per-fold accuracies of each model."""
    return accuracy(predictions, ["model", "fold"]).groupBy("model").agg(
        F.count(F.lit(1)).alias("folds"), F.avg("accuracy").alias("accuracy"),
        F.avg("balanced_accuracy").alias("balanced_accuracy"))


@query(Shape("model", n="folds", sig="accuracy balanced_accuracy"))
def cv_model_comparison(spark, sf_dir):
    """Mean fold accuracies of three model families over the expanding five-fold split."""
    data = settle(coded(month_dataset(segment_bars(spark, sf_dir))), "period_end")
    return mean_scores(compare_models(data, MONTH_FEATURES, "y", daily_models(), kfold_splits(period_list(data))))


@query(Shape("model", n="folds", sig="accuracy balanced_accuracy"))
def cv_rolling_comparison(spark, sf_dir):
    """Mean accuracies of conservative models trained on sliding windows with robust scaling."""
    data = settle(coded(crypto_month_dataset(settled_bars(spark, sf_dir))), "period_end")
    splits = rolling_splits(period_list(data))
    return mean_scores(compare_models(data, CRYPTO_FEATURES, "y", monthly_models(), splits))


def regimes(spark, sf_dir):
    return cluster_regimes(settle(month_dataset(segment_bars(spark, sf_dir))), MONTH_FEATURES)


@query(Shape("asset period_end best_strategy", n="regime"))
def regimes_kmeans(spark, sf_dir):
    """K-means market regimes of the monthly features beside their label."""
    return regimes(spark, sf_dir)


@query(Shape("best_strategy", n="regime n", r6="share"))
def regimes_label_mix(spark, sf_dir):
    """Label distribution inside each k-means regime."""
    return shares(regimes(spark, sf_dir), "best_strategy", ["regime"])


# --- what is exact about a run --------------------------------------------------------------------------

_CODED = """
WITH data AS (SELECT *, CASE best_strategy WHEN 'Buy & Hold' THEN 0 WHEN 'Momentum' THEN 1 ELSE 2 END AS y FROM ml_data),
p AS (SELECT period_end, row_number() OVER (ORDER BY period_end) AS pos FROM (SELECT DISTINCT period_end FROM data)),
f AS (SELECT t.pos - 60 AS fold, d.* FROM p t JOIN p e ON e.pos < t.pos JOIN data d ON d.period_end = e.period_end WHERE t.pos > 60)
"""


def before(key):
    """The periods before a row's own; ``key`` parts a table of one row per period."""
    return Window.partitionBy(key).orderBy("period_end").rowsBetween(Window.unboundedPreceding, -1)


def month_folds(rows, key):
    """Rows that have sixty periods before them, with the number of their fold."""
    at = F.row_number().over(Window.partitionBy(key).orderBy("period_end"))
    return rows.withColumn("fold", at - 60).where("fold > 0")


@query(Shape("feature train_from train_to", n="fold n_train", sig="mean deviation"), "ml_data", _CODED + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, fold, min(period_end) AS train_from, max(period_end) AS train_to, count(*) AS n_train, "
    f"avg({c}) AS mean, stddev_pop({c}) AS deviation FROM f GROUP BY fold" for c in MONTH_FEATURES))
def walkforward_scaling(spark, sf_dir):
    """Bounds, rows, centre and scale of every training window of the monthly run."""
    data = coded(month_dataset(segment_bars(spark, sf_dir)))
    sides = [x for c in MONTH_FEATURES for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]
    stack = ", ".join(f"'{c}', m_{c}, v_{c}" for c in MONTH_FEATURES)
    by_period = data.groupBy("period_end").agg(F.count(F.lit(1)).alias("n"), *sides).selectExpr(
        "period_end", "n", f"stack({len(MONTH_FEATURES)}, {stack}) AS (feature, m, v)")
    w, m = before("feature"), F.col("m")
    n = F.sum("n").over(w)
    mean, square = F.sum(F.col("n") * m).over(w) / n, F.sum(F.col("n") * (F.col("v") + m * m)).over(w) / n
    rows = by_period.select("feature", "period_end", F.min("period_end").over(w).alias("train_from"),
                            F.max("period_end").over(w).alias("train_to"), n.alias("n_train"), mean.alias("mean"),
                            F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("deviation"))
    return month_folds(rows, "feature")


@query(Shape("", n="fold y n", sig="weight"), "ml_data", _CODED + """
SELECT fold, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY fold) / (count(*) OVER (PARTITION BY fold) * count(*)::DOUBLE) AS weight
FROM f GROUP BY fold, y""")
def walkforward_weights(spark, sf_dir):
    """Balanced class weights of every training window of the monthly run."""
    data = coded(month_dataset(segment_bars(spark, sf_dir)))
    counts = data.groupBy("period_end").agg(*[F.count_if(F.col("y") == y).alias(f"n_{y}") for y in range(3)])
    rows = counts.selectExpr("period_end", "stack(3, 0, n_0, 1, n_1, 2, n_2) AS (y, c)")
    seen = month_folds(rows.withColumn("n", F.sum("c").over(before("y"))), "y").where("n > 0")
    fold = Window.partitionBy("fold")
    return seen.withColumn("weight", F.sum("n").over(fold) / (F.count(F.lit(1)).over(fold) * F.col("n")))


@query(Shape("asset period_end", n="fold y_true"), "ml_data", _CODED + """
SELECT d.asset, d.period_end, p.pos - 60 AS fold, d.y AS y_true FROM data d JOIN p ON p.period_end = d.period_end WHERE p.pos > 60""")
def walkforward_tested_rows(spark, sf_dir):
    """Every row that a logistic run over all periods predicts, with its fold and its true class."""
    return month_predictions(segment_bars(spark, sf_dir), logistic())
