"""Queries over folds, scaling, class weights and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.frames import PERIODIC, lag, rolling_mean
from barloom.functions.scalars import BH, CODES_BH_MOM_MR, CODES_BH_MR_MOM, MOM, MR, STRATEGIES, recode
from barloom.operators.folds import (
    balanced_weights, calendar_folds, expanding_folds, expanding_scale, fold_scale, kfold_table, label_codes,
    robust_scale, rolling_folds, training_stats, with_kfold,
)
from barloom.operators.metrics import (
    accuracy, classification_report, cluster_profile, confusion, describe, equity_wide, last_rows, shares,
)
from barloom.operators.strategies import label_same_period, with_oracle
from barloom.plans import sql_parts as q
from barloom.plans.choices import last_choice, month_rules, monthly_dataset
from barloom.plans.backtests import month_dataset, rules_of
from barloom.plans.registry import Shape, query
from barloom.session import scratch_path
from barloom.sources.bars import segment_bars, table
from barloom.sources.checks import known_label, unknown_labels
from barloom.sources.files import write_checked

FEATURES = ["ret_1m", "ret_3m", "ret_6m", "vol_3m", "vol_6m"]
Z = " ".join(f"z_{c}" for c in FEATURES)
WEIGHTS = {BH: "w_bh", MOM: "w_mom", MR: "w_mr"}


def _before(expr: str) -> str:
    return f"{expr} {q.over('all', -1, 'period_end')}"


@query(Shape("asset test_from test_to", n="fold train_lo train_hi test_lo test_hi"), "kfolds", """
SELECT asset, fold, 0 AS train_lo, min(pos) - 1 AS train_hi, min(pos) AS test_lo, max(pos) AS test_hi,
  min(period_end) AS test_from, max(period_end) AS test_to FROM kfolds WHERE fold IS NOT NULL GROUP BY asset, fold""")
def tssplit_folds(spark, sf_dir):
    """Expanding five-fold time split per asset."""
    return kfold_table(monthly_dataset(spark, sf_dir))


@query(Shape("asset period_end train_from train_to", n="pos train_lo train_hi"), "positions", f"""
SELECT * FROM (SELECT *, pos - 60 AS train_lo, pos - 1 AS train_hi, {q.lag('period_end', 60, 'period_end')} AS train_from,
  {q.lag('period_end', 1, 'period_end')} AS train_to FROM positions) WHERE pos >= 60""")
def rolling60_folds(spark, sf_dir):
    """One-row tests on the sixty rows before them."""
    return rolling_folds(monthly_dataset(spark, sf_dir))


@query(Shape("asset period_end train_from train_to", n="pos train_lo train_hi"), "positions", f"""
SELECT * FROM (SELECT *, 0 AS train_lo, pos - 1 AS train_hi, first_value(period_end) {q.over('all', 0, 'period_end')} AS train_from,
  {q.lag('period_end', 1, 'period_end')} AS train_to FROM positions) WHERE pos >= 60""")
def expanding_month_folds(spark, sf_dir):
    """One-row tests on all rows before them, sixty at least."""
    return expanding_folds(monthly_dataset(spark, sf_dir))


@query(Shape("asset period_end train_start train_end train_from train_to", n="n_train"), "ml_data", """
SELECT * FROM (SELECT t.asset, t.period_end, CAST(t.period_end - INTERVAL 60 MONTH AS DATE) AS train_start,
  CAST(t.period_end - INTERVAL 1 MONTH AS DATE) AS train_end, count(*) AS n_train, min(r.period_end) AS train_from, max(r.period_end) AS train_to
  FROM ml_data t JOIN ml_data r ON r.asset = t.asset AND r.period_end BETWEEN CAST(t.period_end - INTERVAL 60 MONTH AS DATE)
    AND CAST(t.period_end - INTERVAL 1 MONTH AS DATE) GROUP BY 1, 2) WHERE n_train >= 24""")
def calendar_month_folds(spark, sf_dir):
    """Training windows from five years to one month before each month, 24 rows at least."""
    return calendar_folds(monthly_dataset(spark, sf_dir))


@query(Shape("asset period_end", n="n_expanding n_trailing n_calendar", r6="mean_expanding mean_trailing mean_calendar"), "ml_data", f"""
SELECT a.*, c.n_calendar, c.mean_calendar FROM (
  SELECT asset, period_end, {_before('count(ret_1m)')} AS n_expanding, {_before('avg(ret_1m)')} AS mean_expanding,
    count(ret_1m) {q.over(60, -1, 'period_end')} AS n_trailing, avg(ret_1m) {q.over(60, -1, 'period_end')} AS mean_trailing FROM ml_data) a
JOIN (SELECT t.asset, t.period_end, count(r.ret_1m) AS n_calendar, avg(r.ret_1m) AS mean_calendar
  FROM ml_data t LEFT JOIN ml_data r ON r.asset = t.asset AND r.period_end BETWEEN CAST(t.period_end - INTERVAL 60 MONTH AS DATE)
    AND CAST(t.period_end - INTERVAL 1 MONTH AS DATE) GROUP BY 1, 2) c ON c.asset = a.asset AND c.period_end = a.period_end""")
def training_window_stats(spark, sf_dir):
    """Size and mean of the expanding, trailing and calendar training windows of every row."""
    return training_stats(monthly_dataset(spark, sf_dir), "ret_1m")


def _z(mean: str, scale: str, c: str) -> str:
    return f"({c} - {mean}) / CASE WHEN {scale} = 0 THEN 1.0 ELSE {scale} END AS z_{c}"


@query(Shape("asset period_end", r6=Z), "positions", "SELECT * FROM (SELECT asset, period_end, pos, " + ", ".join(
    _z(_before(f"avg({c})"), _before(f"stddev_pop({c})"), c) for c in FEATURES) + " FROM positions) WHERE pos >= 60")
def expanding_scaler(spark, sf_dir):
    """Standard scores of each row by the rows before it."""
    return expanding_scale(monthly_dataset(spark, sf_dir), FEATURES)


@query(Shape("asset period_end", n="fold", r6=Z), "kfolds", """
WITH t AS (SELECT asset, fold, min(pos) AS lo FROM kfolds WHERE fold IS NOT NULL GROUP BY 1, 2),
s AS (SELECT t.asset, t.fold, """ + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in FEATURES) + """
  FROM t JOIN kfolds k ON k.asset = t.asset AND k.pos < t.lo GROUP BY 1, 2)
SELECT k.asset, k.period_end, k.fold, """ + ", ".join(_z(f"s.m_{c}", f"s.d_{c}", c) for c in FEATURES)
       + " FROM kfolds k JOIN s ON s.asset = k.asset AND s.fold = k.fold")
def fold_scaler(spark, sf_dir):
    """Standard scores of each test block by the rows before the block."""
    return fold_scale(monthly_dataset(spark, sf_dir), FEATURES)


_Q = {c: [f"quantile_cont({c}, {p}) {q.over(60, -1, 'period_end')}" for p in (0.25, 0.5, 0.75)] for c in FEATURES}


@query(Shape("asset period_end", r6=Z), "positions", "SELECT asset, period_end, " + ", ".join(
    f"({c} - q50_{c}) / CASE WHEN q75_{c} - q25_{c} = 0 THEN 1.0 ELSE q75_{c} - q25_{c} END AS z_{c}" for c in FEATURES)
    + " FROM (SELECT *, " + ", ".join(f"{e} AS q{p}_{c}" for c in FEATURES for p, e in zip((25, 50, 75), _Q[c]))
    + " FROM positions) WHERE pos >= 60")
def robust_scaler(spark, sf_dir):
    """Median and quartile-range scores of each row by the sixty rows before it."""
    return robust_scale(monthly_dataset(spark, sf_dir), FEATURES)


_HITS = {w: f"count(CASE WHEN best_strategy = '{s}' THEN 1 END) {q.over('all', -1, 'period_end')}" for s, w in WEIGHTS.items()}


@query(Shape("asset period_end", r6="w_bh w_mom w_mr"), "positions", "SELECT asset, period_end, " + ", ".join(
    f"CASE WHEN c_{w} > 0 THEN n::DOUBLE / (k * c_{w}) END AS {w}" for w in WEIGHTS.values())
    + " FROM (SELECT *, (c_w_bh > 0)::INT + (c_w_mom > 0)::INT + (c_w_mr > 0)::INT AS k, c_w_bh + c_w_mom + c_w_mr AS n FROM (SELECT *, "
    + ", ".join(f"{h} AS c_{w}" for w, h in _HITS.items()) + " FROM positions)) WHERE pos >= 60")
def class_weights(spark, sf_dir):
    """Balanced class weights over the rows before each row."""
    data = expanding_input(spark, sf_dir)
    return balanced_weights(data, "best_strategy", WEIGHTS, PERIODIC.before).filter(F.col("row_nr") > 60)


def expanding_input(spark, sf_dir):
    return monthly_dataset(spark, sf_dir).withColumn("row_nr", F.row_number().over(PERIODIC.rows))


@query(Shape("best_strategy", n="alphabetical_code fixed_code n"), "label_same", """
SELECT best_strategy, row_number() OVER (ORDER BY best_strategy) - 1 AS alphabetical_code,
  CASE best_strategy WHEN 'Buy & Hold' THEN 0 WHEN 'Mean Reversion' THEN 1 ELSE 2 END AS fixed_code, count(*) AS n
FROM label_same GROUP BY 1""")
def label_encoding(spark, sf_dir):
    """Labels with their alphabetical and their fixed code, unexpected labels failing the job."""
    labels = label_same_period(month_rules(spark, sf_dir)).withColumn(
        "best_strategy", known_label("best_strategy", STRATEGIES))
    return label_codes(labels, "best_strategy", CODES_BH_MR_MOM)


@query(Shape("best_strategy"), "label_same", """
SELECT DISTINCT best_strategy FROM label_same WHERE best_strategy NOT IN ('Buy & Hold', 'Momentum')""")
def labels_outside_set(spark, sf_dir):
    """Labels outside an allowed set."""
    return unknown_labels(label_same_period(month_rules(spark, sf_dir)), "best_strategy", (BH, MOM))


@query(Shape("asset period_end best_strategy"), "label_same", "label_same")
def stored_checked_labels(spark, sf_dir):
    """Labels stored with their checks (rows, dates, allowed values) counted by the job that writes them."""
    path = scratch_path(spark, "labels")
    write_checked(label_same_period(month_rules(spark, sf_dir)), path, day_column="period_end", labels={"best_strategy": STRATEGIES})
    return spark.read.parquet(path)


# --- evaluation of the last-winner predictor ------------------------------------------------------------

_CODE = "CASE {c} WHEN 'Buy & Hold' THEN 0 WHEN 'Momentum' THEN 1 WHEN 'Mean Reversion' THEN 2 END"
_PRED = (f"WITH p AS (SELECT asset, period_end, {_CODE.format(c='best_strategy')} AS y_true, {_CODE.format(c='choice')} AS y_pred "
         "FROM pred_lag WHERE choice IS NOT NULL)")


def coded_predictions(spark, sf_dir):
    rules = last_choice(month_rules(spark, sf_dir)).filter(F.col("choice").isNotNull())
    return rules.select("asset", "period_end", recode("best_strategy", CODES_BH_MOM_MR).alias("y_true"),
                        recode("choice", CODES_BH_MOM_MR).alias("y_pred"))


@query(Shape("asset", n="y_true pred_0 pred_1 pred_2"), "pred_lag", _PRED + """
SELECT a.asset, t.y AS y_true, """ + ", ".join(f"count(*) FILTER (WHERE p.y_true = t.y AND p.y_pred = {i}) AS pred_{i}" for i in range(3)) + """
FROM (SELECT DISTINCT asset FROM p) a CROSS JOIN (VALUES (0), (1), (2)) t(y) JOIN p ON p.asset = a.asset GROUP BY 1, 2""")
def confusion_matrix(spark, sf_dir):
    """Confusion counts over the fixed label codes, per asset."""
    return confusion(coded_predictions(spark, sf_dir), [0, 1, 2], ["asset"])


@query(Shape("asset", r6="accuracy balanced_accuracy"), "pred_lag", _PRED + """
SELECT asset, avg((y_true = y_pred)::INT::DOUBLE) AS accuracy, (SELECT avg(r) FROM (
  SELECT avg((i.y_true = i.y_pred)::INT::DOUBLE) AS r FROM p i WHERE i.asset = p.asset GROUP BY i.y_true)) AS balanced_accuracy
FROM p GROUP BY asset""")
def balanced_accuracy(spark, sf_dir):
    """Accuracy and mean recall of the last-winner predictor per asset."""
    return accuracy(coded_predictions(spark, sf_dir), ["asset"])


@query(Shape("asset label", n="support", r6="precision recall f1"), "pred_lag", _PRED + """,
u AS (SELECT asset, y_true AS y FROM p UNION SELECT asset, y_pred FROM p),
c AS (SELECT u.asset, u.y, count(*) FILTER (WHERE p.y_true = u.y) AS support, count(*) FILTER (WHERE p.y_pred = u.y) AS predicted,
  count(*) FILTER (WHERE p.y_true = u.y AND p.y_pred = u.y) AS hits FROM u JOIN p ON p.asset = u.asset GROUP BY 1, 2),
s AS (SELECT asset, CAST(y AS VARCHAR) AS label, support, CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s)
SELECT asset, label, support, precision, recall, f1 FROM f
UNION ALL SELECT asset, 'macro avg', sum(support), avg(precision), avg(recall), avg(f1) FROM f GROUP BY asset
UNION ALL SELECT asset, 'weighted avg', sum(support), sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support) FROM f GROUP BY asset""")
def classification_table(spark, sf_dir):
    """Precision, recall and F1 per class with macro and weighted means."""
    return classification_report(coded_predictions(spark, sf_dir), ["asset"])


@query(Shape("model", n="folds", r6="accuracy balanced_accuracy"), "kfolds pred_lag", f"""
WITH p AS (SELECT k.asset, k.fold, p.best_strategy AS y, m.model, CASE m.model WHEN 'hold' THEN 'Buy & Hold' ELSE p.choice END AS g
  FROM kfolds k JOIN pred_lag p ON p.asset = k.asset AND p.period_end = k.period_end CROSS JOIN (VALUES ('hold'), ('last winner')) m(model)
  WHERE k.fold IS NOT NULL),
c AS (SELECT model, asset, fold, y, count(*) AS n, count(*) FILTER (WHERE y = g) AS h FROM p GROUP BY 1, 2, 3, 4),
f AS (SELECT model, asset, fold, sum(h)::DOUBLE / sum(n) AS acc, avg(h::DOUBLE / n) AS bal FROM c GROUP BY 1, 2, 3)
SELECT model, count(*) AS folds, avg(acc) AS accuracy, avg(bal) AS balanced_accuracy FROM f GROUP BY model""")
def baseline_comparison(spark, sf_dir):
    """Mean fold accuracy of two fixed predictors over the five-fold split of every asset."""
    bars = segment_bars(spark, sf_dir)
    folds = with_kfold(month_dataset(bars)).filter(F.col("fold").isNotNull()).select("asset", "period_end", "fold")
    rows = last_choice(rules_of(bars)).select("asset", "period_end", F.col("best_strategy").alias("y_true"), "choice")
    guesses = folds.join(rows, ["asset", "period_end"]).select(
        "asset", "fold", "y_true", F.inline(F.array(
            F.struct(F.lit("hold").alias("model"), F.lit(BH).alias("y_pred")),
            F.struct(F.lit("last winner").alias("model"), F.col("choice").alias("y_pred")))))
    per_fold = accuracy(guesses, ["model", "asset", "fold"])
    return per_fold.groupBy("model").agg(
        F.count(F.lit(1)).alias("folds"), F.avg("accuracy").alias("accuracy"),
        F.avg("balanced_accuracy").alias("balanced_accuracy"))


# --- descriptive reports --------------------------------------------------------------------------------

@query(Shape("asset field", n="count", r6="min p25 p50 p75 max", r3="mean std"), "bars", " UNION ALL ".join(
    f"""SELECT asset, '{c}' AS field, count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS "min",
  quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS "max" FROM bars GROUP BY asset"""
    for c in ("open", "high", "low", "close", "volume")))
def summary_stats(spark, sf_dir):
    """Count, mean, deviation, extremes and exact quartiles of the bar columns per asset."""
    return describe(segment_bars(spark, sf_dir), ["open", "high", "low", "close", "volume"], ["asset"])


@query(Shape("l_returnflag field", n="count", r6="min p25 p50 p75 max", r3="mean std"), "", " UNION ALL ".join(
    f"""SELECT l_returnflag, '{c}' AS field, count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS "min",
  quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS "max"
  FROM lineitem GROUP BY l_returnflag""" for c in ("l_extendedprice", "l_quantity", "l_discount")))
def summary_stats_trades(spark, sf_dir):
    """The same for raw order lines, in groups of any size: quartiles from refined histograms."""
    fields = ["l_extendedprice", "l_quantity", "l_discount"]
    return describe(table(spark, sf_dir, "lineitem").select("l_returnflag", *fields), fields, ["l_returnflag"], large=True)


_REGIME = f"WITH v AS (SELECT m.*, avg(vol_3m) {q.over(11, 0, 'period_end')} AS base FROM ml_data m), g AS (SELECT *, CASE WHEN vol_3m > 1.2::DOUBLE * base THEN 2 WHEN vol_3m > 0.8::DOUBLE * base THEN 1 ELSE 0 END AS regime FROM v)"


def volatility_regimes(spark, sf_dir):
    """Regimes by rule: volatility against its own trailing mean."""
    data = monthly_dataset(spark, sf_dir).withColumn("base", F.avg("vol_3m").over(PERIODIC.last(12)))
    calm, wild = F.lit(0.8) * F.col("base"), F.lit(1.2) * F.col("base")
    return data.withColumn("regime", F.when(F.col("vol_3m") > wild, 2).when(F.col("vol_3m") > calm, 1).otherwise(0))


@query(Shape("", n="regime size", r3="mean_ret_1m mean_vol_3m mean_vol_6m"), "ml_data", _REGIME + """
SELECT regime, count(*) AS size, avg(ret_1m) AS mean_ret_1m, avg(vol_3m) AS mean_vol_3m, avg(vol_6m) AS mean_vol_6m FROM g GROUP BY 1""")
def regime_profile(spark, sf_dir):
    """Size and feature means per rule-based regime."""
    return cluster_profile(volatility_regimes(spark, sf_dir), ["ret_1m", "vol_3m", "vol_6m"])


@query(Shape("best_strategy", n="regime n", r6="share"), "ml_data", _REGIME + """
SELECT regime, best_strategy, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY regime) AS share FROM g GROUP BY 1, 2""")
def regime_labels(spark, sf_dir):
    """Label distribution inside each regime."""
    return shares(volatility_regimes(spark, sf_dir), "best_strategy", ["regime"])


@query(Shape("asset period_end", sig="eq_bh eq_mom eq_mr eq_oracle"), "rules_m", "WITH e AS (SELECT *, greatest(bh, mom, mr) AS oracle FROM rules_m) SELECT * FROM (SELECT asset, period_end, "
       + ", ".join(f"product(1 + {c}) {q.over('all', 0, 'period_end')} AS eq_{c}" for c in ("bh", "mom", "mr", "oracle"))
       + " FROM e) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY period_end DESC) <= 10")
def last_equity_rows(spark, sf_dir):
    """Last ten rows of every asset's equity matrix in date order."""
    curves = equity_wide(with_oracle(month_rules(spark, sf_dir)), ["bh", "mom", "mr", "oracle"])
    return last_rows(curves, 10).orderBy("asset", "period_end")


@query(Shape("asset period_end", r6="mean_6 prev_ret"), "month_feats", f"""
SELECT asset, period_end, {q.roll('avg', 'ret', 6, 'period_end')} AS mean_6, {q.lag('ret', 1, 'period_end')} AS prev_ret FROM month_feats""")
def trailing_mean_return(spark, sf_dir):
    """Six-month mean return and last month's return."""
    rules = month_rules(spark, sf_dir)
    return rules.withColumns({"mean_6": rolling_mean("ret", 6, PERIODIC), "prev_ret": lag("ret", PERIODIC)})
