"""Queries over rule strategies, labels, targets and followed returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.frames import PERIODIC, lag
from barloom.functions.scalars import CODES_BH_MR_MOM, MOM, MR, SNAKE_LABELS, STRATEGIES, infer_choice, recode
from barloom.operators.indicators import monthly_return_features
from barloom.operators.metrics import allocation, equity_curves, performance, shares
from barloom.operators.resample import period_returns
from barloom.operators.strategies import (
    RULES, follow, gated_follow, label_next_period, label_same_period, monthly_rules, target_active_wins,
    target_not_default, with_oracle,
)
from barloom.plans import sql_parts as q
from barloom.plans.backtests import (
    WITH_ML, WITH_ORACLE, Backtest, binary_dataset, crypto_month_dataset, crypto_month_features,
    crypto_week_dataset, labelled_daily, month_dataset, rules_of, week_rules_of,
)
from barloom.plans.registry import Shape, query
from barloom.session import scratch_path
from barloom.sources import files
from barloom.sources.bars import between_days, brand_bars, segment_bars
from barloom.sources.checks import complete_rows, numeric_features


def month_rules(spark, sf_dir):
    return rules_of(segment_bars(spark, sf_dir))


def week_rules(spark, sf_dir):
    return week_rules_of(segment_bars(spark, sf_dir))


def last_choice(rules):
    """Deterministic predictor: last period's winner."""
    return label_same_period(rules).withColumn("choice", lag("best_strategy", PERIODIC))


def monthly_dataset(spark, sf_dir):
    return month_dataset(segment_bars(spark, sf_dir))


@query(Shape("asset period_end", r6="ret bh mom mr"), "rules_m", "rules_m")
def monthly_strategies(spark, sf_dir):
    """Hold, momentum and reversal returns per month."""
    return month_rules(spark, sf_dir)


@query(Shape("asset period_end", r6="ret bh mom mr"), "rules_w", "rules_w")
def weekly_strategies(spark, sf_dir):
    """Hold, four-week momentum and reversal returns per week."""
    return week_rules(spark, sf_dir)


@query(Shape("asset period_end", r6="bh mom mr oracle"), "rules_m", "SELECT *, greatest(bh, mom, mr) AS oracle FROM rules_m")
def oracle_returns(spark, sf_dir):
    """Best rule of each month in hindsight."""
    return with_oracle(month_rules(spark, sf_dir))


@query(Shape("asset period_end best_strategy", r6="bh"), "label_next", "label_next")
def label_next_month(spark, sf_dir):
    """Winner of the following month."""
    return label_next_period(month_rules(spark, sf_dir))


@query(Shape("asset period_end best_strategy", r6="bh"), "label_same", "label_same")
def label_same_month(spark, sf_dir):
    """Winner of the month itself."""
    return label_same_period(month_rules(spark, sf_dir))


@query(Shape("asset period_end known_label", n="best_code"), "label_same label_next", """
SELECT s.asset, s.period_end, s.best_strategy AS known_label,
  CASE s.best_strategy WHEN 'Buy & Hold' THEN 0 WHEN 'Momentum' THEN 2 WHEN 'Mean Reversion' THEN 1 END AS best_code FROM label_same s""")
def label_point_in_time(spark, sf_dir):
    """Winner stamped on the month in which it becomes known, with its fixed code."""
    labels = label_next_period(month_rules(spark, sf_dir), alignment="point_in_time")
    return labels.withColumn("known_label", F.col("best_strategy")).withColumn(
        "best_code", recode("best_strategy", CODES_BH_MR_MOM))


@query(Shape("asset period_end best_strategy", n="best_strategy_code", r6="ret", sig="fwd_bh fwd_mom fwd_mr"), "label_fwd4", """
SELECT *, CASE best_strategy WHEN 'Buy & Hold' THEN 0 WHEN 'Momentum' THEN 1 WHEN 'Mean Reversion' THEN 2 END AS best_strategy_code
FROM label_fwd4 WHERE best_strategy IS NOT NULL""")
def label_next_4w(spark, sf_dir):
    """Winner of the next four weeks on the weeks with complete features."""
    return crypto_week_dataset(segment_bars(spark, sf_dir))


#: Daily equity rows with the winner of the month after, as the steps before a final SELECT from ``labelled``.
LABELLED_DAILY = f"""
WITH m AS (SELECT asset, last_day(d) AS period_end, arg_max(adj_close, d) AS adj_close FROM eq_ready GROUP BY 1, 2),
span AS (SELECT asset, min(period_end) AS lo, max(period_end) AS hi FROM m GROUP BY asset),
cal AS (SELECT asset, last_day(CAST(unnest(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)) AS period_end FROM span),
px AS (SELECT c.asset, c.period_end, last_value(m.adj_close IGNORE NULLS) OVER (PARTITION BY c.asset ORDER BY c.period_end ROWS UNBOUNDED PRECEDING) AS held
  FROM cal c LEFT JOIN m ON m.asset = c.asset AND m.period_end = c.period_end),
r AS (SELECT asset, period_end, {q.chg('held', 1, 'period_end')} AS ret FROM px),
ru AS ({q.rules('r', 'month')}),
lab AS ({q.next3(('buy_hold', 'momentum', 'mean_reversion')).format(src='ru')}),
labelled AS (SELECT e.*, lab.best_strategy FROM eq_ready e LEFT JOIN lab ON lab.asset = e.asset AND lab.period_end = last_day(e.d))
"""
_DAILY_R6 = " ".join(c for c in q.EQUITY_COMPLETE)


@query(Shape("asset d best_strategy", r6=_DAILY_R6), "eq_ready", LABELLED_DAILY + "SELECT * FROM labelled")
def label_broadcast_daily(spark, sf_dir):
    """Next month's winner copied to the daily feature rows of each month."""
    return labelled_daily(segment_bars(spark, sf_dir))


@query(Shape("asset d best_strategy", r6=_DAILY_R6), "eq_ready",
       LABELLED_DAILY + "SELECT * FROM labelled WHERE d BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def stored_labelled_range(spark, sf_dir):
    """Labelled daily table stored by asset, read back with its date range pushed to the scan."""
    path = files.write_table(labelled_daily(segment_bars(spark, sf_dir)), scratch_path(spark, "labelled"))
    return between_days(files.read_labelled(spark, path), "1997-01-01", "1999-12-31")


@query(Shape("asset period_end", n="target"), "label_next0", """
SELECT asset, period_end, CASE WHEN best_strategy = 'buy_hold' THEN 0 ELSE 1 END AS target FROM label_next0""")
def binary_target_label(spark, sf_dir):
    """1 unless the label is holding; a missing label counts as 1."""
    rules = monthly_rules(period_returns(segment_bars(spark, sf_dir)), drop_first=False)
    labels = label_next_period(rules, SNAKE_LABELS)
    return labels.withColumn("target", target_not_default())


@query(Shape("asset period_end", n="go_active", r6="bh mom mr"), "rules_m", """
SELECT *, CASE WHEN greatest(mom, mr) > bh THEN 1 ELSE 0 END AS go_active FROM rules_m""")
def binary_target_returns(spark, sf_dir):
    """1 when a switching rule beats holding in the month."""
    return month_rules(spark, sf_dir).withColumn("go_active", target_active_wins())


_LAG_M = ", ".join(f"{q.lag(c, 1, 'period_end')} AS {c}" for c in ("ret_1m", "ret_3m", "ret_6m", "vol_3m", "vol_6m"))


@query(Shape("asset period_end", n="go_active", r6="ret_1m ret_3m ret_6m vol_3m vol_6m"), "month_feats rules_m", f"""
SELECT * FROM (SELECT f.asset, f.period_end, {_LAG_M.replace('PARTITION BY asset ORDER BY period_end', 'PARTITION BY f.asset ORDER BY f.period_end')},
  CASE WHEN greatest(r.mom, r.mr) > r.bh THEN 1 ELSE 0 END AS go_active
FROM month_feats f JOIN rules_m r ON r.asset = f.asset AND r.period_end = f.period_end) WHERE vol_6m IS NOT NULL""")
def lagged_features(spark, sf_dir):
    """Features known a month earlier beside the month's own binary target, complete rows only."""
    return binary_dataset(segment_bars(spark, sf_dir))


@query(Shape("asset period_end choice", r6="bh mom mr ml oracle"), "ml_lag", "ml_lag")
def followed_returns(spark, sf_dir):
    """Return of following last month's winner, holding when there is none."""
    return with_oracle(follow(last_choice(month_rules(spark, sf_dir))))


@query(Shape("asset period_end", n="go_active", r6="p_active ml"), "rules_m", f"""
WITH t AS (SELECT *, CASE WHEN greatest(mom, mr) > bh THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS active FROM rules_m),
p AS (SELECT *, avg(active) {q.over(12, -1, 'period_end')} AS p_active FROM t)
SELECT asset, period_end, p_active, CASE WHEN p_active >= 0.35 THEN 1 ELSE 0 END AS go_active,
  CASE WHEN p_active >= 0.35 THEN CASE WHEN prev_ret > 0 THEN mom WHEN prev_ret < 0 THEN mr ELSE bh END ELSE bh END AS ml FROM p""")
def gated_switch(spark, sf_dir):
    """Switch by the sign of the last return once the trailing active share reaches a threshold."""
    rules = month_rules(spark, sf_dir).withColumn("active", target_active_wins().cast("double"))
    rules = rules.withColumn("p_active", F.avg("active").over(PERIODIC.rows.rowsBetween(-12, -1)))
    return gated_follow(rules, "p_active", 0.35)


@query(Shape("asset period_end", r6="bh mom mr ml"), "ml_lag", f"""
WITH late AS (SELECT asset, period_end, ml FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY period_end) AS rn FROM ml_lag) WHERE rn > 36)
SELECT r.asset, r.period_end, r.bh, r.mom, r.mr, coalesce(l.ml, 0.0) AS ml
FROM rules_m r LEFT JOIN late l ON l.asset = r.asset AND l.period_end = r.period_end""")
def aligned_ml_returns(spark, sf_dir):
    """Adaptive returns of the later months aligned to all months, zero before they start."""
    rules = follow(last_choice(month_rules(spark, sf_dir))).withColumn("rn", F.row_number().over(PERIODIC.rows))
    return rules.withColumn("ml", F.when(F.col("rn") > 36, F.coalesce("ml", F.lit(0.0))).otherwise(F.lit(0.0)))


@query(Shape("asset period_end", r6="bh week_bh"), "rules_m rules_w", """
SELECT coalesce(m.asset, w.asset) AS asset, coalesce(m.period_end, w.period_end) AS period_end, m.bh, w.bh AS week_bh
FROM rules_m m FULL JOIN rules_w w ON w.asset = m.asset AND w.period_end = m.period_end""")
def outer_concat(spark, sf_dir):
    """Monthly and weekly holding returns side by side on the union of their dates."""
    bars = segment_bars(spark, sf_dir)
    months = rules_of(bars).select("asset", "period_end", "bh")
    weeks = week_rules_of(bars).select("asset", "period_end", F.col("bh").alias("week_bh"))
    return months.join(weeks, ["asset", "period_end"], "full_outer")


@query(Shape("asset period_end best_strategy", r6="ret_1d ret_5d ret_21d ret_63d vol_21d vol_63d px_over_sma_10 px_over_sma_50 px_over_sma_200 rsi_14 vol_zscore_21d",
             r3="macd macd_signal"),
       "cm_ready label_same", """
SELECT f.*, l.best_strategy FROM cm_ready f JOIN label_same l ON l.asset = f.asset AND l.period_end = f.period_end""")
def labelled_monthly(spark, sf_dir):
    """Month-end crypto features joined with the winner of the same month on their common months."""
    return crypto_month_dataset(segment_bars(spark, sf_dir))


@query(Shape("asset period_end best_strategy", r6="ret_1d ret_5d ret_21d ret_63d vol_21d vol_63d px_over_sma_10 px_over_sma_50 px_over_sma_200 rsi_14 vol_zscore_21d",
             r3="macd macd_signal"),
       "cw_ready label_fwd4", """
SELECT f.*, l.best_strategy FROM cw_ready f JOIN label_fwd4 l ON l.asset = f.asset AND l.period_end = f.period_end
WHERE l.best_strategy IS NOT NULL""")
def labelled_weekly(spark, sf_dir):
    """Complete weekly crypto features with the winner of the next four weeks."""
    return crypto_week_dataset(segment_bars(spark, sf_dir))


@query(Shape("asset", n="common only_months only_weeks"), "cm_ready label_same", """
SELECT coalesce(f.asset, l.asset) AS asset, count(f.asset) FILTER (WHERE l.asset IS NOT NULL) AS common,
  count(f.asset) FILTER (WHERE l.asset IS NULL) AS only_months, count(l.asset) FILTER (WHERE f.asset IS NULL) AS only_weeks
FROM cm_ready f FULL JOIN label_same l ON l.asset = f.asset AND l.period_end = f.period_end GROUP BY 1""")
def key_sets(spark, sf_dir):
    """Sizes of the intersection and the differences of two sets of (asset, month) keys."""
    bars = segment_bars(spark, sf_dir)
    a = crypto_month_features(bars).select("asset", "period_end").withColumn("in_a", F.lit(1))
    b = rules_of(bars).select("asset", "period_end").withColumn("in_b", F.lit(1))
    both = a.join(b, ["asset", "period_end"], "full_outer")
    return both.groupBy("asset").agg(
        F.count(F.when(F.col("in_b") == 1, F.col("in_a"))).alias("common"),
        F.count(F.when(F.col("in_b").isNull(), F.col("in_a"))).alias("only_months"),
        F.count(F.when(F.col("in_a").isNull(), F.col("in_b"))).alias("only_weeks"),
    )


@query(Shape("asset period_end best_strategy", r6="ret_1m ret_3m ret_6m vol_3m vol_6m"), "ml_data", "ml_data")
def numeric_feature_matrix(spark, sf_dir):
    """Numeric features chosen by type without the rule returns, complete rows with their label."""
    rules = month_rules(spark, sf_dir)
    data = label_next_period(monthly_return_features(rules))
    features = numeric_features(data, drop=(*RULES, "ret", "prev_ret", "adj_close"))
    return complete_rows(data, features, "best_strategy")


# --- backtest reports -----------------------------------------------------------------------------------

PERF = Shape("asset strategy", n="periods",
             sig="total_return annualized_return annualized_vol sharpe", r6="max_drawdown")
_COLS = WITH_ORACLE


@query(PERF, "rules_m", "WITH o AS (SELECT *, greatest(bh, mom, mr) AS oracle FROM rules_m) " + q.perf("o", _COLS, 12))
def flagship_strategy_performance(spark, sf_dir):
    """Which rule won per asset: performance of the three rules and of hindsight."""
    return performance(with_oracle(month_rules(spark, sf_dir)), WITH_ORACLE)


@query(PERF, "ml_lag", q.perf("ml_lag", WITH_ML, 12))
def perf_monthly(spark, sf_dir):
    """Monthly performance table including the adaptive choice."""
    return lagged_backtest(spark, sf_dir).performance()


def lagged_backtest(spark, sf_dir):
    """Backtest that follows the last winner."""
    returns = with_oracle(follow(last_choice(month_rules(spark, sf_dir))))
    return Backtest(returns, WITH_ML, 12)


@query(Shape("asset period_end", r6="bh mom mr ml oracle"), "ml_lag", "ml_lag")
def return_matrix(spark, sf_dir):
    """Returns of every strategy side by side per month."""
    return lagged_backtest(spark, sf_dir).return_matrix()


@query(Shape("asset period_end", sig="bh mom mr ml oracle"), "ml_lag", "SELECT asset, period_end, " + ", ".join(
    f"product(1 + {c}) {q.over('all', 0, 'period_end')} AS {c}" for c in WITH_ML) + " FROM ml_lag")
def equity_matrix(spark, sf_dir):
    """Equity of every strategy side by side per month."""
    return lagged_backtest(spark, sf_dir).equity_matrix()


@query(PERF, "ml_lag", q.perf("ml_lag", WITH_ML, 12))
def stored_performance(spark, sf_dir):
    """Performance table saved with the return and equity matrices and read back."""
    path = scratch_path(spark, "backtest")
    lagged_backtest(spark, sf_dir).save(path)
    return spark.read.parquet(f"{path}/performance")


@query(Shape("asset strategy", n="place", sig="annualized_return"), "ml_lag", f"""
WITH p AS ({q.perf("ml_lag", WITH_ML, 12)})
SELECT asset, strategy, annualized_return, CASE strategy WHEN 'Buy & Hold' THEN 1 WHEN 'Momentum' THEN 2
  WHEN 'Mean Reversion' THEN 3 WHEN 'ML Adaptive' THEN 4 ELSE 5 END AS place FROM p""")
def annualized_return_bars(spark, sf_dir):
    """Annualised return per strategy in summary order, ready for a bar chart."""
    table = lagged_backtest(spark, sf_dir).performance()
    place = recode("strategy", {name: i for i, name in enumerate(WITH_ML.values(), 1)})
    return table.withColumn("place", place).orderBy("asset", "place")


@query(PERF, "rules_w", "WITH o AS (SELECT *, greatest(bh, mom, mr) AS oracle FROM rules_w) " + q.perf("o", _COLS, 52))
def perf_weekly(spark, sf_dir):
    """Weekly performance table, 52 periods a year."""
    return performance(with_oracle(week_rules(spark, sf_dir)), WITH_ORACLE, 52)


@query(PERF, "brand_bars", "WITH " + ", ".join(
    [q.month_steps("brand_bars", "bm").strip(),
     f"bh AS (SELECT *, last_value(adj_close IGNORE NULLS) {q.over('all', 0, 'period_end')} AS held FROM bm)",
     f"br AS (SELECT * FROM (SELECT asset, period_end, {q.chg('held', 1, 'period_end')} AS ret FROM bh) WHERE ret IS NOT NULL)",
     f"ru AS ({q.rules('br', 'month')})", "o AS (SELECT *, greatest(bh, mom, mr) AS oracle FROM ru)"]) + " " + q.perf("o", _COLS, 12))
def perf_brands(spark, sf_dir):
    """Monthly performance table of the wide brand panel."""
    return performance(with_oracle(rules_of(brand_bars(spark, sf_dir))), WITH_ORACLE)


@query(Shape("asset period_end strategy", sig="equity"), "rules_m", " UNION ALL ".join(
    f"SELECT asset, period_end, '{n}' AS strategy, product(1 + {c}) {q.over('all', 0, 'period_end')} AS equity FROM o"
    for c, n in _COLS.items()).join(["WITH o AS (SELECT *, greatest(bh, mom, mr) AS oracle FROM rules_m) ", ""]))
def equity_curves_long(spark, sf_dir):
    """Equity curves in chart-ready long form."""
    return equity_curves(with_oracle(month_rules(spark, sf_dir)), WITH_ORACLE)


@query(Shape("asset period_end ml_choice", r6="ml"), "ml_lag", f"""
SELECT *, CASE WHEN ml IS NULL THEN 'None' WHEN abs(bh - ml) < 1e-10 THEN 'Buy & Hold' WHEN abs(mom - ml) < 1e-10 THEN 'Momentum'
  WHEN abs(mr - ml) < 1e-10 THEN 'Mean Reversion' WHEN abs(ml) < 1e-10 THEN 'Cash/0' ELSE 'Unknown' END AS ml_choice
FROM (SELECT asset, period_end, bh, mom, mr, CASE WHEN choice IS NOT NULL THEN CASE WHEN choice = 'Momentum' THEN ml * 1.5 ELSE ml END END AS ml FROM ml_lag)""")
def choice_inference(spark, sf_dir):
    """Which strategy a realised return came from, with levered and missing returns in the data."""
    followed = follow(last_choice(month_rules(spark, sf_dir)))
    levered = F.when(F.col("choice") == MOM, F.col("ml") * 1.5).otherwise(F.col("ml"))
    realised = followed.withColumn("ml", F.when(F.col("choice").isNotNull(), levered))
    return realised.withColumn("ml_choice", infer_choice("ml", dict(zip(STRATEGIES, RULES))))


@query(Shape("asset choice", n="n", r6="percent"), "ml_lag", """
WITH c AS (SELECT asset, CASE WHEN abs(bh - ml) < 1e-10 THEN 'Buy & Hold' WHEN abs(mom - ml) < 1e-10 THEN 'Momentum'
  WHEN abs(mr - ml) < 1e-10 THEN 'Mean Reversion' END AS choice FROM ml_lag)
SELECT asset, choice, count(*) AS n, 100.0::DOUBLE * (count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY asset)) AS percent
FROM c WHERE choice IS NOT NULL GROUP BY asset, choice""")
def allocation_share(spark, sf_dir):
    """Percent of months spent in each strategy."""
    return allocation(follow(last_choice(month_rules(spark, sf_dir))))


@query(Shape("best_strategy", n="n", r6="share"), "label_same", """
SELECT best_strategy, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM label_same GROUP BY 1""")
def label_distribution(spark, sf_dir):
    """Counts and shares of the monthly winners, most frequent first."""
    labels = label_same_period(month_rules(spark, sf_dir))
    return shares(labels, "best_strategy").orderBy(F.desc("n"), "best_strategy")


@query(Shape("asset", r6="active_share"), "pred_lag", """
SELECT asset, avg(CASE WHEN choice IN ('Momentum', 'Mean Reversion') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS active_share
FROM pred_lag GROUP BY 1""")
def active_share(spark, sf_dir):
    """Share of months in which the choice is not to hold."""
    chosen = last_choice(month_rules(spark, sf_dir))
    active = F.coalesce(F.col("choice").isin(MOM, MR).cast("double"), F.lit(0.0))
    return chosen.groupBy("asset").agg(F.avg(active).alias("active_share"))


