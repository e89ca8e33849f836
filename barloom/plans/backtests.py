"""End-to-end backtests: stored bars in; return matrix, equity matrix and performance table out.

``alignment="as_published"`` trains and predicts on the rows as they are labelled, which lets a prediction
earn the period its own features already contain. ``"point_in_time"`` lags every feature by one period and
trains only on labels whose window has ended.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.calendar import month_end
from barloom.functions.frames import PERIODIC, lag
from barloom.functions.scalars import BH, CODES_BH_MOM_MR, MOM, MR, SNAKE_LABELS, ratio, recode
from barloom.operators.indicators import (
    CRYPTO_FEATURES, crypto_features, equity_features, monthly_return_features,
)
from barloom.operators.learning import (
    Model, boosting, calendar_splits, expanding_splits, logistic, period_list, walk_forward,
)
from barloom.operators.metrics import equity_wide, performance
from barloom.operators.resample import last_valid, period_returns
from barloom.operators.strategies import (
    available_from, broadcast_label, follow, gated_follow, label_forward, label_next_period, label_same_period,
    lag_features, monthly_rules, target_active_wins, weekly_rules, with_oracle,
)
from barloom.session import settle
from barloom.sources.checks import complete_rows
from barloom.sources.files import write_table

MONTH_FEATURES = ("ret_1m", "ret_3m", "ret_6m", "vol_3m", "vol_6m")
NAMES = {"bh": BH, "mom": MOM, "mr": MR}
WITH_ORACLE = {**NAMES, "oracle": "Oracle"}
WITH_ML = {**NAMES, "ml": "ML Adaptive", "oracle": "Oracle"}
CHOICES = {code: name for name, code in CODES_BH_MOM_MR.items()}


@dataclass(frozen=True)
class Backtest:
    """Returns of every strategy per asset and period, and what follows from them."""

    returns: DataFrame
    strategies: Mapping[str, str]
    periods_per_year: int

    def return_matrix(self) -> DataFrame:
        return self.returns.select("asset", "period_end", *self.strategies)

    def equity_matrix(self) -> DataFrame:
        wide = equity_wide(self.return_matrix(), list(self.strategies))
        return wide.select("asset", "period_end", *[F.col(f"eq_{c}").alias(c) for c in self.strategies])

    def performance(self) -> DataFrame:
        return performance(self.return_matrix(), self.strategies, self.periods_per_year)

    def save(self, path: str, fmt: str = "parquet", **options: str) -> None:
        """Write the three tables under ``path``; the returns are computed once for all of them."""
        stored = replace(self, returns=settle(self.return_matrix()))
        tables = {"returns": stored.returns, "equity": stored.equity_matrix(), "performance": stored.performance()}
        for name, df in tables.items():
            write_table(df, f"{path}/{name}", fmt=fmt, **options)


# --- training data --------------------------------------------------------------------------------------

def rules_of(bars: DataFrame) -> DataFrame:
    return monthly_rules(period_returns(bars))


def week_rules_of(bars: DataFrame) -> DataFrame:
    return weekly_rules(period_returns(bars, "week"))


def coded(df: DataFrame) -> DataFrame:
    return df.withColumn("y", recode("best_strategy", CODES_BH_MOM_MR))


def month_dataset(bars: DataFrame, alignment: str = "as_published") -> DataFrame:
    """Monthly return features and the winning rule, complete rows only."""
    data = label_next_period(monthly_return_features(rules_of(bars)), alignment=alignment)
    if alignment == "point_in_time":
        data = lag_features(data, MONTH_FEATURES)
    return data.dropna("any", subset=[*MONTH_FEATURES, "best_strategy"])


def binary_dataset(bars: DataFrame) -> DataFrame:
    """Features known a month earlier beside the month's own binary target, complete rows only."""
    data = monthly_return_features(rules_of(bars)).withColumn("go_active", target_active_wins())
    return complete_rows(lag_features(data, MONTH_FEATURES), MONTH_FEATURES, "go_active")


def crypto_month_features(bars: DataFrame) -> DataFrame:
    """Last valid crypto features per month, complete months only."""
    months = last_valid(crypto_features(bars, "monthly"), "month", list(CRYPTO_FEATURES))
    return months.dropna("any", subset=list(CRYPTO_FEATURES))


def crypto_month_dataset(bars: DataFrame, alignment: str = "as_published") -> DataFrame:
    """Month-end features with the winner of the same month, on the months that have both."""
    labels = label_same_period(rules_of(bars)).select("asset", "period_end", "best_strategy")
    features = crypto_month_features(bars)
    if alignment == "point_in_time":
        features = lag_features(features, CRYPTO_FEATURES).dropna("any", subset=list(CRYPTO_FEATURES))
    return features.join(labels, ["asset", "period_end"])


def crypto_week_dataset(bars: DataFrame, alignment: str = "as_published") -> DataFrame:
    """Complete weekly features with the winner of the next four weeks."""
    columns = ["adj_close", *CRYPTO_FEATURES]
    weeks = last_valid(crypto_features(bars, "weekly"), "week", columns).dropna("any", subset=columns)
    returns = weeks.withColumn("ret", ratio("adj_close", lag("adj_close", PERIODIC)) - F.lit(1.0))
    labelled = label_forward(weekly_rules(returns, first="zero"))
    if alignment == "point_in_time":
        labelled = lag_features(labelled, CRYPTO_FEATURES)
    return labelled.dropna("any", subset=["best_strategy", *CRYPTO_FEATURES])


def labelled_daily(bars: DataFrame) -> DataFrame:
    """Daily equity features with the winner of the month after on every row of a month."""
    daily = settle(equity_features(bars))
    rules = monthly_rules(period_returns(daily), drop_first=False)
    return broadcast_label(daily, label_next_period(rules, SNAKE_LABELS), month_end("d"))


# --- backtests ------------------------------------------------------------------------------------------

def _choices(predictions: DataFrame) -> DataFrame:
    return predictions.select("asset", "period_end", recode("y_pred", CHOICES).alias("choice"))


def month_predictions(bars: DataFrame, model: Model, min_train: int = 60, refit_every: int = 1,
                      alignment: str = "as_published") -> DataFrame:
    data = settle(coded(month_dataset(bars, alignment)).select("asset", "period_end", "y", *MONTH_FEATURES), "period_end")
    splits = expanding_splits(period_list(data), min_train, refit_every)
    return walk_forward(data, MONTH_FEATURES, "y", model, splits)


def equity_monthly(bars: DataFrame, model: Model | None = None, min_train: int = 60, refit_every: int = 1,
                   alignment: str = "as_published") -> Backtest:
    """Rules, hindsight and the boosted choice per month; the choice earns nothing before its first month."""
    model = model or boosting(200, 0.05, 3)
    chosen = _choices(month_predictions(bars, model, min_train, refit_every, alignment))
    rules = with_oracle(rules_of(bars)).join(chosen, ["asset", "period_end"], "left")
    followed = follow(rules)
    ml = F.when(F.col("choice").isNull(), F.lit(0.0)).otherwise(F.col("ml"))
    return Backtest(followed.withColumn("ml", ml), WITH_ML, 12)


def crypto_month_predictions(bars: DataFrame, model: Model | None = None, years: int = 5, refit_every: int = 1,
                             alignment: str = "as_published") -> DataFrame:
    data = settle(coded(crypto_month_dataset(bars, alignment)).select("asset", "period_end", "y", *CRYPTO_FEATURES), "period_end")
    splits = calendar_splits(period_list(data), years, refit_every=refit_every)
    return walk_forward(data, CRYPTO_FEATURES, "y", model or boosting(150, 0.05, 2, 0.8), splits)


def crypto_monthly(bars: DataFrame, model: Model | None = None, refit_every: int = 1,
                   alignment: str = "as_published") -> Backtest:
    """Rules and the boosted choice on the months that have a prediction."""
    chosen = _choices(crypto_month_predictions(bars, model, refit_every=refit_every, alignment=alignment))
    return Backtest(with_oracle(follow(rules_of(bars).join(chosen, ["asset", "period_end"]))), WITH_ML, 12)


def crypto_weekly(bars: DataFrame, model: Model | None = None, min_train: int = 104, refit_every: int = 1,
                  alignment: str = "as_published", horizon: int = 4) -> Backtest:
    """Weekly rules and the boosted choice on predicted weeks; any choice but the first two is reversal."""
    data = settle(coded(crypto_week_dataset(bars, alignment)).select("asset", "period_end", "y", *CRYPTO_FEATURES), "period_end")
    splits = expanding_splits(period_list(data), min_train, refit_every, available_from(alignment, horizon))
    pred = walk_forward(data, CRYPTO_FEATURES, "y", model or boosting(200, 0.05, 2, 0.7), splits)
    rules = week_rules_of(bars).join(_choices(pred), ["asset", "period_end"])
    return Backtest(with_oracle(follow(rules, otherwise="mr")), WITH_ML, 52)


def binary_predictions(bars: DataFrame, model: Model | None = None, min_train: int = 60,
                       refit_every: int = 1) -> DataFrame:
    data = settle(binary_dataset(bars).select("asset", "period_end", "go_active", *MONTH_FEATURES), "period_end")
    splits = expanding_splits(period_list(data), min_train, refit_every)
    return walk_forward(data, MONTH_FEATURES, "go_active", model or logistic(), splits)


def binary_switch(bars: DataFrame, model: Model | None = None, min_train: int = 60, refit_every: int = 1,
                  threshold: float = 0.55) -> Backtest:
    """Hold unless the probability of a better switching rule reaches the threshold, on predicted months."""
    pred = binary_predictions(bars, model, min_train, refit_every).select("asset", "period_end", "p_active")
    rules = rules_of(bars).join(pred, ["asset", "period_end"])
    return Backtest(with_oracle(gated_follow(rules, threshold=threshold)), {**WITH_ML, "ml": "ML Binary"}, 12)
