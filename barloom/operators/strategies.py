"""Rule strategies, labels, targets and the returns of following a choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import (
    PERIODIC, Series, forward_growth, lag, lead, rolling_sum,
)
from barloom.functions.scalars import (
    BH, CODES_BH_MOM_MR, MOM, MR, STRATEGIES, as_col, first_argmax, indicator, pick, recode, row_max,
)

RULES = ("bh", "mom", "mr")


def monthly_rules(returns: DataFrame, ret: str = "ret", s: Series = PERIODIC,
                  drop_first: bool = True) -> DataFrame:
    """Hold always; hold after an up period; hold after a down period.

    The first period has no return of its own. It is dropped, or kept with both switches off.
    """
    base = returns.filter(F.col(ret).isNotNull()) if drop_first else returns
    prev = lag(ret, s)
    return base.withColumns({
        "prev_ret": prev,
        "bh": F.col(ret),
        "mom": F.when(prev > 0, F.col(ret)).otherwise(F.lit(0.0)),
        "mr": F.when(prev < 0, F.col(ret)).otherwise(F.lit(0.0)),
    })


def weekly_rules(returns: DataFrame, ret: str = "ret", s: Series = PERIODIC,
                 first: str = "drop", window: int = 4) -> DataFrame:
    """Momentum holds when the previous ``window`` returns sum to a gain, reversal after a down week.

    ``first="drop"`` leaves the undefined first return out (backtest), ``first="zero"`` counts it as
    a flat week (label building).
    """
    if first == "zero":
        base = returns.withColumn(ret, F.coalesce(F.col(ret), F.lit(0.0)))
    else:
        base = returns.filter(F.col(ret).isNotNull())
    base = base.withColumn("_trail", rolling_sum(ret, window, s))
    return base.withColumns({
        "prev_ret": lag(ret, s),
        "bh": F.col(ret),
        "mom": F.when(lag("_trail", s) > 0, F.col(ret)).otherwise(F.lit(0.0)),
        "mr": F.when(lag(ret, s) < 0, F.col(ret)).otherwise(F.lit(0.0)),
    }).drop("_trail")


def with_oracle(rules: DataFrame, rule_columns: Sequence[str] = RULES) -> DataFrame:
    """Best of the rules per period, known only afterwards."""
    return rules.withColumn("oracle", row_max(list(rule_columns)))


def _named(names: Sequence[str], columns: Sequence[str | Column] = RULES) -> dict:
    return dict(zip(names, columns))


def label_same_period(rules: DataFrame, names: Sequence[str] = STRATEGIES) -> DataFrame:
    return rules.withColumn("best_strategy", first_argmax(_named(names)))


def label_next_period(rules: DataFrame, names: Sequence[str] = STRATEGIES, s: Series = PERIODIC,
                      alignment: str = "as_published") -> DataFrame:
    """Winner of the following period; the last period of a series has none.

    ``point_in_time`` stamps the winner on the period in which it is realised, so that a row's label
    is known at its own end.
    """
    if alignment == "point_in_time":
        return label_same_period(rules, names)
    ahead = [lead(c, s) for c in RULES]
    staged = rules.withColumns({f"_next_{c}": a for c, a in zip(RULES, ahead)})
    return staged.withColumn(
        "best_strategy", first_argmax(_named(names, [f"_next_{c}" for c in RULES]))
    ).drop(*[f"_next_{c}" for c in RULES])


def label_forward(rules: DataFrame, horizon: int = 4, s: Series = PERIODIC) -> DataFrame:
    """Winner of the compounded next ``horizon`` periods, as a name and as a code."""
    staged = rules.withColumns({f"fwd_{c}": forward_growth(c, horizon, s) for c in RULES})
    labelled = staged.withColumn(
        "best_strategy", first_argmax(_named(STRATEGIES, [f"fwd_{c}" for c in RULES]))
    )
    return labelled.withColumn("best_strategy_code", recode("best_strategy", CODES_BH_MOM_MR))


def available_from(label_alignment: str, horizon: int) -> int:
    """Periods to wait before a label may be trained on: its window must have ended."""
    return horizon if label_alignment == "point_in_time" else 0


def broadcast_label(daily: DataFrame, labels: DataFrame, freq_key: Column, label: str = "best_strategy",
                    keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Copy a period's label onto each of its rows.

    The label side has one row per asset and period. Catalyst broadcasts it when its measured size is
    under the threshold and otherwise sorts and merges on (asset, period); skew there is split by AQE.
    """
    lookup = labels.select(*keys, F.col("period_end").alias("_period"), label)
    return daily.withColumn("_period", freq_key).join(lookup, [*keys, "_period"], "left").drop("_period")


def target_not_default(label: str | Column = "best_strategy", default: str = "buy_hold") -> Column:
    """0 for the default strategy, 1 for any other label, a missing one included."""
    return F.when(as_col(label) == default, F.lit(0)).otherwise(F.lit(1))


def target_active_wins() -> Column:
    """1 when the better of the two switching rules beats holding."""
    return indicator(F.greatest("mom", "mr") > F.col("bh"))


def lag_features(df: DataFrame, features: Sequence[str], s: Series = PERIODIC, n: int = 1) -> DataFrame:
    return df.withColumns({c: lag(c, s, n) for c in features})


def follow(rules: DataFrame, choice: str | Column = "choice", otherwise: str = "bh",
           out: str = "ml") -> DataFrame:
    """Return of the chosen strategy; any other or no choice falls back to ``otherwise``."""
    return rules.withColumn(out, pick(choice, dict(zip((BH, MOM, MR), RULES)), otherwise))


def gated_follow(rules: DataFrame, probability: str | Column = "p_active", threshold: float = 0.55,
                 out: str = "ml") -> DataFrame:
    """Leave holding only when the active probability reaches the threshold.

    Then the sign of the previous return picks the rule, and a flat previous period stays with holding.
    """
    go = as_col(probability) >= threshold
    switched = F.when(F.col("prev_ret") > 0, F.col("mom")).when(F.col("prev_ret") < 0, F.col("mr"))
    return rules.withColumns({
        "go_active": indicator(go),
        out: F.when(go, F.coalesce(switched, F.col("bh"))).otherwise(F.col("bh")),
    })
