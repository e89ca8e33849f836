"""Equity curves, performance tables and classification reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import PERIODIC, Series, growth, ratio, running_max
from barloom.functions.scalars import STRATEGIES, infer_choice
from barloom.operators.quantiles import quantiles

STATS = ("total_return", "annualized_return", "annualized_vol", "sharpe", "max_drawdown")


def equity_wide(returns: DataFrame, columns: Sequence[str], s: Series = PERIODIC) -> DataFrame:
    """Equity of every strategy column, starting from one unit."""
    return returns.withColumns({f"eq_{c}": growth(_named(c), s) for c in columns})


def equity_curves(returns: DataFrame, strategies: Mapping[str, str], s: Series = PERIODIC) -> DataFrame:
    """Chart-ready rows (keys, period, strategy, equity) for a {column: name} mapping."""
    wide = equity_wide(returns, list(strategies), s)
    named = wide.select(*s.keys, *s.order, *[_named(f"eq_{c}").alias(n) for c, n in strategies.items()])
    return named.unpivot([*s.keys, *s.order], list(strategies.values()), "strategy", "equity")


def performance(returns: DataFrame, strategies: Mapping[str, str], periods_per_year: int = 12,
                s: Series = PERIODIC) -> DataFrame:
    """One row per key and strategy: total and annualised return, volatility, Sharpe, max drawdown.

    All strategies are kept side by side through the windows and the aggregation, so the table costs
    one exchange on the keys; only the finished rows are turned to long form.
    """
    columns = list(strategies)
    curves = equity_wide(returns, columns, s)
    curves = curves.withColumns({f"top_{c}": running_max(_named(f"eq_{c}"), s) for c in columns})
    root = F.sqrt(F.lit(float(periods_per_year)))
    stats = [stat for c in columns for stat in (
        F.product(F.lit(1.0) + _named(c)).alias(f"growth_{c}"),
        F.count(_named(c)).alias(f"n_{c}"),
        (F.stddev_samp(_named(c)) * root).alias(f"vol_{c}"),
        F.min(ratio(_named(f"eq_{c}"), _named(f"top_{c}")) - F.lit(1.0)).alias(f"dd_{c}"),
    )]
    per_key = curves.groupBy(*s.keys).agg(*stats)

    def row(c: str, name: str) -> Column:
        total, n, vol = _named(f"growth_{c}"), _named(f"n_{c}"), _named(f"vol_{c}")
        # a series that lost more than everything has no geometric mean
        annual = F.when(total >= 0, F.pow(total, F.lit(float(periods_per_year)) / n) - F.lit(1.0))
        return F.struct(F.lit(name).alias("strategy"), n.alias("periods"), (total - F.lit(1.0)).alias("total_return"),
                        annual.alias("annualized_return"), vol.alias("annualized_vol"),
                        F.when(vol > 0, annual / vol).alias("sharpe"), _named(f"dd_{c}").alias("max_drawdown"))

    return per_key.select(*s.keys, F.inline(F.array(*[row(c, name) for c, name in strategies.items()])))


def _named(c: str) -> Column:
    """A column by its exact name, blanks, dots and backquotes included."""
    return F.col(f"`{c.replace('`', '``')}`")


def shares(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of each value and its share within the ``by`` groups.

    The total runs over the counted values (one row per distinct value), not over the data.
    """
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(group))


def allocation(returns: DataFrame, chosen: str = "ml", columns: Sequence[str] = ("bh", "mom", "mr"),
               by: Sequence[str] = ("asset",)) -> DataFrame:
    """Percent of periods spent in each strategy, over periods where one can be told."""
    choice = infer_choice(chosen, dict(zip(STRATEGIES, columns)))
    known = returns.withColumn("choice", choice).filter(F.col("choice").isin(*STRATEGIES))
    return shares(known, "choice", by).withColumn("percent", F.col("share") * 100).drop("share")


def hit(y: str, p: str) -> Column:
    return (F.col(y) == F.col(p)).cast("double")


def accuracy(pred: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Accuracy and balanced accuracy (mean recall over the classes present) per group."""
    per_class = pred.groupBy(*by, y).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(hit(y, p)).alias("_hits"))
    return per_class.groupBy(*by).agg(
        (F.sum("_hits") / F.sum("_n")).alias("accuracy"),
        F.avg(F.col("_hits") / F.col("_n")).alias("balanced_accuracy"),
    )


def confusion(pred: DataFrame, labels: Sequence, by: Sequence[str] = (),
              y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Counts with a row and a column for every listed label, seen or not."""
    cells = [F.count(F.when((F.col(y) == F.lit(a)) & (F.col(p) == F.lit(b)), 1)) for a in labels for b in labels]
    width = len(labels)
    wide = pred.groupBy(*by).agg(*[c.alias(f"_c{i}") for i, c in enumerate(cells)])
    rows = [
        F.struct(F.lit(a).alias(y), *[F.col(f"_c{i * width + j}").alias(f"pred_{b}") for j, b in enumerate(labels)])
        for i, a in enumerate(labels)
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def classification_report(pred: DataFrame, by: Sequence[str] = (), y: str = "y_true",
                          p: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted means; 0 for 0/0."""
    pairs = pred.groupBy(*by, y, p).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(*by, "n", F.inline(F.array(
        F.struct(F.col(y).cast("string").alias("label"), F.lit(True).alias("is_true"), hit(y, p).alias("hit")),
        F.struct(F.col(p).cast("string").alias("label"), F.lit(False).alias("is_true"), hit(y, p).alias("hit")),
    )))
    per = sides.groupBy(*by, "label").agg(
        F.sum(F.when(F.col("is_true"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("is_true"), F.col("n")).otherwise(0)).alias("_predicted"),
        F.sum(F.when(F.col("is_true"), F.col("n") * F.col("hit")).otherwise(0.0)).alias("_hits"),
    )
    zero = F.lit(0.0)
    per = per.withColumns({
        "precision": F.coalesce(ratio("_hits", "_predicted"), zero),
        "recall": F.coalesce(ratio("_hits", "support"), zero),
    }).withColumn("f1", F.coalesce(
        ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    scores = ("precision", "recall", "f1")
    means = per.groupBy(*by).agg(
        *[F.avg(c).alias(f"macro_{c}") for c in scores],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in scores],
        F.sum("support").alias("support"),
    )
    summary = means.select(*by, F.inline(F.array(*[
        F.struct(F.lit(f"{kind} avg").alias("label"), *[F.col(f"{kind}_{c}").alias(c) for c in scores],
                 F.col("support"))
        for kind in ("macro", "weighted")
    ])))
    return per.select(*by, "label", *scores, "support").unionByName(summary)


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), large: bool = False) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of each column, one row per column.

    Exact quartiles keep one counter per distinct value in the aggregation buffer; grouping by asset
    bounds that by the length of its daily series. With ``large``, for groups without such a bound, they are
    found in a few passes over refined histograms instead.
    """
    points = (0.25, 0.5, 0.75)
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"),
                 F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
        if not large:
            aggs.append(F.percentile(c, F.array(*map(F.lit, points))).alias(f"q_{c}"))
    wide = df.groupBy(*by).agg(*aggs)
    rows = [F.struct(
        F.lit(c).alias("field"), F.col(f"n_{c}").alias("count"), F.col(f"mean_{c}").alias("mean"),
        F.col(f"std_{c}").alias("std"), F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max"),
        *([] if large else [F.col(f"q_{c}").alias("q")])) for c in columns]
    tidy = wide.select(*by, F.inline(F.array(*rows)))
    if large:
        found = quantiles(df, columns, points, by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("field").alias("_field"), "q")
        tidy = tidy.join(found, [tidy[c].eqNullSafe(found[f"_{c}"]) for c in (*by, "field")], "left")
    return tidy.select(*by, "field", "count", "mean", "std", "min",
                       *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "max")


def cluster_profile(df: DataFrame, features: Sequence[str], cluster: str = "regime") -> DataFrame:
    """Size and rounded feature means per cluster."""
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), *[F.round(F.avg(c), 3).alias(f"mean_{c}") for c in features])


def last_rows(df: DataFrame, n: int, s: Series = PERIODIC) -> DataFrame:
    """The last n rows of every series."""
    return df.withColumn("_rank", F.row_number().over(s.reversed)).filter(F.col("_rank") <= n).drop("_rank")
