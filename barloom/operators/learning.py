"""Walk-forward training on a pooled panel and model comparison.

All assets of a training window are fitted together, and all windows of a run in the same jobs (``lockstep``,
``forests``). What reaches the driver is the list of periods, scaling statistics and class counts of each, coefficients
and trees: bounded by the calendar and the schema, but for forests without a depth.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.forests import fit_forest
from barloom.operators.lockstep import (
    Panel, Window, day_number, fit_boosting, fit_logistic, quantiles, scored,
)

SEED = 42


@dataclass(frozen=True)
class Logistic:
    """L2 logistic regression with balanced class weights; ``c`` is the weight of the loss."""

    c: float = 1.0
    steps: int = 1000
    scaler: str = "standard"
    name: str = "Logistic Regression"


@dataclass(frozen=True)
class Forest:
    """Random forest, classes weighted by their share of each tree's bag; no depth means no limit."""

    trees: int = 200
    depth: int | None = None
    leaf: int = 5
    name: str = "Random Forest"


@dataclass(frozen=True)
class Boosting:
    """Boosted trees on the soft-max loss. Trees do not depend on the features' scale, so nothing is scaled."""

    rounds: int = 200
    rate: float = 0.05
    depth: int = 3
    subsample: float = 1.0
    name: str = "Gradient Boosting"


Model = Logistic | Forest | Boosting


def logistic(c: float = 1.0, max_iter: int = 1000, scaler: str = "standard") -> Logistic:
    return Logistic(c, max_iter, scaler)


def forest(trees: int = 200, depth: int | None = None, leaf: int = 5) -> Forest:
    return Forest(trees, depth, leaf)


def boosting(rounds: int = 200, rate: float = 0.05, depth: int = 3, subsample: float = 1.0) -> Boosting:
    return Boosting(rounds, rate, depth, subsample)


def daily_models() -> list[Model]:
    return [logistic(), forest(), boosting()]


def monthly_models() -> list[Model]:
    return [logistic(scaler="robust"), forest(150, 3, 4), boosting(80, 0.1, 1, 0.8)]


def weekly_models() -> list[Model]:
    return [logistic(0.5, 500), forest(300, 4, 5), boosting(200, 0.05, 2, 0.7)]


# --- splits ---------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Split:
    """Closed date bounds of a training window and of the rows tested with it."""

    fold: int
    train_from: date
    train_to: date
    test_from: date
    test_to: date


def period_list(df: DataFrame, period: str = "period_end") -> list[date]:
    """The distinct periods of a panel: at most one per calendar step, whatever the number of assets."""
    return [r[0] for r in df.select(period).distinct().orderBy(period).collect()]


def expanding_splits(periods: Sequence[date], min_train: int, refit_every: int = 1, embargo: int = 0) -> list[Split]:
    """Train on everything up to ``embargo`` periods before the test, refit every few periods."""
    if len(periods) <= min_train:
        raise ValueError(f"{len(periods)} periods, more than {min_train} are needed")
    starts = range(min_train, len(periods), refit_every)
    return [Split(k, periods[0], periods[i - 1 - embargo], periods[i], periods[min(i + refit_every, len(periods)) - 1])
            for k, i in enumerate(starts, 1) if i - 1 - embargo >= 0]


def rolling_splits(periods: Sequence[date], window: int = 60, refit_every: int = 1) -> list[Split]:
    """Train on the ``window`` periods before the test."""
    if len(periods) <= window:
        raise ValueError(f"{len(periods)} periods, more than {window} are needed")
    return [Split(k, periods[i - window], periods[i - 1], periods[i], periods[min(i + refit_every, len(periods)) - 1])
            for k, i in enumerate(range(window, len(periods), refit_every), 1)]


def _minus_months(d: date, n: int) -> date:
    index = d.year * 12 + d.month - 1 - n
    year, month = divmod(index, 12)
    following = date(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (following - date.resolution).day
    return date(year, month + 1, min(d.day, last))


def calendar_splits(periods: Sequence[date], years: int = 5, min_periods: int = 24, refit_every: int = 1) -> list[Split]:
    """Train on ``[t - years, t - 1 month]`` where that holds at least ``min_periods`` periods."""
    splits, i = [], 0
    while i < len(periods):
        lo, hi = _minus_months(periods[i], 12 * years), _minus_months(periods[i], 1)
        if sum(lo <= p <= hi for p in periods) < min_periods:
            i += 1
            continue
        stop = min(i + refit_every, len(periods)) - 1
        splits.append(Split(len(splits) + 1, lo, hi, periods[i], periods[stop]))
        i = stop + 1
    return splits


def kfold_splits(periods: Sequence[date], k: int = 5) -> list[Split]:
    """Expanding k-fold over the periods of the panel."""
    size = len(periods) // (k + 1)
    if size == 0:
        raise ValueError(f"{len(periods)} periods are too few for {k} folds")
    starts = [len(periods) - size * (k - j) for j in range(k)]
    return [Split(j, periods[0], periods[i - 1], periods[i], periods[i + size - 1]) for j, i in enumerate(starts, 1)]


# --- fitting --------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class PeriodStats:
    """Rows, class, and per feature mean and mean square deviation of one period and class."""

    period: date
    label: object
    n: int
    means: tuple[float, ...]
    squares: tuple[float, ...]


def period_stats(data: DataFrame, features: Sequence[str], label: str, period: str = "period_end") -> list[PeriodStats]:
    """What every window's scaling and class weights follow from: one aggregation, one row per period and class."""
    sides = [x for c in features for x in (F.avg(c), F.var_pop(c))]
    rows = data.groupBy(period, label).agg(F.count(F.lit(1)), *sides).collect()
    rows.sort(key=lambda r: (r[0], r[1] is None, r[1]))
    return [PeriodStats(r[0], r[1], r[2], tuple(r[3::2]), tuple(r[4::2])) for r in rows]


def window_stats(stats: Sequence[PeriodStats], split: Split) -> tuple[int, list[tuple[float, float]], dict]:
    """Rows, (mean, deviation) of every feature and rows per class of a training window."""
    inside = [s for s in stats if split.train_from <= s.period <= split.train_to]
    n, counts = sum(s.n for s in inside), {}
    for s in inside:
        counts[s.label] = counts.get(s.label, 0) + s.n
    moments = []
    for j in range(len(inside[0].means) if inside else 0):
        mean = sum(s.n * s.means[j] for s in inside) / n
        square = sum(s.n * (s.squares[j] + (s.means[j] - mean) ** 2) for s in inside) / n
        moments.append((mean, square ** 0.5))
    return n, moments, counts


def training_windows(stats: Sequence[PeriodStats], splits: Sequence[Split]) -> tuple[list[Window], dict]:
    """Windows that have rows, and (mean, deviation) of every feature of each."""
    windows, moments = [], {}
    for s in splits:
        n, found, counts = window_stats(stats, s)
        if n:
            classes = tuple(sorted(int(v) for v in counts))
            windows.append(Window(s.fold, day_number(s.train_from), day_number(s.train_to), classes, tuple(counts[v] for v in classes)))
            moments[s.fold] = np.array([m for m, _ in found]), np.array([d or 1.0 for _, d in found])
    return windows, moments


def _scales(panel: Panel, scaler: str, moments: dict) -> dict:
    """Centre and scale of every window: mean and deviation, or median and quartile range, both exact."""
    if scaler == "standard":
        return moments
    return {f: (q[1], np.where(q[2] > q[0], q[2] - q[0], 1.0)) for f, q in quantiles(panel).items()}


def _scorer(fitted: dict, windows: Sequence[Window]) -> Callable:
    """y_pred and p_active of a fold's rows. A window of one class predicts that class."""
    of = {w.fold: w.classes for w in windows}

    def score(fold: int, x: np.ndarray):
        classes, none = of[fold], np.full(len(x), np.nan)
        if len(classes) == 1:
            chosen, p = np.full(len(x), classes[0]), np.full(len(x), float(classes[0])) if classes[0] in (0, 1) else none
        elif hasattr(fitted[fold], "probabilities"):
            share = fitted[fold].probabilities(x)
            chosen, p = np.array(classes)[share.argmax(1)], share[:, 1] if classes == (0, 1) else none
        else:
            chosen, p = fitted[fold].chosen(x), none
        return pa.array(chosen.astype(np.int32)), pa.array(p, mask=np.isnan(p))

    return score


def _fitted(panel: Panel, model: Model, moments: dict) -> dict:
    if isinstance(model, Logistic):
        return fit_logistic(panel, model.c, _scales(panel, model.scaler, moments), model.steps)
    if isinstance(model, Forest):
        return fit_forest(panel, model.trees, model.depth, model.leaf, SEED)
    return fit_boosting(panel, model.rounds, model.rate, model.depth, model.subsample, SEED)


def fit_predict(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, model: Model) -> DataFrame | None:
    """The test rows with y_pred and p_active, or None when there is no training row.

    ``p_active`` is the logistic probability of class 1 where the classes are 0 and 1, and missing otherwise.
    """
    day = date(2000, 1, 1)
    dated = train.withColumn("_at", F.lit(day))
    windows, moments = training_windows(period_stats(dated, features, label, "_at"), [Split(1, day, day, day, day)])
    if not windows:
        return None
    panel = Panel(dated, features, label, windows, windows[0].rows, list(features), "_at")
    fitted = _fitted(panel, model, moments)
    span = [(1, day_number(day), day_number(day))]
    return scored(test.withColumn("_at", F.lit(day)), features, test.columns, "_at", span, _scorer(fitted, windows),
                  "y_pred int, p_active double").drop("fold")


def compare_models(data: DataFrame, features: Sequence[str], label: str, models: Sequence[Model],
                   splits: Sequence[Split], keys: Sequence[str] = ("asset",), period: str = "period_end") -> DataFrame:
    """Out-of-sample predictions of every model and split.

    Columns: keys, period, model, fold, y_true, y_pred, p_active. ``data`` is scanned several times; settle it first.
    Scaling statistics and class counts of all windows come from one aggregation.
    """
    stats = period_stats(data, features, label, period)
    windows, moments = training_windows(stats, splits)
    if not windows:
        raise ValueError("no split has training rows")
    trained = {w.fold for w in windows}
    tests = [(s.fold, day_number(s.test_from), day_number(s.test_to)) for s in splits if s.fold in trained]
    kept, found = [*keys, period], []
    panel = Panel(data, features, label, windows, sum(s.n for s in stats), keys, period)
    rows = data.withColumn("y_true", F.col(label).cast("int"))
    for model in models:
        done = scored(rows, features, [*kept, "y_true"], period, tests, _scorer(_fitted(panel, model, moments), windows),
                      "y_pred int, p_active double")
        found.append(done.select(*kept, F.lit(model.name).alias("model"), "fold", "y_true", "y_pred", "p_active"))
    panel.rdd.unpersist()
    return reduce(DataFrame.unionByName, found)


def walk_forward(data: DataFrame, features: Sequence[str], label: str, model: Model, splits: Sequence[Split],
                 **options) -> DataFrame:
    """``compare_models`` for a single model."""
    return compare_models(data, features, label, [model], splits, **options).drop("model")
