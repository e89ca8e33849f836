"""Training of all windows at once against plain loops over one window, on one block and on many."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from barloom.operators import lockstep
from barloom.operators.learning import Split, boosting, compare_models, forest, logistic
from barloom.operators.lockstep import Panel, Window, day_number, fit_boosting, fit_logistic, in_bag, quantiles

FEATURES = ["a", "b", "c"]
DAYS = [dt.date(2000, 1, 31) + dt.timedelta(30 * i) for i in range(30)]
#: Bounds of the windows by position of their periods.
BOUNDS = {1: (0, 19), 2: (4, 24), 3: (0, 28)}


def rows(classes):
    rng, out = np.random.default_rng(classes), []
    for asset in "AB":
        for day in DAYS:
            x = np.round(rng.normal(size=3), 1)
            y = int(x[0] + x[1] / 2 + rng.normal() / 2 > 0.3) + (classes > 2) * int(x[2] > 0.8)
            out.append((asset, day, *map(float, x), y))
    return out


def arrays(data, fold):
    lo, hi = BOUNDS[fold]
    kept = sorted((r for r in data if DAYS[lo] <= r[1] <= DAYS[hi]), key=lambda r: (r[1], r[0]))
    return np.array([r[2:5] for r in kept]), np.array([r[5] for r in kept])


def panel(spark, data):
    windows = []
    for fold, (lo, hi) in BOUNDS.items():
        y = arrays(data, fold)[1]
        classes = sorted(set(y.tolist()))
        windows.append(Window(fold, day_number(DAYS[lo]), day_number(DAYS[hi]), tuple(classes), tuple(int((y == c).sum()) for c in classes)))
    df = spark.createDataFrame(data, "asset string, period_end date, a double, b double, c double, y int").repartition(3)
    return Panel(df, FEATURES, "y", windows, len(data), ["asset"], "period_end")


@pytest.fixture(params=["one block", "many blocks"])
def blocks(request, monkeypatch):
    if request.param == "many blocks":
        monkeypatch.setattr(lockstep, "BLOCK_ROWS", 13)


def test_quantiles_are_exact(spark, blocks):
    data = rows(3)
    got = quantiles(panel(spark, data), (0, 0.25, 0.5, 0.75, 1))
    for fold in BOUNDS:
        assert np.array_equal(got[fold], np.quantile(arrays(data, fold)[0], [0, .25, .5, .75, 1], axis=0))


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_gradients_vanish(spark, blocks, classes):
    data = rows(classes)
    scales = {f: (arrays(data, f)[0].mean(0), arrays(data, f)[0].std(0)) for f in BOUNDS}
    fitted = fit_logistic(panel(spark, data), 0.5, scales)
    for fold in BOUNDS:
        x, y = arrays(data, fold)
        weight = len(y) / (len(set(y)) * np.bincount(y))[y]
        z = np.c_[np.ones(len(y)), (x - scales[fold][0]) / scales[fold][1]]
        p = fitted[fold].probabilities(x)
        error = (p - (y[:, None] == np.arange(classes))) * weight[:, None]
        coef = fitted[fold].coef
        if classes == 2:
            error = error[:, 1:]
        grad = 0.5 * error.T @ z
        grad[:, 1:] += coef[:, 1:]
        assert np.abs(grad).max() < 1e-6


def plain_tree(x, r, h, depth, factor):
    """Nested tuples (feature, threshold, left, right) or a leaf value: best split by squared difference of means."""
    den = h.sum()
    leaf = factor * r.sum() / den if abs(den) > 1e-150 else 0.0
    best = None
    if depth and len(r) > 1:
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for lo, hi in zip(values[:-1], values[1:], strict=True):
                left = x[:, j] <= lo
                n, m = left.sum(), (~left).sum()
                gain = n * m * (r[left].mean() - r[~left].mean()) ** 2
                if gain > 1e-14 * len(r) ** 2 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = gain, j, (lo + hi) / 2, left
    if best is None:
        return leaf
    _, j, cut, left = best
    return j, cut, plain_tree(x[left], r[left], h[left], depth - 1, factor), plain_tree(x[~left], r[~left], h[~left], depth - 1, factor)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_booster(x, y, rounds, rate, depth, bags):
    k = len(set(y))
    share = np.bincount(y) / len(y)
    z = np.tile(np.log(share), (len(y), 1)) if k > 2 else np.full((len(y), 1), np.log(share[1] / share[0]))
    trees = []
    for bag in bags[:rounds]:
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True) if k > 2 else 1 / (1 + np.exp(-z))
        target = (y[:, None] == np.arange(k)) if k > 2 else (y == 1)[:, None]
        made = [plain_tree(x[bag], (target - p)[bag, o], (p * (1 - p))[bag, o], depth, (k - 1) / k if k > 2 else 1) for o in range(z.shape[1])]
        z = z + rate * np.array([[plain_value(t, row) for t in made] for row in x])
        trees.append(made)
    return z, trees


@pytest.mark.parametrize("classes,depth,share", [(3, 2, 1.0), (2, 3, 0.7)])
def test_boosting_equals_a_plain_booster(spark, blocks, classes, depth, share):
    data, rounds = rows(classes), lockstep.KEEP_EVERY + 3
    made = panel(spark, data)
    hashes = {(r.asset, r.period_end): r.h for r in made.data.selectExpr("asset", "period_end", "xxhash64(asset, period_end) AS h").collect()}
    fitted = fit_boosting(made, rounds, 0.3, depth, share, seed=1)
    for fold, (lo, hi) in BOUNDS.items():
        x, y = arrays(data, fold)
        kept = sorted((r for r in data if DAYS[lo] <= r[1] <= DAYS[hi]), key=lambda r: (r[1], r[0]))
        h = np.array([hashes[r[:2]] for r in kept])
        bags = [in_bag(h, k, share, 1) for k in range(rounds)]
        assert share == 1 or 0.5 < np.mean(bags) < 0.9
        z, _ = plain_booster(x, y, rounds, 0.3, depth, bags)
        model = fitted[fold]
        got = np.tile(model.start, (len(x), 1))
        for r in range(rounds):
            t = lockstep.Tree(model.trees.feature[r], model.trees.threshold[r], model.trees.value[r])
            got = got + 0.3 * t.scores(x)
        assert np.abs(got - z).max() < 1e-8
        want = z.argmax(1) if classes > 2 else (z[:, 0] > 0).astype(int)
        assert model.chosen(x).tolist() == want.tolist()


def test_coarse_bins_split_the_rows_they_counted(spark, blocks):
    """With more values than bins, the rows below a threshold are those of the bins that were counted."""
    rng = np.random.default_rng(5)
    data = [("A", DAYS[i % 30], *map(float, rng.normal(size=3)), int(rng.random() < 0.5)) for i in range(900)]
    made = panel(spark, data)
    bins = lockstep.cut_points(made)
    x = np.array([r[2:5] for r in data])
    at = bins.of(x)
    for j in range(3):
        assert len(bins.high[j]) <= lockstep.BINS + 1
        for i in range(len(bins.high[j]) - 1):
            assert bins.high[j][i] < bins.low[j][i + 1] <= bins.high[j][i + 1]
            assert ((x[:, j] <= (bins.high[j][i] + bins.low[j][i + 1]) / 2) == (at[:, j] <= i)).all()


def test_runs_end_to_end(spark):
    """Windows of one class, of two of three classes, and without rows; every tested row once."""
    data = [(a, d, x, z, c, 2 if d <= DAYS[9] else y) for a, d, x, z, c, y in rows(3)]
    data = [r for r in data if not (r[5] == 1 and r[1] <= DAYS[14])]
    df = spark.createDataFrame(data, "asset string, period_end date, a double, b double, c double, y int")
    span = lambda k, a, b, c, d: Split(k, DAYS[a], DAYS[b], DAYS[c], DAYS[d])
    early = Split(0, dt.date(1990, 1, 1), dt.date(1990, 2, 1), DAYS[0], DAYS[3])
    splits = [early, span(1, 0, 9, 10, 12), span(2, 0, 14, 15, 17), span(3, 0, 27, 28, 29)]
    got = compare_models(df, FEATURES, "y", [logistic(), boosting(3, 0.1, 2), forest(5, None, 2)], splits).collect()
    for name in ("Logistic Regression", "Gradient Boosting", "Random Forest"):
        mine = [r for r in got if r.model == name]
        assert {r.y_pred for r in mine if r.fold == 1} == {2}
        assert {r.y_pred for r in mine if r.fold == 2} <= {0, 2}
        tested = [(r[0], r[1]) for r in data if DAYS.index(r[1]) in (10, 11, 12, 15, 16, 17, 28, 29)]
        assert sorted((r.asset, r.period_end) for r in mine) == sorted(tested)
        assert all(r.p_active is None for r in mine)
