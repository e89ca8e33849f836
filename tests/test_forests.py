"""Forests of all windows against a plain forest with the same bags, by both ways of growing and on many blocks."""

from __future__ import annotations

import numpy as np
import pytest

from barloom.operators import forests, lockstep
from barloom.operators.forests import bag, feature_order, fit_forest
from test_lockstep import BOUNDS, DAYS, FEATURES, arrays, panel, rows

TREES = 6


@pytest.fixture(params=["one block", "many blocks"])
def blocks(request, monkeypatch):
    if request.param == "many blocks":
        monkeypatch.setattr(lockstep, "BLOCK_ROWS", 13)


@pytest.fixture(params=["in a task", "by histograms at first", "by histograms"])
def way(request, monkeypatch):
    if request.param != "in a task":
        monkeypatch.setattr(forests, "LOCAL", 12 if request.param.endswith("first") else 0)
        monkeypatch.setattr(forests, "NODES", 7)


def impurity(y, w, classes):
    total = w.sum()
    return total - sum(w[y == c].sum() ** 2 for c in range(classes)) / total


def plain_tree(x, y, w, key, depth, leaf, tries, classes):
    """Nested tuples (feature, threshold, left, right) or the class shares of a leaf, by trying every cut."""
    here = np.array([w[y == c].sum() for c in range(classes)]) / w.sum()
    if depth == 0 or len(y) < 2 * leaf or len(set(y.tolist())) == 1:
        return here
    order = [int(j) for j in feature_order(key, x.shape[1])]
    varied = [j for j in order if len(set(x[:, j])) > 1]
    best = None
    for j in [j for j in order[:tries] if j in varied] or varied[:1]:
        values = np.unique(x[:, j])
        for lo, hi in zip(values[:-1], values[1:], strict=True):
            left = x[:, j] <= lo
            if min(left.sum(), (~left).sum()) >= leaf:
                rest = impurity(y[left], w[left], classes) + impurity(y[~left], w[~left], classes)
                if best is None or rest < best[0] - 1e-9:
                    best = rest, j, (lo + hi) / 2, left
    if best is None:
        return here
    _, j, cut, left = best
    below = None if depth is None else depth - 1
    return (j, cut, *[plain_tree(x[part], y[part], w[part], forests._key(key, side), below, leaf, tries, classes)
                      for side, part in enumerate((left, ~left))])


def plain_shares(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("classes,depth,leaf", [(3, None, 2), (2, 3, 4)])
def test_forest_equals_a_plain_forest(spark, blocks, way, classes, depth, leaf):
    data = rows(classes)
    made = panel(spark, data)
    hashes = {(r.asset, r.period_end): r.h for r in made.data.selectExpr("asset", "period_end", "xxhash64(asset, period_end) AS h").collect()}
    fitted = fit_forest(made, TREES, depth, leaf, seed=1)
    for fold, (lo, hi) in BOUNDS.items():
        x, y = arrays(data, fold)
        kept = sorted((r for r in data if DAYS[lo] <= r[1] <= DAYS[hi]), key=lambda r: (r[1], r[0]))
        h = np.array([hashes[r[:2]] for r in kept])
        want = np.zeros((len(x), classes))
        for t in range(TREES):
            times = bag(h, fold, t, 1)
            drawn = np.bincount(y, times, classes)
            weight = times * (drawn.sum() / ((drawn > 0).sum() * np.maximum(drawn, 1)))[y]
            at = np.flatnonzero(times)
            tree = plain_tree(x[at], y[at], weight[at], forests._key(1, fold, t, 0), depth, leaf, 1, classes)
            want += np.array([plain_shares(tree, row) for row in x])
        assert np.abs(fitted[fold].shares(x) - want / TREES).max() < 1e-9
        assert len(fitted[fold].trees) == TREES and max(len(t.feature) for t in fitted[fold].trees) > 3


def test_bags_are_draws_with_return():
    row = np.random.default_rng(3).integers(-2**63, 2**63, 200_000)
    a, b = bag(row, 1, 0, 42), bag(row, 1, 1, 42)
    assert abs(a.mean() - 1) < 0.01 and abs(a.var() - 1) < 0.02 and abs((a == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01
    assert not np.array_equal(a, bag(row, 2, 0, 42)) and np.array_equal(a, bag(row, 1, 0, 42))


def test_orders_of_features_are_even():
    first = np.bincount([feature_order(forests._key(7, i), 5)[0] for i in range(5000)], minlength=5)
    assert first.min() > 850 and first.max() < 1150


def test_wide_panels_look_at_the_root_of_their_features():
    assert forests.looked_at(np.array([3, 1, 0, 2]), np.array([True, True, True, False]), 2).tolist() == [1]
    assert forests.looked_at(np.array([3, 1, 0, 2]), np.array([True, False, True, False]), 2).tolist() == [0]
    assert forests.looked_at(np.array([1, 0]), np.array([False, False]), 1).tolist() == []
    assert len(FEATURES) == 3
