"""K-means of all starts at once: a resting point no worse than plain runs, the same for any order of the rows."""

from __future__ import annotations

import numpy as np
import pytest

from barloom.operators.clusters import cluster_regimes, seeded
from pyspark.sql import functions as F


def plain_cost(x, k, seed):
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(100):
        at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(k)])
    return ((x[:, None] - c) ** 2).sum(2).min(1).sum()


@pytest.mark.parametrize("k", [2, 3, 5])
def test_regimes_rest_and_are_the_best(spark, k):
    rng = np.random.default_rng(k)
    raw = np.round(rng.normal(size=(240, 3)) + rng.integers(0, 3, (240, 1)) * 2, 2) * [1, 10, 0.1]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(raw)], "i int, a double, b double, c double")
    got = {r.i: r.regime for r in cluster_regimes(df.repartition(3), ["a", "b", "c"], k).collect()}
    again = {r.i: r.regime for r in cluster_regimes(df.orderBy(F.desc("i")).coalesce(1), ["a", "b", "c"], k).collect()}
    x = (raw - raw.mean(0)) / raw.std(0)
    at = np.array([got[i] for i in range(len(x))])
    assert got == again and set(at) == set(range(k))
    means = np.array([x[at == j].mean(0) for j in range(k)])
    far = ((x[:, None] - means) ** 2).sum(2)
    assert (far.argmin(1) == at).all() and (np.diff(means[:, 0]) > 0).all()
    plain = np.array([plain_cost(x, k, s) for s in range(10)])
    assert far.min(1).sum() <= np.median(plain) * (1 + 1e-9) and far.min(1).sum() <= plain.min() * 1.02


def test_starts_differ_and_centres_are_rows(spark):
    x = np.random.default_rng(1).normal(size=(50, 2)).round(3)
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "x array<double>").withColumn("h", F.xxhash64("x"))
    centres = seeded(df.repartition(4), 2, 3, 6)
    assert centres.shape == (6, 3, 2) and len({tuple(c.ravel()) for c in centres}) == 6
    assert {tuple(c) for c in centres.reshape(-1, 2)} <= {tuple(r) for r in x}
    assert all(len({tuple(c) for c in start}) == 3 for start in centres)


def test_missing_values_equal_rows_and_empty_tables(spark):
    rows = [(1, 0.0, 1.0), (2, 0.0, 1.0), (3, None, 1.0), (4, 9.0, 1.0), (5, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    assert {r.i: r.regime for r in cluster_regimes(df, ["a", "b"]).collect()} == {1: 0, 2: 0, 3: None, 4: 1, 5: None}
    assert {r.regime for r in cluster_regimes(df.where("i = 3"), ["a", "b"]).collect()} == {None}
    assert cluster_regimes(df.limit(0), ["a", "b"]).collect() == []
