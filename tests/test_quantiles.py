"""Quantiles from refined histograms equal those of an aggregation that holds all values."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators.metrics import describe
from barloom.operators.quantiles import quantiles
from barloom.session import settle

POINTS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def _same(x, y):
    return x == y or (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y, rel=1e-15)


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    near = 1.0
    rows = [("ties", float(rng.randrange(3)), 1.0) for _ in range(200)]
    rows += [("wide", rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300), rng.gauss(0, 1)) for _ in range(300)]
    for _ in range(60):  # neighbouring doubles
        rows.append(("near", near, -near))
        near = math.nextafter(near, 2.0)
    rows += [("mixed", x, None) for x in (0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 1.7e308, -1.7e308, None)]
    rows += [(None, float(i), float(-i)) for i in range(7)] + [("one", 4.5, None), ("empty", None, None)]
    return settle(spark.createDataFrame(rows, "g string, a double, b double"))


def test_equal_to_percentile(values):
    got = {(r.g, r.field): r.q for r in quantiles(values, ["a", "b"], POINTS, ["g"]).collect()}
    points = F.array(*map(F.lit, POINTS))
    want = {(r.g, c): r[c] for r in values.groupBy("g").agg(F.percentile("a", points).alias("a"), F.percentile("b", points).alias("b")).collect()
            for c in ("a", "b") if r[c] is not None}
    assert got.keys() == want.keys()
    for k, q in want.items():
        assert len(q) == len(got[k]) and all(_same(x, y) for x, y in zip(got[k], q)), k


def test_without_groups_and_empty(spark, values):
    rows = quantiles(values.where("g = 'wide'"), ["b"], [0.5]).collect()
    whole = values.where("g = 'wide'").agg(F.percentile("b", 0.5)).first()[0]
    assert [(r.field, r.q) for r in rows] == [("b", [whole])]
    assert quantiles(values.limit(0), ["a"], [0.5], ["g"]).collect() == []
    with pytest.raises(ValueError, match="between 0 and 1"):
        quantiles(values, ["a"], [1.5])


def test_describe_large_equals_describe(values):
    some = values.where("g IN ('ties', 'near', 'empty') OR g IS NULL")
    plain, large = (sorted(map(tuple, describe(some, ["a", "b"], ["g"], x).collect()), key=str) for x in (False, True))
    assert plain == large


def test_no_buffer_of_values(values):
    plan = quantiles(values, ["a"], [0.5], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
