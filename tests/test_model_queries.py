"""Every query without SQL, on tables large enough for its windows: shape, ranges and decisions of its rows."""

from __future__ import annotations

import math

import pytest

from barloom.functions.scalars import STRATEGIES
from barloom.operators.learning import fit_predict, logistic
from barloom.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"
MODELS = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", MODELS)
def test_model_query(spark, name):
    rows = [r.asDict() for r in QUERIES[name](spark, SF_DIR).collect()]
    assert rows
    for r in rows:
        if "y_pred" in r:
            assert r["y_pred"] in (0, 1, 2) and r["y_true"] in (0, 1, 2) and r["fold"] >= 1
        if "go_active" in r:
            assert 0 <= r["p_active"] <= 1 and r["go_active"] == int(r["p_active"] >= 0.55)
        if "best_strategy" in r:
            assert r["best_strategy"] is None or r["best_strategy"] in (*STRATEGIES, "buy_hold", "momentum", "mean_reversion")
        if "regime" in r:
            assert r["regime"] in (0, 1, 2)
        for c in ("accuracy", "balanced_accuracy", "share"):
            assert c not in r or 0 <= r[c] <= 1
        if "sharpe" in r and r["sharpe"] is not None:
            assert math.isfinite(r["sharpe"]) and r["max_drawdown"] <= 0 and r["periods"] > 0
    keys = [c for c in ("asset", "period_end", "strategy", "model", "best_strategy") if c in rows[0]]
    keys += [c for c in ("regime",) if c in rows[0] and "period_end" not in rows[0]]
    assert len({tuple(r[k] for k in keys) for r in rows}) == len(rows)


def test_probability_is_of_class_one_or_missing(spark):
    df = spark.createDataFrame([(float(i % 5), i % 3) for i in range(60)], "x double, y int").coalesce(1)
    assert {r.p_active for r in fit_predict(df, df, ["x"], "y", logistic()).collect()} == {None}
    for only, want in ((0, 0.0), (1, 1.0), (2, None)):
        one = df.where("y = 0").selectExpr("x", f"{only} AS y")
        assert {(r.y_pred, r.p_active) for r in fit_predict(one, one, ["x"], "y", logistic()).collect()} == {(only, want)}
