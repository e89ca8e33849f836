"""Settings that the registered tree queries hand to training: models, windows and refits as published."""

from __future__ import annotations

import pytest

from barloom.operators import learning as operators
from barloom.operators.learning import period_list
from barloom.plans import chains, learning
from barloom.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.01"
BOOST_MONTH, BOOST_CALENDAR, BOOST_WEEK = (200, .05, 3, 1.0), (150, .05, 2, .8), (200, .05, 2, .7)
#: Query: rounds, rate, depth, subsample of boosting; trees, depth, leaf of the forest; first window (None: folds).
WANT = {
    "walkforward_gbt": (BOOST_MONTH, None, 60),
    "perf_adaptive": (BOOST_MONTH, None, 60),
    "walkforward_gbt_calendar": (BOOST_CALENDAR, None, 24),
    "perf_crypto_monthly": (BOOST_CALENDAR, None, 24),
    "perf_adaptive_weekly": (BOOST_WEEK, None, 104),
    "cv_model_comparison": ((200, .05, 3, 1.0), (200, None, 5), None),
    "cv_daily_comparison": ((200, .05, 3, 1.0), (200, None, 5), None),
    "cv_weekly_comparison": (BOOST_WEEK, (300, 4, 5), None),
    "cv_rolling_comparison": ((80, .1, 1, .8), (150, 3, 4), 60),
}


class Handed(Exception):
    pass


@pytest.fixture
def handed(monkeypatch):
    """Runs a query up to its training and returns what training would have got."""

    def stop(data, features, label, models, splits, keys=("asset",), period="period_end"):
        raise Handed(models, splits, period_list(data, period))

    for module in (operators, learning, chains):
        monkeypatch.setattr(module, "compare_models", stop)

    def run(spark, name):
        with pytest.raises(Handed) as caught:
            QUERIES[name](spark, SF_DIR)
        return caught.value.args

    return run


@pytest.mark.parametrize("name", sorted(WANT))
def test_tree_queries_run_the_published_job(spark, handed, name):
    boost, trees, first = WANT[name]
    models, splits, periods = handed(spark, name)
    made = {m.name: m for m in models}
    gb = made["Gradient Boosting"]
    assert (gb.rounds, gb.rate, gb.depth, gb.subsample) == boost
    assert ("Random Forest" in made) == (trees is not None)
    if trees:
        rf = made["Random Forest"]
        assert (rf.trees, rf.depth, rf.leaf) == trees
    if first is None:
        assert len(splits) == 5
    else:  # each period from the first full window on is tested by a fit of its own
        assert all(s.test_from == s.test_to for s in splits)
        assert [s.test_from for s in splits] == periods[-len(splits):]
        inside = [sum(s.train_from <= p <= s.train_to for p in periods) for s in splits]
        assert inside[0] == first or (first == 24 and min(inside) >= first)
        assert name != "cv_rolling_comparison" or set(inside) == {60}
