"""Tables of training windows are Spark plans over the data, not rows made on the driver."""

from __future__ import annotations

import pytest

from barloom.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["walkforward_scaling", "walkforward_weights"])
def test_windows_are_computed_in_the_plan(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "parquet" in plan and "LocalRelation" not in plan and "ExistingRDD" not in plan
