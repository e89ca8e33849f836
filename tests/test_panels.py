"""Panels stored in buckets: same rows, and no exchange before windows and aggregations per series."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from barloom.functions.frames import DAILY, lag_return
from barloom.operators.indicators import equity_features
from barloom.operators.metrics import performance
from barloom.session import scratch_path
from barloom.sources.bars import segment_bars
from barloom.sources.panels import attach_panel, store_panel
from tests.conftest import collect


def exchanges(df) -> int:
    df.collect()
    return len(re.findall(r"Exchange ", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]))


def named(spark):
    path = scratch_path(spark, "panel")
    return path.rsplit("/", 1)[1].replace("-", "_"), path


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    name, path = named(spark)
    return name, path, store_panel(segment_bars(spark, sf_dir), name, path, buckets=4)


def test_rows_come_back(spark, sf_dir, stored):
    assert collect(stored[2], ("asset", "d")) == collect(segment_bars(spark, sf_dir), ("asset", "d"))
    folder = stored[1].removeprefix("file://").removeprefix("file:")
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) <= 4


def test_features_and_performance_without_exchange(stored, spark, sf_dir):
    bars = stored[2]
    assert exchanges(equity_features(bars)) == 0
    assert exchanges(bars.groupBy("asset").agg(F.max("close"))) == 0
    returns = bars.withColumn("r", F.coalesce(lag_return("adj_close", DAILY), F.lit(0.0)))
    assert exchanges(performance(returns, {"r": "hold"}, 252, DAILY)) == 0
    assert exchanges(equity_features(segment_bars(spark, sf_dir))) > 0


def test_attached_by_another_session(spark, stored):
    name, path, bars = stored
    again = attach_panel(spark.newSession(), f"{name}_again", path,
                         ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema), buckets=4)
    assert exchanges(equity_features(again)) == 0
    assert collect(again, ("asset", "d")) == collect(bars, ("asset", "d"))


def test_existing_table_is_kept(stored):
    name, path, bars = stored
    with pytest.raises(Exception, match="(?i)exists"):
        store_panel(bars, name, path, buckets=4)
