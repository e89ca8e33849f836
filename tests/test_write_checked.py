"""Checks while writing: counted in the writing job, faults named."""

from __future__ import annotations

import datetime as dt

import pytest

from barloom.session import scratch_path
from barloom.sources.files import write_checked, write_table

DAY = dt.date(2020, 1, 1)
SCHEMA = "asset string, d date, label string"


def test_counts_and_rows(spark):
    df = spark.createDataFrame([("a", DAY, "x"), ("a", DAY + dt.timedelta(1), None), ("b", DAY, "y")], SCHEMA)
    path = scratch_path(spark, "checked")
    assert write_checked(df, path, labels={"label": ["x", "y"]}) == {
        "rows": 3, "undated": 0, "first": DAY, "last": DAY + dt.timedelta(1), "unknown label": 0}
    assert sorted(map(tuple, spark.read.parquet(path).select("asset", "d", "label").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_faults_are_named(spark):
    df = spark.createDataFrame([("a", None, "z"), ("b", DAY, "x"), ("b", DAY, "z")], SCHEMA)
    with pytest.raises(ValueError, match="'undated': 1, 'unknown label': 2, 'rows': 3"):
        write_checked(df, scratch_path(spark, "checked"), labels={"label": ["x"]}, least=4)
    with pytest.raises(ValueError, match="'rows': 0"):
        write_checked(df.limit(0), scratch_path(spark, "checked"))
    with pytest.raises(ValueError, match="lacks columns"):
        write_checked(df, scratch_path(spark, "checked"), day_column="day")


def test_no_job_of_its_own(spark):
    df = spark.range(5000).selectExpr("concat('a', id % 7) asset", "date_add(DATE '2020-01-01', cast(id AS int)) d", "'x' label")

    def jobs(group, write):
        spark.sparkContext.setJobGroup(group, group)
        write(df, scratch_path(spark, "checked"))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        plain = jobs("plain write", write_table)
        checked = jobs("checked write", lambda *a: write_checked(*a, labels={"label": ["x"]}))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert plain == checked > 0
