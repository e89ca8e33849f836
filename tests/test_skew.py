"""A customer with a third of all orders: the dimension join is split, and the day bars collapse it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.session import scratch_path
from barloom.sources.bars import segment_bars
from tests.conftest import collect

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(scope="module")
def hot_tables(spark):
    """200,000 orders over 400 days, every third one by customer 7."""
    path = scratch_path(spark, "hot")
    n = F.col("id")
    orders = spark.range(200_000, numPartitions=8).select(
        n.alias("o_orderkey"), F.when(n % 3 == 0, 7).otherwise(n % 1000).cast("bigint").alias("o_custkey"),
        (F.pmod(F.hash(n), F.lit(100_000)) / 100 + 1).alias("o_totalprice"),
        F.date_add(F.lit("2020-01-01").cast("date"), (n % 400).cast("int")).cast("timestamp_ntz").alias("o_orderdate"))
    orders.write.parquet(f"{path}/orders.parquet")
    customer = spark.range(1000).select(
        n.alias("c_custkey"), F.concat(F.lit("segment "), (n % 3).cast("string")).alias("c_mktsegment"))
    customer.write.parquet(f"{path}/customer.parquet")
    return path


def test_hot_customer_is_split_and_bars_are_whole(spark, hot_tables):
    old = {k: spark.conf.get(k, None) for k in SKEW}
    try:
        for k, v in SKEW.items():
            spark.conf.set(k, v)
        bars = segment_bars(spark, hot_tables)
        got = collect(bars, ("asset", "d"))
        plan = bars._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in plan
    # the same bars without any join: the segment follows from the customer key
    orders = spark.read.parquet(f"{hot_tables}/orders.parquet")
    want = orders.groupBy(
        F.concat(F.lit("segment "), (F.col("o_custkey") % 3).cast("string")).alias("asset"),
        F.to_date("o_orderdate").alias("d")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"))
    rows = collect(want.withColumn("adj_close", F.col("close")), ("asset", "d"))
    assert len(got) == len(rows) == 1200
    for a, b in zip(got, rows):
        assert a == b
    assert sum(r["volume"] for r in got) == 200_000


def test_hot_asset_is_combined_before_the_shuffle(spark, hot_tables):
    """The exchange of the day aggregation carries partial rows, not trades."""
    bars = segment_bars(spark, hot_tables)
    bars.collect()
    plan = bars._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchange = plan.index("Exchange hashpartitioning(c_mktsegment")
    assert "partial_max(o_totalprice" in plan[exchange:exchange + 800]
    assert "SortAggregate" not in plan
