"""Daily bars from transaction tables.

The raw tables are the large side: every builder below is one hash aggregation on (asset, day) with
map-side partial results, so a hot asset shrinks to one row per day before it is shuffled. From there
on an asset's series is bounded by the calendar (at most 366 rows per year).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.session import settle

BAR_COLUMNS = ("asset", "d", "open", "high", "low", "close", "adj_close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(trades: DataFrame, asset: str, time: str, price: str, trade_id: str) -> DataFrame:
    """Open/high/low/close/volume per asset and day; ``trade_id`` (unique, numeric) orders a day."""
    bars = trades.groupBy(F.col(asset).alias("asset"), F.to_date(time).alias("d")).agg(
        F.min_by(price, trade_id).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, trade_id).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return bars.withColumn("adj_close", F.col("close")).select(*BAR_COLUMNS)


def traded_between(trades: DataFrame, time: str, start: str | None, end: str | None) -> DataFrame:
    """Trades of a closed date range, compared on the raw time column so that the scan can skip row groups."""
    kind = trades.schema[time].dataType
    if start is not None:
        trades = trades.filter(F.col(time) >= F.lit(start).cast(kind))
    if end is not None:
        after = F.date_add(F.lit(end).cast("date"), 1)
        trades = trades.filter(F.col(time) < after.cast(kind))
    return trades


def segment_bars(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None,
                 segments: Sequence[str] | None = None) -> DataFrame:
    """Orders as trades, one asset per market segment of the ordering customer.

    The date range and the choice of segments are filters on the two scans.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    orders = traded_between(orders, "o_orderdate", start, end)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    if segments is not None:
        customer = customer.filter(F.col("c_mktsegment").isin(*segments))
    trades = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return daily_bars(trades, "c_mktsegment", "o_orderdate", "o_totalprice", "o_orderkey")


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades, one asset per part brand, priced by the day's average unit price.

    Lines have no unique key to order a day by, so the close is money over quantity: both sums run
    over whole cents and whole units, which makes the price independent of the order of rows.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return (
        lines.join(part, lines.l_partkey == part.p_partkey)
        .groupBy(F.col("p_brand").alias("asset"), F.to_date("l_shipdate").alias("d"))
        .agg(
            F.max(unit).alias("high"),
            F.min(unit).alias("low"),
            F.sum(cents).alias("cents"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("units"),
        )
        .withColumn("close", F.col("cents") / (F.col("units") * F.lit(100.0)))
        .select("asset", "d", F.col("close").alias("open"), "high", "low", "close",
                F.col("close").alias("adj_close"), F.col("units").cast("double").alias("volume"))
    )


def settled_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment bars written once, for plans that read them more than once: the raw tables are scanned and
    shuffled a single time however many branches follow."""
    return settle(segment_bars(spark, sf_dir))


def macro_quotes(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Tidy macro quotes (ticker, d, field, value) from the discount and tax rates of order lines.

    Rates are whole percents, so the day means are taken over integers and do not depend on row order. The
    date range is a filter on the scan; values before it are not carried into it.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_discount", "l_tax")
    lines = traded_between(lines, "l_shipdate", start, end)
    percent = {c: F.round(F.col(c) * 100).cast("bigint") for c in ("l_discount", "l_tax")}
    daily = lines.groupBy(F.to_date("l_shipdate").alias("d")).agg(
        F.sum(percent["l_discount"]).alias("disc"),
        F.sum(percent["l_tax"]).alias("tax"),
        F.count(F.lit(1)).alias("n"),
    )
    return daily.select(
        "d",
        (F.col("disc") / F.col("n")).alias("^VIX"),
        (F.lit(10.0) * F.col("tax") / F.col("n")).alias("^TNX"),
    ).unpivot("d", ["^VIX", "^TNX"], "ticker", "value").select(
        "ticker", "d", F.lit("adj_close").alias("field"), "value"
    )


def one_per_day(bars: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """One bar per key and day: of repeated dates the one with the largest volume, then close, is kept.

    Series windows count on it, both for row positions and for the bound on a series' length. Rows are dealt
    by key and sorted by day, as the series windows that follow need them, so they add no exchange.
    """
    ranked = [F.desc_nulls_last(c) for c in ("volume", "close", "adj_close", "open", "high", "low") if c in bars.columns]
    day = Window.partitionBy(*keys, "d").orderBy(*ranked)
    dealt = bars.repartition(*[F.col(k) for k in keys]) if keys else bars
    return dealt.withColumn("_rank", F.row_number().over(day)).filter(F.col("_rank") == 1).drop("_rank")


def between_days(bars: DataFrame, start: str | Column | None = None, end: str | Column | None = None) -> DataFrame:
    """Closed date range as a filter on the bar date; apply it before any window."""
    if start is not None:
        bars = bars.filter(F.col("d") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col("d") <= F.lit(end).cast("date"))
    return bars


def day_bounds(df: DataFrame, column: str = "d"):
    """First and last day, one row to the driver, so that a side read gets a pushed literal range."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    return row["lo"], row["hi"]
