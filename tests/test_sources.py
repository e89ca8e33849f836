"""Column detection, repair of text cells, stored tables and schema checks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.session import scratch_path, settle, shared_dir
from barloom.sources import checks, files
from barloom.sources.bars import between_days, brand_bars, day_bounds, one_per_day, segment_bars
from tests.conftest import collect


@pytest.mark.parametrize("columns, rule, want", [
    (["x", "Datetime", "date"], "listed", "date"), (["x", "timestamp"], "listed", "timestamp"), (["x", "y"], "listed", "x"),
    (["x", "DATE"], "equal", "DATE"), (["x", "trade_date"], "equal", "x"), (["x", "Trade Date"], "contains", "Trade Date"),
    (["x", "Date"], "exact", "x"), (["x", "date"], "exact", "date")])
def test_date_column(columns, rule, want):
    assert files.date_column(columns, rule) == want


@pytest.mark.parametrize("columns, rule, want", [
    (["Close", "Adj Close"], "listed", "Adj Close"), (["price", "Close"], "listed", "Close"),
    (["date", "CLOSE", "adj_close"], "contains", "adj_close"), (["date", "Last close"], "contains", "Last close"),
    (["date", "last"], "contains", "last")])
def test_price_column(columns, rule, want):
    assert files.price_column(columns, rule) == want


def test_detection_errors():
    with pytest.raises(ValueError, match="no price column"):
        files.price_column(["date", "value"])
    with pytest.raises(ValueError):
        files.date_column(["date"], "guess")
    with pytest.raises(ValueError):
        files.price_column(["date"], "guess")


def lines_of(spark, lines, folder="asset=SPY"):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/{folder}")
    return path


def test_positional_repair(spark):
    path = lines_of(spark, ["Price,Adj Close,Close,High,Low,Open,Volume", "Ticker,SPY,SPY,SPY,SPY,SPY,SPY", "Date,,,,,,",
                            "2024-01-02,1.5,x,2,1,1.25,100", "2024-01-03,,,,,,", "not a day,1,1,1,1,1,1", "2024-01-04,2,2,2,2,2,1e3"])
    rows = collect(files.read_positional(spark, path), ("d",))
    assert [r["d"] for r in rows] == [dt.date(2024, 1, 2), dt.date(2024, 1, 4)]
    assert rows[0]["adj_close"] == 1.5 and rows[0]["close"] is None and rows[1]["volume"] == 1000
    assert {r["asset"] for r in rows} == {"SPY"}


def test_detected_prices_and_required_columns(spark):
    path = lines_of(spark, ["Trade Date,open,My Adj Close", "2024-01-02,1,10.5", "bad,1,11", "2024-01-03,1,bad"])
    rows = collect(files.read_prices(spark, path, "contains", "contains"), ("d",))
    assert [(r["d"], r["adj_close"]) for r in rows] == [(dt.date(2024, 1, 2), 10.5)]
    with pytest.raises(ValueError, match="lacks columns"):
        files.read_ohlcv(spark, path)


def test_price_file_discovery(spark):
    path = scratch_path(spark, "folder")
    one = spark.createDataFrame([("a",)], "value string").coalesce(1)
    one.write.format("csv").save(f"{path}/sub")
    with pytest.raises(FileNotFoundError):  # what lies deeper is not looked at
        files.find_price_file(spark, path, ["none.csv"])
    one.write.format("csv").mode("append").save(path)
    found = files.find_price_file(spark, path, ["none.csv"])
    assert found.endswith(".csv") and found.rsplit("/", 1)[0].endswith(path)
    name = found.rsplit("/", 1)[1]
    assert files.find_price_file(spark, path, ["other.csv", name]) == found
    empty = scratch_path(spark, "empty")
    one.write.text(f"{empty}/sub")
    with pytest.raises(FileNotFoundError):
        files.find_price_file(spark, empty, ["none.csv"])


def test_store_and_read_back(spark, sf_dir):
    bars = segment_bars(spark, sf_dir)
    path = files.write_table(bars, scratch_path(spark, "bars"))
    back = between_days(files.read_labelled(spark, path), "1996-01-01", "1996-12-31")
    assert collect(back.select(*bars.columns), ("asset", "d")) == collect(between_days(bars, "1996-01-01", "1996-12-31"), ("asset", "d"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(d), GreaterThanOrEqual(d" in plan
    with pytest.raises(ValueError, match="lacks columns"):
        files.read_labelled(spark, path, "when")


def test_settled_table_keeps_rows_and_schema(spark, sf_dir):
    bars = segment_bars(spark, sf_dir)
    kept = settle(bars)
    assert kept.dtypes == bars.dtypes and kept.count() == bars.count()
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


def test_checks(spark):
    df = spark.createDataFrame([("A", 1, 2.0, "x")], "asset string, n int, v double, label string")
    assert checks.numeric_features(df, drop=["n"]) == ["v"]
    with pytest.raises(ValueError, match="no numeric"):
        checks.numeric_features(df, drop=["n", "v"])
    with pytest.raises(ValueError, match="no rows"):
        checks.require_rows(df.filter("n > 1"))
    with pytest.raises(ValueError, match="more than 3"):
        checks.require_history(df, 3)
    assert checks.require_history(df, 0) is df
    assert [r[0] for r in checks.unknown_labels(df, "label", ["y"]).collect()] == ["x"]
    with pytest.raises(Exception, match="unexpected label: x"):
        df.select(checks.known_label("label", ["y"])).collect()
    assert checks.complete_rows(df, ["n"], "label").dtypes[1] == ("n", "double")


def test_bars_are_unique_and_consistent(spark, sf_dir):
    for bars in (segment_bars(spark, sf_dir), brand_bars(spark, sf_dir)):
        assert bars.groupBy("asset", "d").count().filter("count > 1").isEmpty()
        tol = 1e-9
        assert bars.filter((F.col("high") < F.col("close") - tol) | (F.col("low") > F.col("close") + tol)).isEmpty()
    lo, hi = day_bounds(segment_bars(spark, sf_dir))
    assert lo < hi


def test_one_per_day(spark):
    d = dt.date(2024, 1, 2)
    df = spark.createDataFrame([("A", d, 1., 1., 1., 1., 1., 5.), ("A", d, 2., 2., 2., 2., 2., 9.), ("B", d, 3., 3., 3., 3., 3., None)],
                               "asset string, d date, open double, high double, low double, close double, adj_close double, volume double")
    assert [(r["asset"], r["close"]) for r in collect(one_per_day(df), ("asset",))] == [("A", 2.), ("B", 3.)]


def test_labelled_csv(spark):
    path = lines_of(spark, ["d,best_strategy,ret", "2024-01-02,Momentum,0.5", ",Momentum,1", "01/03/2024,,bad"])
    rows = collect(files.read_labelled(spark, path, fmt="csv"), ("d",))
    assert [tuple(r.values())[:3] for r in rows] == [(dt.date(2024, 1, 2), "Momentum", 0.5), (dt.date(2024, 1, 3), None, None)]


def test_headers_per_file_dates_and_empty_tables(spark):
    path = scratch_path(spark, "two")
    for lines in (["Date,Close,Volume", "2024-01-02,99,7", "2024-01-03,98,6"], ["Date,Volume,Close", "01/04/2024,7,97", "Jan 5, 2024,7,1"]):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
    rows = collect(files.read_prices(spark, path, keys=()), ("d",))
    assert [(r["d"].day, r["adj_close"]) for r in rows] == [(2, 99.0), (3, 98.0), (4, 97.0)]
    with pytest.raises(ValueError, match="no rows"):
        files.read_prices(spark, lines_of(spark, ["Date,Close", "never,1"]), keys=())


def test_repeated_dates_through_a_reader(spark):
    path = lines_of(spark, ["2024-01-02,1,1,1,1,1,5", "2024-01-02,2,2,2,2,2,9", "2024-01-03,3,3,3,3,3,1"])
    rows = collect(files.read_positional(spark, path, keys=()), ("d",))
    assert [(r["d"].day, r["close"], r["volume"]) for r in rows] == [(2, 2.0, 9.0), (3, 3.0, 1.0)]


def test_macro_range_reaches_the_scan_and_the_carry_is_spread(spark, sf_dir):
    from barloom.plans.catalog import QUERIES

    for name in ("macro_in_range", "macro_wide", "enriched_daily"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name
        if name == "macro_in_range":
            assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
