"""Running values carried from block to block equal those of one window over the whole series."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.frames import Series, ffill, growth, running_max
from barloom.operators.blocks import number_rows
from barloom.operators.scans import growth_scan, held, last_scan, max_scan, scan, sum_scan
from barloom.session import settle
from tests.conftest import collect

S = Series()


@pytest.fixture(scope="module")
def moves(spark):
    """Series with gaps, one that starts with missing values, one without any, one of one row."""
    rng = random.Random(5)
    rows = []
    for asset, n, share in (("gaps", 83, 0.3), ("late", 64, 0.0), ("none", 21, 1.0), ("one", 1, 0.0)):
        for i in range(n):
            gone = rng.random() < share or (asset == "late" and i < 25)
            rows.append((asset, dt.date(2019, 11, 20) + dt.timedelta(days=2 * i), None if gone else rng.uniform(-0.2, 0.25)))
    return settle(number_rows(spark.createDataFrame(rows, "asset string, d date, r double"), S))


@pytest.mark.parametrize("rows", [1, 2, 7, 20, 64, 1000])
def test_blocks_equal_one_window(moves, rows):
    whole = collect(moves.withColumns({"eq": growth("r", S), "top": running_max("r", S), "last": ffill("r", S),
                                       "sum": F.sum("r").over(S.so_far)}), ("asset", "d"))
    parts = collect(scan(moves, S, {"eq": growth_scan("r"), "top": max_scan("r"), "last": last_scan("r"), "sum": sum_scan("r")},
                         rows), ("asset", "d"))
    assert len(whole) == len(parts) == 169
    for a, b in zip(whole, parts):
        assert (a["asset"], a["d"], a["r"], a["top"], a["last"]) == (b["asset"], b["d"], b["r"], b["top"], b["last"])
        for c in ("eq", "sum"):
            assert (a[c] is None) == (b[c] is None)
            assert a[c] is None or b[c] == pytest.approx(a[c], rel=1e-12, abs=1e-12)


def test_held_in_blocks(moves):
    plain, blocks = (collect(held(moves, S, {"h": "r"}, n), ("asset", "d")) for n in (None, 7))
    assert plain == blocks


def test_an_output_may_replace_its_input(moves):
    rows = collect(scan(moves, S, {"r": last_scan("r")}, 7), ("asset", "d"))
    assert [x["r"] for x in rows] == [x["h"] for x in collect(held(moves, S, {"h": "r"}), ("asset", "d"))]


def test_empty_table_and_no_rows_in_a_block(moves):
    assert scan(moves.limit(0), S, {"top": max_scan("r")}, 4).collect() == []
    with pytest.raises(ValueError, match="at least one row"):
        scan(moves, S, {"top": max_scan("r")}, 0)


def test_no_window_over_a_whole_series(moves):
    """The only window partitioned by the asset alone runs over the totals, one row for each block."""
    plan = scan(moves, S, {"top": max_scan("r")}, 7)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    alone = [line for line in windows if "_block" not in line.split("], [")[1]]
    assert len(alone) == 1 and "_t_top" in alone[0]
