"""Blocked long-series plans give the same rows as one window per asset."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.frames import Series, rolling_mean
from barloom.operators.blocks import in_blocks, number_rows
from barloom.operators.indicators import crypto_features, equity_features
from barloom.operators.smoothing import ewm, ewm_by_year
from barloom.sources.bars import brand_bars
from barloom.session import settle
from tests.conftest import collect
from tests.test_windows import bars_of, random_series

S = Series()


@pytest.fixture(scope="module")
def panel(spark):
    """A long, a sparse and a one-row series."""
    parts = [bars_of(spark, price, days, name) for name, (days, price) in {
        "long": random_series(1400, 11, 0.0), "sparse": random_series(1400, 12, 0.8), "one": random_series(1, 13, 0.0)}.items()]
    return settle(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def test_row_numbers(panel):
    rows = collect(number_rows(panel, S), ("asset", "d"))
    seen = {}
    for r in rows:
        seen[r["asset"]] = seen.get(r["asset"], 0) + 1
        assert r["row_nr"] == seen[r["asset"]]
    assert len(rows) == panel.count()


def test_means_by_year_equal_whole_series(panel):
    outputs = {f"e{n}": ("adj_close", n) for n in (3, 9, 26)}
    a = collect(ewm(panel, outputs), ("asset", "d"))
    b = collect(ewm_by_year(panel, outputs), ("asset", "d"))
    for name in outputs:
        np.testing.assert_allclose([r[name] for r in a], [r[name] for r in b], rtol=1e-13)


@pytest.mark.parametrize("rows", [19, 20, 64, 100000])
def test_frames_at_block_edges(panel, rows):
    def frames(df, s):
        return df.withColumn("m", rolling_mean("adj_close", 20, s))

    whole = collect(frames(panel, S), ("asset", "d"))
    parts = collect(in_blocks(number_rows(panel, S), S, 19, frames, rows), ("asset", "d"))
    assert [(r["asset"], r["d"]) for r in whole] == [(r["asset"], r["d"]) for r in parts]
    for a, b in zip(whole, parts):
        assert (a["m"] is None) == (b["m"] is None)
        assert a["m"] is None or b["m"] == pytest.approx(a["m"], rel=1e-12)


def test_block_must_cover_the_reach(panel):
    with pytest.raises(ValueError, match="cannot lend"):
        in_blocks(number_rows(panel, S), S, 20, lambda df, s: df, 19)


@pytest.mark.parametrize("build", [
    lambda df, rows: equity_features(df, block_rows=rows),
    lambda df, rows: crypto_features(df, "monthly", block_rows=rows),
    lambda df, rows: crypto_features(df, "weekly", block_rows=rows)])
def test_bundles(panel, build):
    whole, parts = (collect(build(panel, rows), ("asset", "d")) for rows in (None, 280))
    assert len(whole) == len(parts) and whole[0].keys() == parts[0].keys()
    for a, b in zip(whole, parts):
        for c in a:
            if isinstance(a[c], float) and isinstance(b[c], float):
                assert b[c] == pytest.approx(a[c], rel=1e-9, abs=1e-9), c
            else:
                assert a[c] == b[c], c


def test_window_groups_stay_small(spark, sf_dir):
    """One asset holding most bars is spread over many groups, none longer than a block and its overlap."""
    bars = brand_bars(spark, sf_dir).withColumn("asset", F.lit("one"))
    bars = settle(bars.groupBy("asset", "d").agg(*[F.max(c).alias(c) for c in bars.columns[2:]]))
    sizes = []

    def frames(df, s):
        sizes.append([r["count"] for r in df.groupBy(*s.keys).count().collect()])
        return df

    in_blocks(number_rows(bars, S), S, 200, frames, 256).count()
    assert len(sizes[0]) > 5 and max(sizes[0]) <= 456
