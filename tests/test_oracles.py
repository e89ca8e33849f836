"""Every registered query that has SQL, against it, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from barloom.plans.catalog import ORACLES, QUERIES
from tools.compare import TABLES, canonical


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = db.execute(ORACLES[name])
    want = canonical([c[0] for c in res.description], res.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) > 0
    assert got[1] == want[1]


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)
