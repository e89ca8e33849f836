"""Queries that SQL can state, against it."""

from __future__ import annotations

import duckdb
import pytest

import barloom.llm.queries  # noqa: F401
from barloom.llm.catalog import LLM_ORACLES, LLM_QUERIES
from tools.compare import canonical


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = LLM_QUERIES[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = db.execute(LLM_ORACLES[name])
    assert got == canonical([c[0] for c in res.description], res.fetchall())
