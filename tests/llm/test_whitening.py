"""Spectral divide and conquer and whitening, against a dense eigensolver and whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from barloom.llm.queries import op13_whitening
from barloom.llm.whitening import components, packed, polar, unpacked, whitened

SCHEMA = "vec_id long, embedding array<float>, d int, x string"


def check(rows, vectors, most=4):
    """``rows`` of the operator against numpy; ``vectors`` are (id, list) of the rows that take part."""
    ids, x = [v[0] for v in vectors], np.floor(256 * np.array([v[1] for v in vectors])).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, basis = np.linalg.eigh(c.T @ c / n)
    k = min(most, x.shape[1])
    e, basis = e[::-1][:k], basis[:, ::-1][:, :k]
    want = (x - s / n) @ basis / np.sqrt(e)
    got = sorted(map(tuple, rows), key=lambda r: (r[0], r[3], r[1], r[4]))
    assert len(got) == len(ids) * k and {r[2] for r in got} == {n}
    deviation = {}
    for i, row in zip(ids, x, strict=True):
        deviation.setdefault(i, set()).add(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)))
    assert all(r[3] in deviation[r[0]] for r in got)
    for j in range(k):
        mine = sorted(abs(r[4]) for r in got if r[1] == j + 1)
        assert mine == pytest.approx(sorted(abs(want[:, j])), abs=1e-9)
        assert {round(r[5], 9) for r in got if r[1] == j + 1} == {round(float(e[j] / np.trace(c.T @ c / n)), 9)}
    assert max(r[6] for r in got) < 1e-9


@pytest.mark.parametrize("d", [1, 2, 7, 60])
def test_components(d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for e in (rng.uniform(0, 5, d), np.round(rng.uniform(0, 2, d)), 10.0 ** -rng.uniform(0, 13, d), np.ones(d), np.zeros(d)):
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        values, vectors = components(a)
        size = max(np.linalg.norm(a), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
        assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-12 * size


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    e = np.concatenate([[1e-9, -1e-12], rng.uniform(-3, 3, 18)])
    assert np.abs(polar((q * e) @ q.T) - (q * np.sign(e)) @ q.T).max() < 1e-2  # of values near 0 only by their condition
    assert np.abs(polar((q * np.sign(e)) @ q.T) - (q * np.sign(e)) @ q.T).max() < 1e-13


def test_packing():
    for x in ([0, -128, 127], [300, -5, 0], [70_000, 1, -1], [2**62, -2**63, 3]):
        x = np.array(x, np.int64)
        assert unpacked([packed(x)])[0].tolist() == x.tolist()


def test_whitening(spark):
    """Nulls, non-finite entries, other lengths and empty vectors are left out; copies count once in the fit."""
    rng = np.random.default_rng(6)
    good = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(40)]
    good += [(100 + i, good[3][1]) for i in range(20)] + [good[0]]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.nan] * 5), (203, [math.inf, 0.0, 0.0, 0.0, 0.0]),
           (204, []), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(*v, 1, "c") for v in good + bad], SCHEMA).repartition(3)
    check(whitened(df).collect(), good)
    check(whitened(df.selectExpr("vec_id", "slice(embedding, 1, 2) AS embedding").where("vec_id < 200")).collect(),
          [(i, v[:2]) for i, v in good])


def test_nothing_varies(spark):
    df = spark.createDataFrame([(1, [.5, -.25], 1, "c"), (None, [.5, -.25], 1, "c")], SCHEMA)
    rows = whitened(df).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows) == [
        (0, 1, 1, 0, None, None, None), (0, 2, 1, 0, None, None, None), (1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)]
    assert whitened(df.limit(0)).collect() == []


def test_very_large_entries(spark):
    df = spark.createDataFrame([(1, [1e17, 0.0]), (2, [-1e17, 4.0]), (3, [3e38, 1.0])], "vec_id long, embedding array<float>")
    rows = whitened(df).collect()
    assert len(rows) == 6 and {r.deviation for r in rows} == {None}
    assert all(r.whitened is None or math.isfinite(r.whitened) for r in rows)


def test_query(spark, sf_dir):
    rows = op13_whitening(spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    fit = lambda v: v is not None and all(c is not None and math.isfinite(c) for c in v)
    check(rows, [(r.vec_id, r.embedding) for r in table if fit(r.embedding)])
