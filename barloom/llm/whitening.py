"""Whitening of embeddings along the components of their covariance, found by spectral divide and conquer.

The covariance of all distinct vectors is one small matrix, whatever their number. Polar decompositions by
dynamically weighted Halley steps (QDWH) split its space in two again and again until single directions are left;
these are broadcast, and one pass over the rows projects them.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import settle

#: Grid that an entry is rounded down to.
GRID = 256
LONG = 2**63 - 1
EPS = np.finfo(np.float64).eps


# --- polar decompositions and the components of a symmetric matrix ----------------------------------------

def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, which is the sign of its eigenvalues.

    Halley steps with weights that follow a lower bound of the singular values; by QR, so that no inverse is formed.
    A bound that is too low costs a step or two and never exactness.
    """
    d, scale = len(a), np.linalg.norm(a)
    if scale == 0:
        return np.eye(d)
    x, low = a / scale, 1e-16
    for _ in range(40):
        root = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + root) + 0.5 * np.sqrt(8 - 4 * root + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(d)]))[0]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:d] @ q[d:].T
        new = (new + new.T) / 2
        low = min(low * (wa + wb * low**2) / (1 + wc * low**2), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if moved <= np.cbrt(EPS) and abs(1 - low) <= 10 * EPS:
            break
    return 1.5 * x - 0.5 * x @ x @ x  # one Newton-Schulz step for the last bits


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthonormal basis whose first k columns span the eigenvalues above a shift, the others the rest.

    Shifts are tried until the projector splits the space cleanly: the median of the diagonal, the mean of the
    eigenvalues (which always lies between two of them), and points beside it. None if all of them lie as one.
    """
    d, diagonal = len(a), np.sort(np.diag(a))
    mean, wide = diagonal.mean(), np.linalg.norm(a - np.trace(a) / d * np.eye(d)) / np.sqrt(d)
    shifts = [np.median(diagonal), mean, *[mean + s * wide for s in (0.25, -0.25, 0.5, -0.5, 0.9, -0.9, 0.1, -0.1)]]
    best = None
    for shift in shifts:
        projector = (polar(a - shift * np.eye(d)) + np.eye(d)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < d:
            continue
        start = np.random.default_rng(d).standard_normal((d, d))
        start[:, :k] = projector @ start[:, :k]
        q = np.linalg.qr(start)[0]
        q[:, :k] = projector @ q[:, :k]  # a second pass, as one may lose digits to a poor start
        q = np.linalg.qr(q)[0]
        loss = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or loss < best[0]:
            best = loss, q, k
        if loss <= 10 * d * EPS * np.linalg.norm(a):
            break
    return best and best[1:]


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and the unit eigenvectors as columns, of a symmetric matrix, by divide and conquer."""
    a = (a + a.T) / 2
    whole, basis, left = np.linalg.norm(a), np.eye(len(a)), [(0, len(a))]
    while left:
        lo, hi = left.pop()
        own = basis[:, lo:hi]
        block = own.T @ a @ own
        block = (block + block.T) / 2
        even = np.linalg.norm(block - np.trace(block) / (hi - lo) * np.eye(hi - lo))
        if hi - lo == 1 or even <= 4 * EPS * whole:
            continue
        found = _split(block)
        if found is not None:
            q, k = found
            basis[:, lo:hi] = own @ q
            left += [(lo, lo + k), (lo + k, hi)]
    basis = np.linalg.qr(basis)[0]
    values = np.einsum("ij,ij->j", basis, a @ basis)
    order = np.argsort(-values, kind="stable")
    return values[order], basis[:, order]


# --- vectors on the grid ----------------------------------------------------------------------------------

def packed(x: np.ndarray) -> bytes:
    """A vector of longs in the narrowest integers that hold it, so that equal vectors have equal bytes."""
    for kind in (np.int8, np.int16, np.int32):
        info = np.iinfo(kind)
        if x.min() >= info.min and x.max() <= info.max:
            return bytes([info.bits]) + x.astype(kind).tobytes()
    return b"\x40" + x.tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.dtype(f"i{r[0] // 8}"), offset=1).astype(np.int64) for r in rows])


def on_grid(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, d, x) of the rows whose vector is not null or empty and has no null or non-finite entry.

    An entry beyond the longs is set to the nearest long.
    """
    rows = table.select(table[key].alias("vec_id"), table[vector].cast("array<double>").alias("v"))
    fit = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))

    def pack(batches):
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                x = np.floor(np.array(v) * GRID)
                out.append(packed(np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64)
                                  + np.where(x >= 2.0**63, LONG, 0) + np.where(x <= -(2.0**63), -LONG - 1, 0)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([len(v) for v in batch.column("v")], pa.int32()),
                                              pa.array(out, pa.binary())], names=["vec_id", "d", "x"])

    return rows.where(F.coalesce(fit, F.lit(False))).mapInArrow(pack, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, d int, x binary")


@dataclass(frozen=True)
class Whitener:
    """What a pass over the rows needs: at most d**2 numbers."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > len(self.sums) * EPS * max(self.trace, 0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x * float(self.n) - np.array(self.sums, np.float64)) / self.n if self._exact(x) else \
            np.array([[float(Decimal(int(a)) - Decimal(s) / self.n) for a, s in zip(row, self.sums, strict=True)] for row in x])

    def _exact(self, x: np.ndarray) -> bool:
        return float(np.abs(x.astype(np.float64)).max(initial=0)) * self.n < 2.0**53 and max(map(abs, self.sums)) < 2**53

    def projected(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.usable, np.sqrt(np.where(self.usable, self.values, 1)), np.nan)
        return self.centred(x) @ self.vectors / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)**2, exact; null where it is no long."""
        largest = float(np.abs(x.astype(np.float64)).max(initial=0)) * self.n + max(map(abs, self.sums))
        if largest**2 * len(self.sums) < 2.0**62:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(a) - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v <= LONG else None for v in exact]


def _matrix(rows: DataFrame, work, size: int) -> np.ndarray:
    """Sum of ``work(x)`` (size x size) over all vectors, added up in the tasks and then by Spark."""

    def partial(batches):
        total = np.zeros((size, size))
        for batch in batches:
            total += work(unpacked(batch.column("x").to_pylist())) if batch.num_rows else 0
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                         names=["i", "j", "s"])

    out = np.zeros((size, size))
    for r in rows.select("x").mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def partial(batches):
        n, total = 0, [0] * d
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch.column("x").to_pylist())
                safe = float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0**62
                total = [t + int(s) for t, s in zip(total, x.sum(0) if safe else x.astype(object).sum(0), strict=True)]
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([*map(Decimal, total), Decimal(n)],
                                                                                    pa.decimal128(38, 0))], names=["i", "s"])

    found = rows.select("x").mapInArrow(partial, "i int, s decimal(38,0)").groupBy("i").agg(
        F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    by = {r.i: int(r.s) for r in found}
    return by.get(d, 0), [by.get(i, 0) for i in range(d)]


def fit(vectors: DataFrame, d: int, most: int = 4) -> tuple[Whitener, float | None]:
    """The first ``most`` components of the distinct vectors (x), and how far whitened ones are from uncorrelated."""
    n, sums = _sums(vectors, d)
    blank = Whitener(n, tuple(sums), np.zeros(1), np.zeros((d, 1)), 0.0)
    if n == 0:
        return blank, None

    def second(x):
        c = blank.centred(x)
        return c.T @ c

    v = _matrix(vectors, second, d) / n
    values, basis = components(v)
    found = Whitener(n, tuple(sums), values[:most], basis[:, :most], float(np.trace(v)))
    k = int(found.usable.sum())
    if k == 0:
        return found, None

    def moments(x):
        y = np.concatenate([found.projected(x)[:, :k], np.ones((len(x), 1))], axis=1)
        return y.T @ y

    m = _matrix(vectors, moments, k + 1) / n  # the last row has the means, zero but for rounding
    return found, float(np.abs(m[:k, :k] - np.outer(m[k, :k], m[k, :k]) - np.eye(k)).max())


def whitened(table: DataFrame, most: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are vectors of another
    length than most have (of lengths as frequent as each other, the shortest). Repeated rows are each in the result,
    but equal vectors count once in the fit. Fewer than ``most`` dimensions give as many components. A component
    whose eigenvalue is no more than rounding (one distinct vector only, say) has no whitened value; explained and
    identity_error are null where nothing varies at all. An entry beyond the longs is set to the nearest one, and a
    deviation beyond the longs is null. An empty table gives an empty result; other columns are left out.
    """
    rows = settle(on_grid(table, key, vector))
    lengths = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = lengths[0].d if lengths else 1
    rows = rows.where(F.col("d") == d)
    model, error = fit(settle(rows.select("x").distinct()), d, most)
    return _applied(rows, model, error)


def _applied(rows: DataFrame, model: Whitener, error: float | None) -> DataFrame:
    spark: SparkSession = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    k = len(model.values)
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.values]

    def project(batches):
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = unpacked(batch.column("x").to_pylist()), batch.column("vec_id")
            size, y = len(x), m.projected(x)
            at = pa.array(np.repeat(np.arange(size), k))
            values = y.ravel()
            yield pa.RecordBatch.from_arrays([
                ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, m.n), pa.int64()), pa.array(m.deviation(x), pa.int64()).take(at),
                pa.array(values, mask=np.isnan(values)), pa.array(explained * size, pa.float64()),
                pa.array([error] * (size * k), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(
        project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
