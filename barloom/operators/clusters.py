"""K-means with all starts in one iteration: each step is one aggregation on (start, cluster).

Centres are drawn as k-means++ draws them, a new one with a chance in proportion to the squared distance from those there
are. The draw is a race: every row's time is -ln(u) over that squared distance, u a hash of its values, and the
earliest is taken. So a start's centres depend on the rows alone, not on their order or partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the iteration at most.
STEPS = 300


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by (start, centre)."""
    out = np.zeros((len(x), *centres.shape[:2]))
    for j in range(x.shape[1]):
        out += (x[:, j, None, None] - centres[:, :, j]) ** 2
    return out


def _each(points: DataFrame, width: int, work: Callable, schema: str) -> DataFrame:
    """``work`` (rows, hashes) of every batch, which gives the columns of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in work(x, batch.column("h").to_numpy())], names=names)

    return points.mapInArrow(run, schema)


def _uniform(h: np.ndarray, start: int, step: int) -> np.ndarray:
    """Numbers above 0 and up to 1 from hashes, others for every start and step."""
    v = h.view(np.uint64) ^ np.uint64((start * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ v >> np.uint64(shift)) * np.uint64(by)
    return ((v ^ v >> np.uint64(31)).astype(np.float64) + 1) / (2.0**64 + 1)


def seeded(points: DataFrame, width: int, k: int, starts: int) -> np.ndarray:
    """First centres, starts by k by features: k jobs. Where there are fewer different rows, fewer than k."""
    centres = np.zeros((starts, 0, width))
    for step in range(k):
        def race(x, h, centres=centres, step=step):
            near = _distances(x, centres).min(2) if step else np.ones((len(x), starts))
            found = []
            for s in range(starts):
                with np.errstate(divide="ignore"):
                    time = np.where(near[:, s] > 0, -np.log(_uniform(h, s, step)) / near[:, s], np.inf)
                at = int(time.argmin())
                if np.isfinite(time[at]):
                    found.append((s, time[at], x[at].tolist()))
            return (np.array([f[0] for f in found], np.int32), np.array([f[1] for f in found], np.float64),
                    pa.array([f[2] for f in found], pa.list_(pa.float64())))

        rows = (_each(points, width, race, "start int, time double, x array<double>")
                .groupBy("start").agg(F.min(F.struct("time", "x")).alias("first")).collect())
        if len(rows) < starts:
            break
        new = np.array([r.first.x for r in sorted(rows, key=lambda r: r.start)])
        centres = np.concatenate([centres, new[:, None]], 1)
    return centres


def moved(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the rows nearest to each centre (a centre without rows stays), and every start's sum of squares."""
    starts, k, width = centres.shape

    def sums(x, h):
        d = _distances(x, centres)
        near, out = d.argmin(2), np.zeros((starts * k, width + 2))
        at = (near + np.arange(starts) * k).ravel()
        for j in range(width):
            out[:, j] = np.bincount(at, np.repeat(x[:, j], starts), starts * k)
        out[:, width] = np.bincount(at, d.min(2).ravel(), starts * k)
        out[:, width + 1] = np.bincount(at, minlength=starts * k)
        return np.arange(starts * k, dtype=np.int32), *out.T

    names = [f"s{j}" for j in range(width + 2)]
    found = (_each(points, width, sums, ", ".join(["centre int", *[f"{n} double" for n in names]]))
             .groupBy("centre").agg(*[F.sum(n).alias(n) for n in names]).collect())
    new, cost = centres.reshape(-1, width).copy(), np.zeros(starts)
    for r in found:
        cost[r.centre // k] += r[width + 1]
        if r[width + 2]:
            new[r.centre] = np.array(r[1:width + 1]) / r[width + 2]
    return new.reshape(centres.shape), cost


def cluster_regimes(data: DataFrame, features: Sequence[str], k: int = 3, starts: int = 10) -> DataFrame:
    """``data`` with its regime: k-means on standardised features, the best of several starts, clusters numbered by the
    mean of the first feature so that the numbering does not depend on the start.

    Rows with a missing feature take no part and have no regime; among equal rows all have the same. With fewer
    different rows than ``k`` there are fewer regimes. ``data`` is scanned several times; settle it first.
    """
    values = [F.col(c).cast("double") for c in features]
    whole = F.forall(F.array(*values), lambda v: v.isNotNull() & ~F.isnan(v))
    stats = data.where(whole).agg(*[x for v in values for x in (F.avg(v), F.stddev_pop(v))]).first()
    if stats[0] is None:
        return data.withColumn("regime", F.lit(None).cast("int"))
    scaled = [(v - F.lit(stats[2 * i])) / F.lit(stats[2 * i + 1] or 1.0) for i, v in enumerate(values)]
    x = F.array(*scaled)
    # hashes of the values as they are: means and deviations may differ in the last bits with the order of the rows
    points = data.where(whole).select(x.alias("x"), F.xxhash64(*[v + F.lit(0.0) for v in values]).alias("h")).persist()
    centres = seeded(points, len(features), k, starts)
    for _ in range(STEPS):
        new, cost = moved(points, centres)
        if np.abs(new - centres).max() <= 1e-12:
            break
        centres = new
    points.unpersist()
    best = centres[int(cost.argmin())]
    best = best[np.argsort(best[:, 0], kind="stable")]
    return data.withColumn("regime", F.when(whole, _nearest(scaled, best)))


def _nearest(x: Sequence[Column], centres: np.ndarray) -> Column:
    """Number of the nearest centre, ties to the smaller."""
    far = [sum((v - F.lit(float(c))) * (v - F.lit(float(c))) for v, c in zip(x, row, strict=True)) for row in centres]
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far)]))["i"]
