"""All windows of a walk-forward run trained at once: each step is one Spark job over all of them.

Rows become blocks of arrays of bounded size. A job adds up what every window needs (histograms of gradients,
gradients with their second derivatives, counts) block by block, the sums of a window meet by a shuffle when there is
more than one block, and only decisions come to the driver: splits, coefficients, ranks. Their number follows the
calendar and the schema, never the rows. RDDs are used here because a block carries arrays from step to step.

A lost block is made again from the stored rows and the decisions so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block and windows that a block serves at most; together they bound a task's memory.
BLOCK_ROWS, FOLDS = 16_384, 64
#: Values that a feature is cut into for split search; up to so many rows every value is its own bin.
BINS = 256
#: Boosting rounds after which the blocks keep their scores.
KEEP_EVERY = 8
EPOCH = date(1970, 1, 1)


@dataclass(frozen=True)
class Window:
    """A training window by day numbers, both inclusive, its classes and rows per class."""

    fold: int
    first: int
    last: int
    classes: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def rows(self) -> int:
        return sum(self.counts)


def day_number(d: date) -> int:
    return (d - EPOCH).days


class Panel:
    """The rows of a labelled panel as an RDD of (windows, arrays), each block once for every group of windows.

    Arrays of a block: ``x`` (rows by features), ``y``, ``day`` (rising) and ``row`` (a hash of the row's keys).
    """

    def __init__(self, data: DataFrame, features: Sequence[str], label: str | None, windows: Sequence[Window],
                 rows: int, keys: Sequence[str], period: str):
        self.features, self.windows, self.data, self.period = list(features), list(windows), data, period
        self.blocks = max(1, ceil(rows / BLOCK_ROWS))
        spread = ceil(data.sparkSession.sparkContext.defaultParallelism / self.blocks)
        groups = max(min(len(self.windows), spread), ceil(len(self.windows) / FOLDS), 1)
        chosen = [self.windows[g::groups] for g in range(groups)]
        packed = _packed(data, self.features, label, keys, period, self.blocks)

        def deal(part: int, found: Iterator) -> Iterator:
            for r in found:
                block = _unpacked(r, len(features))
                for g, own in enumerate(chosen):
                    yield part * groups + g, (own, block)

        dealt = packed.rdd.mapPartitionsWithIndex(deal).partitionBy(self.blocks * groups, lambda at: at)
        self.rdd = dealt.values().persist(StorageLevel.MEMORY_AND_DISK)

    def reduced(self, rdd: RDD, work: Callable, finish: Callable) -> dict:
        """``finish(fold, sum over blocks of work)`` of every window. ``work`` yields (fold, array) for an element."""

        def partial(found: Iterator) -> Iterator:
            held: dict[int, np.ndarray] = {}
            for element in found:
                for fold, a in work(element):
                    held[fold] = held[fold] + a if fold in held else a
            return iter(held.items())

        sums = rdd.mapPartitions(partial)
        if self.blocks > 1:
            sums = sums.reduceByKey(np.add, min(rdd.getNumPartitions(), len(self.windows)))
        return dict(sums.map(lambda kv: (kv[0], finish(*kv))).collect())


def scored(rows: DataFrame, features: Sequence[str], kept: Sequence[str], period: str, tests: Sequence[tuple[int, int, int]],
           score: Callable, schema: str) -> DataFrame:
    """``kept`` columns, fold and the columns of ``score(fold, x)`` for the rows of every tested span (fold, first day,
    last day). One pass, no shuffle; features come last as an array of doubles, the rest passes through."""
    wide = len(features)
    read = rows.select(*kept, _day(period).alias("_day"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    names = [*kept, "fold", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches):
        for batch in batches:
            x, day = _matrix(batch.column("_x"), wide), batch.column("_day").to_numpy()
            for fold, first, last in tests:
                at = np.flatnonzero((day >= first) & (day <= last))
                if len(at):
                    part = batch.take(pa.array(at))
                    columns = [part.column(c) for c in kept] + [pa.array(np.full(len(at), fold, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns + list(score(fold, x[at])), names=names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return read.mapInArrow(run, f"{types}, fold int, {schema}")


def _day(period: str):
    return F.datediff(F.col(period), F.lit(EPOCH))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _packed(data: DataFrame, features, label, keys, period, blocks: int) -> DataFrame:
    """Rows in blocks of arrays as bytes, sorted by day."""
    y = F.col(label).cast("int") if label else F.lit(0)
    rows = data.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), y.alias("y"),
                       _day(period).alias("day"), F.xxhash64(*keys, period).alias("row"))
    rows = rows.coalesce(1) if blocks == 1 else rows.repartition(blocks)

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(at, BLOCK_ROWS))
                size += held[-1].num_rows
                if size >= BLOCK_ROWS:
                    yield _block(held, len(features))
                    held, size = [], 0
        if size:
            yield _block(held, len(features))

    return rows.mapInArrow(pack, "x binary, y binary, day binary, row binary")


def _block(held: list[pa.RecordBatch], width: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    day, row = (t.column(c).to_numpy() for c in ("day", "row"))
    order = np.lexsort((row, day))
    x = np.concatenate([_matrix(c, width) for c in t.column("x").chunks])[order]
    y = t.column("y").to_numpy().astype(np.int16)[order]
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (
        x, y, day[order].astype(np.int32), row[order].astype(np.int64))], names=["x", "y", "day", "row"])


def _unpacked(r, width: int) -> dict:
    return {"x": np.frombuffer(r.x, np.float64).reshape(-1, width), "y": np.frombuffer(r.y, np.int16),
            "day": np.frombuffer(r.day, np.int32), "row": np.frombuffer(r.row, np.int64)}


def _span(block: Mapping, w: Window) -> slice:
    """Rows of a block that a window trains on."""
    return slice(int(np.searchsorted(block["day"], w.first, "left")), int(np.searchsorted(block["day"], w.last, "right")))


# --- exact quartiles ---------------------------------------------------------------------------------------

def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order."""
    b = (x + 0.0).view(np.uint64)
    return np.where(b >> np.uint64(63) == 1, ~b, b | np.uint64(1 << 63))


def _from_bits(b: np.ndarray) -> np.ndarray:
    return np.where(b >> np.uint64(63) == 1, b ^ np.uint64(1 << 63), ~b).view(np.float64)


def quantiles(panel: Panel, points: Sequence[float] = (0.25, 0.5, 0.75)) -> dict[int, np.ndarray]:
    """Exact quantiles (points by features) of every window's rows, linear between neighbouring values.

    Selection by digits: eight jobs, each of which counts, for every wanted rank, how many rows share the digits
    found so far and which digit comes next. Rows are neither sorted nor collected.
    """
    features = len(panel.features)
    ranks = {w.fold: np.array([[int(np.floor(p * (w.rows - 1))) + k for p in points for k in (0, 1)]] * features).clip(max=w.rows - 1)
             for w in panel.windows if w.rows}
    prefix = {f: np.zeros(r.shape, np.uint64) for f, r in ranks.items()}
    below = {f: np.zeros(r.shape, np.int64) for f, r in ranks.items()}
    for shift in range(56, -1, -8):
        known = panel.data.sparkSession.sparkContext.broadcast(prefix)

        def count(element, known=known, shift=shift):
            windows, block = element
            bits = _ordered_bits(block["x"])
            for w in windows:
                if w.fold not in known.value:
                    continue
                rows, want = bits[_span(block, w)], known.value[w.fold]
                out = np.zeros((*want.shape, 256), np.int64)
                high, digit = rows >> np.uint64(shift) >> np.uint64(8), (rows >> np.uint64(shift)) & np.uint64(255)
                for j in range(features):
                    for k, p in enumerate(want[j]):
                        out[j, k] = np.bincount(digit[high[:, j] == p, j].astype(np.int64), minlength=256)
                yield w.fold, out

        counts = panel.reduced(panel.rdd, count, lambda fold, a: a)
        for f, c in counts.items():
            up_to = np.cumsum(c, axis=2) + below[f][:, :, None]
            digit = (up_to <= ranks[f][:, :, None]).sum(2)
            before = np.take_along_axis(up_to - c, digit[:, :, None], 2)[:, :, 0]
            prefix[f], below[f] = prefix[f] << np.uint64(8) | digit.astype(np.uint64), before
    out = {}
    for w in panel.windows:
        if w.rows:
            v = _from_bits(prefix[w.fold]).reshape(features, len(points), 2)
            share = np.array([p * (w.rows - 1) - np.floor(p * (w.rows - 1)) for p in points])
            out[w.fold] = (v[:, :, 0] + (v[:, :, 1] - v[:, :, 0]) * share).T
    return out


# --- logistic regression by Newton steps -----------------------------------------------------------------

def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _loss_terms(x, y, weights, coef):
    """Loss, gradient and second derivatives (flattened) of the weighted log loss of ``coef`` (classes by 1 + features).

    Two classes have one row of coefficients, as the other's are zero.
    """
    rows = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    k = len(coef)
    z = rows @ coef.T
    p = softmax(np.concatenate([np.zeros((len(z), 1)), z], axis=1) if k == 1 else z)
    w = weights[y]
    loss = -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
    own = p[:, 1:] if k == 1 else p
    hit = (y == 1)[:, None] if k == 1 else y[:, None] == np.arange(k)
    grad = ((own - hit) * w[:, None]).T @ rows
    hess = np.empty((k, rows.shape[1], k, rows.shape[1]))
    for a in range(k):
        for b in range(k):
            s = w * own[:, a] * ((a == b) - own[:, b])
            hess[a, :, b, :] = (rows * s[:, None]).T @ rows
    return np.concatenate([[loss], grad.ravel(), hess.ravel()])


@dataclass(frozen=True)
class Linear:
    """Fitted coefficients of a window (rows: classes, or one for two classes; columns: intercept, features) on scaled
    features."""

    classes: tuple[int, ...]
    centre: np.ndarray
    scale: np.ndarray
    coef: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.coef[:, 0] + ((x - self.centre) / self.scale) @ self.coef[:, 1:].T
        return softmax(np.concatenate([np.zeros((len(z), 1)), z], axis=1) if len(self.coef) == 1 else z)


def fit_logistic(panel: Panel, c: float, scales: Mapping[int, tuple[np.ndarray, np.ndarray]], steps: int = 100) -> dict[int, Linear]:
    """L2 logistic regression of every window: half the squared coefficients (not the intercepts) plus ``c`` times
    the log loss, with balanced class weights; softmax over three classes and more.

    Newton steps from zero, halved where the loss of a window did not fall, until no window's gradient counts.
    """
    width, windows = len(panel.features), [w for w in panel.windows if len(w.classes) > 1]
    weights = {w.fold: np.array([w.rows / (len(w.classes) * n) for n in w.counts]) for w in windows}
    shape = {w.fold: (1 if len(w.classes) == 2 else len(w.classes), width + 1) for w in windows}
    coef = {w.fold: np.zeros(shape[w.fold]) for w in windows}
    best: dict[int, tuple] = {}
    step: dict[int, tuple[np.ndarray, float]] = {}
    size, active = {w.fold: w.rows for w in windows}, {w.fold for w in windows}
    for _ in range(steps):
        if not active:
            break
        at = panel.data.sparkSession.sparkContext.broadcast({f: coef[f] for f in active})

        def work(element, at=at):
            own, block = element
            for w in own:
                if w.fold in at.value:
                    rows = _span(block, w)
                    centre, scale = scales[w.fold]
                    y = np.searchsorted(np.array(w.classes), block["y"][rows])
                    yield w.fold, _loss_terms((block["x"][rows] - centre) / scale, y, weights[w.fold], at.value[w.fold])

        for f, found in panel.reduced(panel.rdd, work, lambda fold, a: a).items():
            k = coef[f].size
            free = coef[f].copy()
            free[:, 0] = 0
            loss = c * found[0] + (free**2).sum() / 2
            if f in best and not loss <= best[f][0] + 1e-12 * abs(best[f][0]):
                direction, length = step[f]
                length /= 2
            else:
                grad = c * found[1:1 + k] + free.ravel()
                best[f] = loss, coef[f]
                if np.abs(grad).max() <= 1e-9 * size[f]:
                    active.discard(f)
                    continue
                ridge = np.ones(shape[f])
                ridge[:, 0] = 0
                hess = c * found[1 + k:].reshape(k, k) + np.diag(ridge.ravel())
                direction, length = np.linalg.lstsq(hess, -grad, rcond=1e-12)[0].reshape(shape[f]), 1.0
            if length < 1e-8:
                active.discard(f)
                continue
            step[f] = direction, length
            coef[f] = best[f][1] + length * direction
    return {w.fold: Linear(w.classes, *scales[w.fold], best[w.fold][1]) for w in windows}


# --- boosted trees -------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Bins:
    """Cut points of every feature: bin i holds values up to ``high[i]``; ``low[i]`` is the smallest value in it."""

    high: list[np.ndarray]
    low: list[np.ndarray]

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.minimum(np.searchsorted(h, x[:, j], "left"), len(h) - 1) for j, h in enumerate(self.high)], 1)


def cut_points(panel: Panel) -> Bins:
    """Up to ``BINS`` values a feature at even ranks, and the smallest value of each bin."""
    at = F.array(*[F.lit(i / BINS) for i in range(BINS + 1)])
    r = panel.data.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 20_000).alias(f"_{i}")
                         for i, c in enumerate(panel.features)]).first()
    high = [np.unique(np.array(v, np.float64)) for v in r]
    bins = Bins(high, high)

    def lowest(element):
        _, block = element
        found, out = bins.of(block["x"]), np.full((len(high), BINS + 1), np.inf)
        for j in range(len(high)):
            np.minimum.at(out[j], found[:, j], block["x"][:, j])
        return out

    low = panel.rdd.map(lowest).treeReduce(np.minimum)
    return Bins(high, [np.where(np.isfinite(low[j, :len(h)]), low[j, :len(h)], h) for j, h in enumerate(high)])


@dataclass(frozen=True)
class Tree:
    """Trees of one round and window, one per output (row). Node i has children 2i + 1 and 2i + 2; feature -1: a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def nodes(self, x: np.ndarray, output: int) -> np.ndarray:
        feature, threshold = self.feature[output], self.threshold[output]
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        depth = (len(feature) + 1).bit_length() - 1
        for _ in range(depth):
            inner = np.minimum(at, len(feature) - 1)
            f = np.where(at < len(feature), feature[inner], -1)
            at = np.where(f >= 0, 2 * at + 1 + (x[rows, f] > threshold[inner]), at)
        return at

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.value[o][self.nodes(x, o)] for o in range(len(self.value))], 1)


@dataclass(frozen=True)
class Boosted:
    """Boosted trees of a window: starting scores, and the trees of all rounds stacked (rounds first)."""

    classes: tuple[int, ...]
    start: np.ndarray
    rate: float
    trees: Tree

    def chosen(self, x: np.ndarray) -> np.ndarray:
        z = np.tile(self.start, (len(x), 1))
        for r in range(len(self.trees.value)):
            z += self.rate * Tree(self.trees.feature[r], self.trees.threshold[r], self.trees.value[r]).scores(x)
        at = (z[:, 0] > 0).astype(int) if len(self.start) == 1 else z.argmax(1)
        return np.array(self.classes)[at]


def _residuals(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradients of the log loss, and p(1 - p); y are positions in the window's classes."""
    if z.shape[1] == 1:
        p = 1 / (1 + np.exp(-z))
        return (y == 1)[:, None] - p, p * (1 - p)
    p = softmax(z)
    return (y[:, None] == np.arange(z.shape[1])) - p, p * (1 - p)


def in_bag(row: np.ndarray, round_: int, share: float, seed: int) -> np.ndarray:
    """Whether rows are drawn in a round: by a hash of the row's keys, the round and the seed."""
    if share >= 1:
        return np.ones(len(row), bool)
    h = row.view(np.uint64) ^ np.uint64((round_ * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(by)
    return (h ^ h >> np.uint64(31)).astype(np.float64) < share * 2.0**64


def level_sums(x_bins: np.ndarray, nodes: np.ndarray, r: np.ndarray, h: np.ndarray, level: int) -> np.ndarray:
    """Rows, gradients and second derivatives by (output, node of the level, feature, bin)."""
    outputs, first, width, features = r.shape[1], (1 << level) - 1, 1 << level, x_bins.shape[1]
    size = BINS + 1
    out, offset = np.zeros((3, outputs, width, features, size)), np.arange(features) * size
    for o in range(outputs):
        at = np.flatnonzero(nodes[:, o] >= first)
        index = ((nodes[at, o] - first)[:, None] * (features * size) + offset + x_bins[at]).ravel()
        for c, weight in enumerate((None, r[at, o], h[at, o])):
            spread = None if weight is None else np.repeat(weight, features)
            out[c, o] = np.bincount(index, spread, width * features * size).reshape(width, features, size)
    return out


def best_splits(sums: np.ndarray, bins: Bins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every (output, node): feature (-1: no split), threshold, and the sums (all, left, right by rows, gradient,
    second derivative). The gain is rows left times rows right times the squared difference of the mean gradients;
    ties go to the first feature and the lowest value."""
    _, outputs, width, features, size = sums.shape
    left = np.cumsum(sums, axis=4)
    total = left[:, :, :, :1, -1:]
    n, g = left[0], left[1]
    right_n, right_g = total[0] - n, total[1] - g
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((n > 0) & (right_n > 0), n * right_n * (g / n - right_g / right_n) ** 2, -1.0)
    flat = gain.reshape(outputs, width, -1)
    top = flat.max(2)
    # gains that differ by rounding alone are ties
    at = (flat >= top[:, :, None] * (1 - 1e-12)).argmax(2)
    feature, cut = np.divmod(at, size)
    whole = total[:, :, :, 0, 0]
    splits = top > 1e-14 * np.maximum(whole[0], 1) ** 2
    threshold, parts = np.zeros((outputs, width)), np.zeros((3, 3, outputs, width))
    parts[0] = whole
    for o, k in zip(*np.nonzero(splits), strict=True):
        j, i = feature[o, k], cut[o, k]
        following = i + 1 + int(np.argmax(sums[0, o, k, j, i + 1:] > 0))
        high, low = bins.high[j][i], bins.low[j][following]
        threshold[o, k] = max(high, min((high + low) / 2, np.nextafter(low, -np.inf)))
        parts[1, :, o, k] = left[:, o, k, j, i]
        parts[2, :, o, k] = parts[0, :, o, k] - parts[1, :, o, k]
    return np.where(splits, feature, -1), threshold, parts


def _leaf(parts: np.ndarray, classes: int) -> np.ndarray:
    """Leaf values by one Newton step from (rows, gradient, second derivative)."""
    factor = 1.0 if classes == 2 else (classes - 1) / classes
    return np.where(np.abs(parts[2]) > 1e-150, factor * parts[1] / np.where(parts[2] == 0, 1, parts[2]), 0.0)


class _Grown:
    """A round's trees of one window while its levels are found."""

    def __init__(self, w: Window, outputs: int, depth: int):
        self.classes, inner = len(w.classes), (1 << depth) - 1
        self.tree = Tree(np.full((outputs, inner), -1), np.zeros((outputs, inner)), np.zeros((outputs, 2 * inner + 1)))

    def add(self, level: int, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        first, (feature, threshold, parts) = (1 << level) - 1, found
        here = slice(first, 2 * first + 1)
        self.tree.feature[:, here], self.tree.threshold[:, here] = feature, threshold
        self.tree.value[:, here] = _leaf(parts[0], self.classes)
        below = self.tree.value[:, 2 * first + 1:4 * first + 3]
        below[:, ::2], below[:, 1::2] = _leaf(parts[1], self.classes), _leaf(parts[2], self.classes)


def fit_boosting(panel: Panel, rounds: int, rate: float, depth: int, subsample: float = 1.0, seed: int = 42) -> dict[int, Boosted]:
    """Gradient boosting of every window: from the log of the class shares, each round a regression tree per class on
    the gradients of the soft-max loss (one tree for two classes), leaves by a Newton step.

    One job for each round and level, over all windows, classes, nodes, features and bins. Blocks keep the scores of
    every eighth round and add the trees since then themselves, so a job ships few trees and nothing is written.
    """
    context = panel.data.sparkSession.sparkContext
    windows = {w.fold: w for w in panel.windows if len(w.classes) > 1}
    outputs = {f: 1 if len(w.classes) == 2 else len(w.classes) for f, w in windows.items()}
    share = {f: np.array(w.counts) / w.rows for f, w in windows.items()}
    start = {f: np.array([np.log(p[1] / p[0])]) if outputs[f] == 1 else np.log(p) for f, p in share.items()}
    bins = context.broadcast(cut_points(panel))

    def begin(element):
        own, block = element
        own = [w for w in own if w.fold in windows]
        own_y = {w.fold: np.searchsorted(np.array(w.classes), block["y"][_span(block, w)]) for w in own}
        scores = {w.fold: np.tile(start[w.fold], (len(own_y[w.fold]), 1)) for w in own}
        return own, {**block, "bins": bins.value.of(block["x"]), "own_y": own_y}, scores

    def moved(element, since):
        own, block, scores = element
        out = {w.fold: scores[w.fold] + rate * sum(t.scores(block["x"][_span(block, w)]) for t in since[w.fold])
               if since[w.fold] else scores[w.fold] for w in own}
        return own, block, out

    kept = panel.rdd.map(begin).persist(StorageLevel.MEMORY_AND_DISK)
    grown: dict[int, list[Tree]] = {f: [] for f in windows}
    since: dict[int, list[Tree]] = {f: [] for f in windows}
    for round_ in range(rounds):
        if round_ and round_ % KEEP_EVERY == 0:
            trees = context.broadcast(since)
            older, kept = kept, kept.map(lambda e, trees=trees: moved(e, trees.value)).persist(StorageLevel.MEMORY_AND_DISK)
            since = {f: [] for f in windows}
        else:
            older = None
        new = {f: _Grown(w, outputs[f], depth) for f, w in windows.items()}
        for level in range(depth):
            shipped = context.broadcast((since, {f: g.tree for f, g in new.items()}))

            def work(element, shipped=shipped, level=level, round_=round_):
                trees, partly = shipped.value
                own, block, scores = moved(element, trees)
                drawn = in_bag(block["row"], round_, subsample, seed)
                for w in own:
                    rows = _span(block, w)
                    at = np.flatnonzero(drawn[rows])
                    r, h = _residuals(scores[w.fold][at], block["own_y"][w.fold][at])
                    x, tree = block["x"][rows][at], partly[w.fold]
                    nodes = np.stack([tree.nodes(x, o) for o in range(r.shape[1])], 1)
                    yield w.fold, level_sums(block["bins"][rows][at], nodes, r, h, level)

            for f, found in panel.reduced(kept, work, lambda fold, sums: best_splits(sums, bins.value)).items():
                new[f].add(level, found)
            shipped.unpersist()
        if older is not None:
            older.unpersist()
        for f in windows:
            grown[f].append(new[f].tree)
            since[f].append(new[f].tree)
    kept.unpersist()
    stacked = lambda trees: Tree(*[np.stack([getattr(t, c) for t in trees]) for c in ("feature", "threshold", "value")])
    return {f: Boosted(w.classes, start[f], rate, stacked(grown[f])) for f, w in windows.items()}
