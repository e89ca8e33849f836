"""Random forests of all windows grown in one process.

A tree's bag is drawn by a hash of the row's keys, the window and the tree, so a bag is never stored: every task finds
the same one again. Nodes that many rows reach are split by histograms over the blocks, one job for a level of all
windows and trees; nodes that few rows reach are sent to a task with their rows, which grows all that is below. Counts
are whole numbers until a split is chosen, so trees depend neither on the blocks nor on where the two ways meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, e, factorial

import numpy as np
from pyspark.storagelevel import StorageLevel

from barloom.operators.lockstep import BINS, BLOCK_ROWS, Bins, Panel, Window, _span, cut_points

#: Rows of a node up to which what is below is grown in one task.
LOCAL = 16_384
#: Nodes whose histograms one job adds up.
NODES = 512
#: Chance of at most 0, 1, 2, ... draws of a row when as many rows are drawn as there are.
DRAWS = np.cumsum([1 / (e * factorial(i)) for i in range(16)])
MASK = 2**64 - 1
SIZE = BINS + 1


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(by)
    return h ^ h >> np.uint64(31)


def _key(*parts: int) -> int:
    h = 0
    for p in parts:
        h = int(_mixed(np.array([(h + 0x9E3779B97F4A7C15 * (p + 1)) & MASK], np.uint64))[0])
    return h


def bag(row: np.ndarray, fold: int, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    share = _mixed(row.view(np.uint64) ^ np.uint64(_key(seed, fold, tree))).astype(np.float64) / 2.0**64
    return np.searchsorted(DRAWS, share, "right")


def feature_order(key: int, features: int) -> np.ndarray:
    """The order in which a node looks at the features."""
    return np.argsort(_mixed(np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key)), kind="stable")


def looked_at(order: np.ndarray, varied: np.ndarray, tries: int) -> np.ndarray:
    """The first ``tries`` features that have more than one value in the node; where all of them have one, the next."""
    first = order[:tries][varied[order[:tries]]]
    return first if len(first) else order[varied[order]][:1]


@dataclass(frozen=True)
class Rules:
    """Depth (None: no limit), rows of a leaf at least, features that a node looks at."""

    depth: int | None
    leaf: int
    tries: int
    seed: int

    def splits(self, depth: int, rows: int, drawn: np.ndarray) -> bool:
        return (self.depth is None or depth < self.depth) and rows >= 2 * self.leaf and (drawn > 0).sum() > 1


def best_cut(drawn: np.ndarray, rows: np.ndarray, weight: np.ndarray, leaf: int) -> tuple[int, int] | None:
    """(feature, bin) of the largest fall in weighted Gini impurity; ties to the first feature looked at, then the lowest
    bin. ``drawn``: draws by (feature, bin, class), ``rows``: different rows by (feature, bin)."""
    left, n = drawn.cumsum(1), rows.cumsum(1)
    right = left[:, -1:] - left
    a, b = left * weight, right * weight
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (a * a).sum(2) / a.sum(2) + (b * b).sum(2) / b.sum(2)
    score = np.where((n >= leaf) & (n[:, -1:] - n >= leaf), score, -1.0).ravel()
    top = score.max()
    # scores that differ by rounding alone are ties
    return None if top < 0 else divmod(int((score >= top * (1 - 1e-12)).argmax()), rows.shape[1])


def threshold(bins: Bins, feature: int, cut: int, rows: np.ndarray) -> float:
    """Half way to the next value in the node."""
    following = cut + 1 + int(np.argmax(rows[cut + 1:] > 0))
    high, low = bins.high[feature][cut], bins.low[feature][following]
    return max(high, min((high + low) / 2, np.nextafter(low, -np.inf)))


@dataclass
class Nodes:
    """A tree: feature (-1: leaf), threshold, children and shares of the classes of every node. The first is the root."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    share: list[np.ndarray] = field(default_factory=list)

    def add(self, drawn: np.ndarray, weight: np.ndarray) -> int:
        total = float((drawn * weight).sum())
        for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1),
                          (self.share, drawn * weight / total if total else drawn * 0.0)):
            column.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: float, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
        self.feature[node], self.threshold[node] = feature, cut
        self.left[node], self.right[node] = self.add(left, weight), self.add(right, weight)
        return self.left[node], self.right[node]

    def graft(self, node: int, below: Tree) -> None:
        """Put a tree in the place of a leaf."""
        first = len(self.feature) - 1
        moved = lambda child: np.where(child >= 0, child + first, -1).tolist()
        left, right = moved(below.left), moved(below.right)
        self.feature[node], self.threshold[node] = int(below.feature[0]), float(below.threshold[0])
        self.left[node], self.right[node], self.share[node] = left[0], right[0], below.share[0]
        self.feature += below.feature[1:].tolist()
        self.threshold += below.threshold[1:].tolist()
        self.left += left[1:]
        self.right += right[1:]
        self.share += list(below.share[1:])

    def done(self) -> Tree:
        return Tree(np.array(self.feature, np.int32), np.array(self.threshold), np.array(self.left, np.int32),
                    np.array(self.right, np.int32), np.array(self.share))


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[self.feature[at[rows]] >= 0]):
            here = at[rows]
            at[rows] = np.where(x[rows, self.feature[here]] <= self.threshold[here], self.left[here], self.right[here])
        return at


@dataclass(frozen=True)
class Grove:
    """The forest of a window: mean of the trees' class shares, ties to the smaller class."""

    classes: tuple[int, ...]
    trees: list[Tree]

    def shares(self, x: np.ndarray) -> np.ndarray:
        return sum(t.share[t.leaves(x)] for t in self.trees) / len(self.trees)

    def chosen(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.classes)[self.shares(x).argmax(1)]


@dataclass(frozen=True)
class _Open:
    """A node that is to be split: its place, the key of its draws, and what reaches it."""

    fold: int
    tree: int
    node: int
    key: int
    depth: int
    rows: int


def _grown(x_bins: np.ndarray, y: np.ndarray, times: np.ndarray, classes: int, root: tuple[int, int], weight: np.ndarray,
           bins: Bins, rules: Rules) -> Tree:
    """Everything below a node whose rows are all here."""
    def drawn(at):
        return np.bincount(y[at], times[at], classes)

    nodes, everything = Nodes(), np.arange(len(y))
    waiting = [(nodes.add(drawn(everything), weight), everything, *root)]
    while waiting:
        node, at, key, depth = waiting.pop()
        if not rules.splits(depth, len(at), drawn(at)):
            continue
        here = x_bins[at]
        looked = looked_at(feature_order(key, here.shape[1]), here.min(0) != here.max(0), rules.tries)
        if not len(looked):
            continue
        cells, m = np.arange(len(looked)) * SIZE + here[:, looked], len(looked)
        rows = np.bincount(cells.ravel(), minlength=m * SIZE).reshape(m, SIZE)
        counts = np.bincount((cells * classes + y[at][:, None]).ravel(), np.repeat(times[at], m), m * SIZE * classes)
        found = best_cut(counts.reshape(m, SIZE, classes), rows, weight, rules.leaf)
        if found is None:
            continue
        which, cut = found
        goes_left = here[:, looked[which]] <= cut
        parts = at[goes_left], at[~goes_left]
        value = threshold(bins, looked[which], cut, rows[which])
        children = nodes.split(node, int(looked[which]), value, drawn(parts[0]), drawn(parts[1]), weight)
        waiting += [(child, part, _key(key, side), depth + 1) for side, (child, part) in enumerate(zip(children, parts, strict=True))]
    return nodes.done()


def fit_forest(panel: Panel, trees: int, depth: int | None, leaf: int, seed: int = 42) -> dict[int, Grove]:
    """Forests of every window: ``trees`` trees on bags of as many draws as there are rows, each class weighted by its
    share of the bag, the square root of the number of features looked at in a node, at least ``leaf`` different rows
    in a leaf.

    One job counts the bags. Nodes of more than ``LOCAL`` rows are split level by level, ``NODES`` to a job; below, one
    job grows the rest. Trees come to the driver: with a depth they have at most 2^(depth + 1) nodes each; without one,
    as in any such forest, up to rows / leaf leaves. Windows of one class have no forest.
    """
    context = panel.data.sparkSession.sparkContext
    windows = {w.fold: w for w in panel.windows if len(w.classes) > 1}
    features = len(panel.features)
    rules = Rules(depth, leaf, max(1, int(features**0.5)), seed)
    bins = context.broadcast(cut_points(panel))

    def begin(element):
        own, block = element
        block = {**block, "bins": bins.value.of(block["x"]).astype(np.uint16)}
        return [w for w in own if w.fold in windows], block

    kept = panel.rdd.map(begin).persist(StorageLevel.MEMORY_AND_DISK)

    def positions(w: Window, block, rows: slice) -> np.ndarray:
        return np.searchsorted(np.array(w.classes), block["y"][rows])

    def count_bags(element):
        own, block = element
        for w in own:
            rows = _span(block, w)
            y, out = positions(w, block, rows), np.zeros((trees, len(w.classes) + 1), np.int64)
            for t in range(trees):
                times = bag(block["row"][rows], w.fold, t, seed)
                out[t, :-1], out[t, -1] = np.bincount(y, times, len(w.classes)), (times > 0).sum()
            yield w.fold, out

    weight, grown, big, small = {}, {}, [], []

    def opened(fold: int, tree: int, node: int, key: int, depth: int, rows: int, drawn: np.ndarray) -> None:
        if rules.splits(depth, rows, drawn):
            (big if rows > LOCAL else small).append(_Open(fold, tree, node, key, depth, rows))

    for fold, found in panel.reduced(kept, count_bags, lambda fold, a: a).items():
        for t, (*drawn, rows) in enumerate(found):
            drawn = np.array(drawn)
            weight[fold, t] = np.divide(drawn.sum(), (drawn > 0).sum() * drawn, out=np.zeros(len(drawn)), where=drawn > 0)
            grown[fold, t] = Nodes()
            grown[fold, t].add(drawn, weight[fold, t])
            opened(fold, t, 0, _key(seed, fold, t, 0), 0, int(rows), drawn)

    def partly(nodes: list[_Open]) -> dict[tuple[int, int], Tree]:
        return {at: grown[at].done() for at in {(o.fold, o.tree) for o in nodes}}

    while big:
        chunk, big = big[:NODES], big[NODES:]
        by_fold: dict[int, list[_Open]] = {}
        for o in chunk:
            by_fold.setdefault(o.fold, []).append(o)
        shipped = context.broadcast((by_fold, partly(chunk), {(o.fold, o.tree): weight[o.fold, o.tree] for o in chunk}))

        def count(element, shipped=shipped):
            (nodes, known, _), (own, block) = shipped.value, element
            for w in own:
                if w.fold not in nodes:
                    continue
                rows, k = _span(block, w), len(w.classes)
                y, x, x_bins = positions(w, block, rows), block["x"][rows], block["bins"][rows]
                out = np.zeros((len(nodes[w.fold]), features, SIZE, k + 1), np.int64)
                for t in {o.tree for o in nodes[w.fold]}:
                    times = bag(block["row"][rows], w.fold, t, seed)
                    at = np.where(times > 0, known[w.fold, t].leaves(x), -1)
                    for slot, o in enumerate(nodes[w.fold]):
                        if o.tree == t and len(here := np.flatnonzero(at == o.node)):
                            cells = np.arange(features) * SIZE + x_bins[here]
                            index = (cells * (k + 1) + y[here][:, None]).ravel()
                            seen = (cells * (k + 1) + k).ravel()
                            size = features * SIZE * (k + 1)
                            both = np.bincount(index, np.repeat(times[here], features), size) + np.bincount(seen, minlength=size)
                            out[slot] += both.reshape(features, SIZE, k + 1).astype(np.int64)
                yield w.fold, out

        def decide(fold, sums, shipped=shipped):
            nodes, _, weights = shipped.value
            out = []
            for o, s in zip(nodes[fold], sums, strict=True):
                drawn, rows = s[:, :, :-1], s[:, :, -1]
                looked = looked_at(feature_order(o.key, features), (rows > 0).sum(1) > 1, rules.tries)
                found = best_cut(drawn[looked], rows[looked], weights[o.fold, o.tree], rules.leaf) if len(looked) else None
                if found is None:
                    out.append(None)
                    continue
                j, cut = int(looked[found[0]]), found[1]
                parts = [(s[j, :cut + 1].sum(0), 0), (s[j, cut + 1:].sum(0), 1)]
                out.append((j, threshold(bins.value, j, cut, rows[j]), parts))
            return out

        for fold, found in panel.reduced(kept, count, decide).items():
            for o, cut in zip(by_fold[fold], found, strict=True):
                if cut is not None:
                    j, value, parts = cut
                    at = fold, o.tree
                    children = grown[at].split(o.node, j, value, parts[0][0][:-1], parts[1][0][:-1], weight[at])
                    for child, (part, side) in zip(children, parts, strict=True):
                        opened(*at, child, _key(o.key, side), o.depth + 1, int(part[-1]), part[:-1])
        shipped.unpersist()

    roots = {(o.fold, o.tree, o.node): (o.key, o.depth) for o in small}
    shipped = context.broadcast((roots, partly(small), {(o.fold, o.tree): weight[o.fold, o.tree] for o in small}))

    def deal(element) -> Iterator:
        (nodes, known, _), (own, block) = shipped.value, element
        for w in own:
            rows = _span(block, w)
            y, x, x_bins = positions(w, block, rows).astype(np.uint8), block["x"][rows], block["bins"][rows]
            for t in range(trees):
                if (w.fold, t) in known:
                    times = bag(block["row"][rows], w.fold, t, seed)
                    at = np.flatnonzero(times)
                    leaf_of = known[w.fold, t].leaves(x[at])
                    for node in np.unique(leaf_of).tolist():
                        if (w.fold, t, node) in nodes:
                            here = at[leaf_of == node]
                            yield (w.fold, t, node), (x_bins[here], y[here], times[here].astype(np.uint8))

    def below(group):
        at, parts = group
        x_bins, y, times = (np.concatenate(c) for c in zip(*parts, strict=True))
        (nodes, _, weights), w = shipped.value, windows[at[0]]
        return at, _grown(x_bins, y, times, len(w.classes), nodes[at], weights[at[:2]], bins.value, rules)

    if small:
        spread = max(context.defaultParallelism * 4, ceil(sum(o.rows for o in small) / BLOCK_ROWS))
        for (fold, t, node), tree in kept.flatMap(deal).groupByKey(min(len(roots), spread)).map(below).collect():
            grown[fold, t].graft(node, tree)
    kept.unpersist()
    return {f: Grove(w.classes, [grown[f, t].done() for t in range(trees)]) for f, w in windows.items()}
