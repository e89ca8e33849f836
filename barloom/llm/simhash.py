"""SimHash near duplicates: generalised pigeonhole search over groups of correlated bits, with unequal thresholds."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import by_piece, id_text, raw
from barloom.llm.graph import components
from barloom.session import settle

BITS = 64
#: Shingles whose bits are unpacked at a time.
CHUNK = 1 << 14
#: A histogram covers at most so many bits, which bounds what is broadcast: 2**16 counts for each of six at most.
HISTOGRAM_BITS = 16
#: Fingerprints that a probe may be expected to meet; beyond it a fingerprint is searched by its neighbourhood.
MEETS = 4096
#: Work of looking up a value, in fingerprints compared.
LOOKUP = 4


# --- fingerprints ---------------------------------------------------------------------------------------

def fingerprint(text: bytes, width: int = 3) -> int:
    """Bits set in over half of the XXH64 values (seed 42) of all shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - width + 1]
    n, counts, digest = len(starts), np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        a, b = starts[at:at + CHUNK].tolist(), ends[at + width - 1:at + width - 1 + CHUNK].tolist()
        h = np.fromiter([digest(joined[i:j], 42) for i, j in zip(a, b, strict=False)], np.uint64, len(a))
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long of every row of ``docs`` (doc_id, text)."""

    def make():
        return lambda piece: {"doc_id": piece.column("doc_id"),
                              "fp": pa.array([fingerprint(x, width) for x in raw(piece.column("text"))], pa.int64())}

    return by_piece(docs, make, "doc_id long, fp long")


# --- partitions of the bits -----------------------------------------------------------------------------

def parts_for(n: int) -> int:
    """Number of bit groups: as many as leave about 64 of ``n`` even fingerprints to a value, 2 at least."""
    return next((m for m in (4, 3) if n <= 64 << (BITS // m)), 2)


def bit_counts(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often two bits are set together, over all fingerprints: at most 2,080 sums a task leave it."""

    def count(batches):
        both = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), CHUNK):
                bits = _bits(fp[at:at + CHUNK]).astype(np.float32)
                both += bits.T @ bits
            n += len(fp)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_pydict({"i": pa.array([*i, BITS], pa.int32()), "j": pa.array([*j, BITS], pa.int32()),
                                          "n": pa.array([*both[i, j].astype(np.int64), n], pa.int64())})

    out = np.zeros((BITS + 1, BITS + 1))
    for r in fps.select("fp").mapInArrow(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.n
    return out[:BITS, :BITS], int(out[BITS, BITS])


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), bitorder="little").reshape(-1, BITS)


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` groups of bits, correlated ones together, so that the other groups tell fingerprints apart.

    A group starts with the bit that goes most with any other and takes the bit that goes best with those it has.
    """
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    tied = np.abs(cov) / np.where(np.outer(spread, spread) > 0, np.outer(spread, spread), 1)
    np.fill_diagonal(tied, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, groups))) // (m - k)
        group = [max(left, key=lambda b: (tied[b, left].max(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (tied[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a group as one number."""
    out = np.zeros(len(fp), np.int64)
    for at, b in enumerate(bits):
        out |= ((fp >> np.int64(b)) & np.int64(1)) << np.int64(at)
    return out


def _cut(group: list[int]) -> list[list[int]]:
    """Runs of a group's bits that a histogram can hold."""
    k = -(-len(group) // HISTOGRAM_BITS)
    return [x.tolist() for x in np.array_split(np.array(group), k)]


def histograms(fps: DataFrame, groups: list[list[int]]) -> list[list[np.ndarray]]:
    """For each run of each group, how many fingerprints have a value: 2**16 counts at most for a run."""
    runs = [(g, run) for g, group in enumerate(groups) for run in _cut(group)]
    value = lambda bits: reduce(Column.bitwiseOR, [
        F.shiftleft(F.shiftright("fp", b).bitwiseAND(F.lit(1)), at) for at, b in enumerate(bits)])
    seen = fps.select(F.posexplode(F.array(*[value(bits).cast("int") for _, bits in runs])).alias("run", "value"))
    out = [np.zeros(1 << len(bits), np.int64) for _, bits in runs]
    found = seen.groupBy("run", "value").agg(F.count(F.lit(1)).alias("n")).toArrow()
    run, at, n = (found.column(c).to_numpy() for c in ("run", "value", "n"))
    for k, h in enumerate(out):
        h[at[run == k]] = n[run == k]
    return [[h for (g, _), h in zip(runs, out, strict=True) if g == k] for k in range(len(groups))]


def within(counts: np.ndarray, radius: int) -> list[np.ndarray]:
    """For radius 0, 1, ...: how many fingerprints have a value at exactly that distance of each value."""
    index, bits = np.arange(len(counts)), len(counts).bit_length() - 1
    shells = [[counts.astype(np.float64)]] + [[np.zeros(len(counts))] for _ in range(radius)]
    for b in range(bits):  # subsets of the bits seen so far, by size
        old = [s[0] for s in shells]
        for r in range(1, radius + 1):
            shells[r][0] = old[r] + old[r - 1][index ^ (1 << b)]
    return [s[0] for s in shells]


def expected(values: list[np.ndarray], shells: list[list[np.ndarray]], n: int, radius: int) -> np.ndarray:
    """Fingerprints expected within each radius of a group's values: runs of bits taken as independent."""
    at = None
    for v, shell in zip(values, shells, strict=True):
        here = np.stack([s[v] for s in shell])
        if at is None:
            at = here
            continue
        at = np.stack([sum(at[i] * here[r - i] for i in range(r + 1)) / max(n, 1) for r in range(radius + 1)])
    return np.cumsum(at, axis=0)


def allot(costs: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds -1, 0, ... of every group, summing to ``total``, of least cost; by dynamic programming.

    ``costs`` is (group, threshold + 1, fingerprint). Returns the thresholds (group, fingerprint) and their cost.
    """
    m, levels, n = costs.shape
    top = total + m  # sums counted from -m, so that they are not negative
    best = np.full((top + 1, n), np.inf)
    best[0] = 0
    choice = np.zeros((m, top + 1, n), np.int8)
    for g in range(m):
        new = np.full((top + 1, n), np.inf)
        for s in range(top + 1):
            for t in range(min(levels - 1, s) + 1):
                cost = best[s - t] + costs[g, t]
                better = cost < new[s]
                new[s][better] = cost[better]
                choice[g, s][better] = t
        best = new
    left, out = np.full(n, top), np.zeros((m, n), np.int8)
    for g in range(m - 1, -1, -1):
        out[g] = choice[g, left, np.arange(n)]
        left = left - out[g]
    return out - 1, best[top]


def flips(bits: int, radius: int) -> np.ndarray:
    """All masks over ``bits`` bits with at most ``radius`` bits set."""
    masks, single = np.zeros(1, np.uint64), np.uint64(1) << np.arange(bits, dtype=np.uint64)
    for _ in range(radius):
        masks = np.unique(np.concatenate([masks, (masks[:, None] ^ single).ravel()]))
    return masks[np.bitwise_count(masks) <= radius].view(np.int64)


def _probes(values: list[np.ndarray], limits: np.ndarray, wide: np.ndarray, masks: list[list[np.ndarray]]) -> pa.Array:
    """For each fingerprint the (part, value) that lie within the thresholds of its groups; none for a wide one."""
    at, part, value = [], [], []
    for g, v in enumerate(values):
        for t, flipped in enumerate(masks[g]):
            rows = np.flatnonzero((limits[g] == t) & ~wide)
            at.append(np.repeat(rows, len(flipped)))
            part.append(np.full(len(at[-1]), g, np.int32))
            value.append((v[rows][:, None] ^ flipped).ravel())
    at, part, value = (np.concatenate(x) for x in (at, part, value))
    order = np.argsort(at, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(wide)))])
    probes = pa.StructArray.from_arrays([pa.array(part[order]), pa.array(value[order])], names=["part", "value"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), probes)


def signatures(fps: DataFrame, groups: list[list[int]], counts: list[list[np.ndarray]], n: int, distance: int,
               meets: float = MEETS) -> DataFrame:
    """Every fingerprint with its thresholds: fp, rep, wide, limits (per group), own (its values), probes (part, value).

    ``wide`` marks a fingerprint that even the best thresholds would compare with more than ``meets`` others; it
    has no probes.
    """
    shared = fps.sparkSession.sparkContext.broadcast(counts)
    total, runs = distance - len(groups) + 1, [_cut(g) for g in groups]

    def allotted(batches):
        shells = [[within(h, distance) for h in hs] for hs in shared.value]
        masks = [[flips(len(g), t) for t in range(distance + 1)] for g in groups]
        for batch in batches:
            fp, rep = batch.column("fp").to_numpy(), batch.column("rep")
            costs = np.zeros((len(groups), distance + 2, len(fp)))
            for g, group in enumerate(groups):
                met = expected([_value(fp, r) for r in runs[g]], shells[g], n, distance)
                for t in range(distance + 1):
                    costs[g, t + 1] = met[t] + LOOKUP * len(masks[g][t])
            limits, cost = allot(costs, total)
            wide = cost > meets
            values = [_value(fp, g) for g in groups]
            yield pa.RecordBatch.from_arrays([
                batch.column("fp"), rep, pa.array(wide), pa.array(limits.T.tolist(), pa.list_(pa.int32())),
                pa.array(np.stack(values, 1).tolist(), pa.list_(pa.int64())), _probes(values, limits, wide, masks)],
                names=["fp", "rep", "wide", "limits", "own", "probes"])

    return fps.select("fp", "rep").mapInArrow(
        allotted, "fp long, rep long, wide boolean, limits array<int>, own array<long>, "
                  "probes array<struct<part: int, value: long>>")


# --- search ---------------------------------------------------------------------------------------------

def _as_mask(bits: list[int]) -> int:
    return int(np.bitwise_or.reduce(np.uint64(1) << np.array(bits, np.uint64)).view(np.int64))


def links_within(fps: DataFrame, distance: int = 2, parts: int | None = None, meets: float = MEETS) -> DataFrame:
    """Pairs (a, b) of ``rep`` whose distinct fingerprints (fp, rep) differ in at most ``distance`` bits, each once.

    With thresholds that sum to ``distance`` less the number of groups plus one, a pair within the distance agrees
    in some group within its threshold, whichever of the two sets the thresholds. So one of them probes: the one of
    larger fingerprint, or else the one that is not wide. The pair is reported in the first group that has it. Two
    wide ones meet at a value within half the distance of both (for one bit that is 65 values, and no value has more
    than 65 of them), however many fingerprints share a group's value.
    """
    both, n = bit_counts(fps)
    groups = group_bits(both, n, parts or parts_for(n))
    found = settle(signatures(fps, groups, histograms(fps, groups), n, distance, meets))
    index = found.select(F.col("fp").alias("ifp"), F.col("rep").alias("irep"), F.col("wide").alias("iwide"),
                         F.posexplode("own").alias("ipart", "ivalue"))
    probes = found.select("fp", "rep", "limits", F.inline("probes"))
    apart = F.col("fp").bitwiseXOR(F.col("ifp"))
    first = [(F.col("part") <= g) | (F.bit_count(apart.bitwiseAND(F.lit(_as_mask(bits)))) > F.col("limits")[g])
             for g, bits in enumerate(groups[:-1])]
    condition = reduce(Column.__and__, first, (F.bit_count(apart) <= distance) & (apart != 0)
                       & ((F.col("ifp") < F.col("fp")) | F.col("iwide")))
    same = (F.col("part") == F.col("ipart")) & (F.col("value") == F.col("ivalue"))
    probed = probes.join(index, same & condition)
    pairs = probed.select(F.greatest("rep", "irep").alias("a"), F.least("rep", "irep").alias("b"))
    return pairs.unionByName(_wide_links(found.where("wide").select("fp", "rep"), distance))


def _wide_links(wide: DataFrame, distance: int) -> DataFrame:
    """The same among wide fingerprints, by the values within half the distance of each."""
    near = flips(BITS, -(-distance // 2)).tolist()
    spread = wide.select("fp", "rep", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(v)) for v in near])).alias("value"))
    other = spread.select(F.col("fp").alias("ifp"), F.col("rep").alias("irep"), F.col("value").alias("ivalue"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= distance
    pairs = spread.join(other, (F.col("value") == F.col("ivalue")) & (F.col("ifp") < F.col("fp")) & close)
    return pairs.select(F.greatest("rep", "irep").alias("a"), F.least("rep", "irep").alias("b")).distinct()


def simhash_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text",
                       parts: int | None = None, meets: float = MEETS) -> DataFrame:
    """(doc_id, fp, component_id) per row: fingerprint, and the smallest doc_id reachable over fingerprints that
    differ in at most ``distance`` bits.

    ASCII letters are lower-cased, words are runs without ASCII white space. Null and empty texts and texts without
    words have fingerprint 0 and are linked like any other; a text with fewer words than ``width`` is one shingle.
    Rows of one fingerprint, copies and repeated rows included, are one class before any search. A row with a null
    id keeps its fingerprint, takes no part and has a null component. An empty table gives an empty result. Other
    columns are left out.
    """
    rows = settle(fingerprints(id_text(docs, key, text), width))
    classes = settle(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links_within(classes, distance, parts, meets))
    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("component", "rep").alias("component"))
    return (rows.join(of_class, "fp", "left")
            .select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")))
