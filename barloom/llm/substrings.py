"""Repeated passages of words: a count-min sketch finds windows that may repeat, a second pass groups those."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import by_piece, id_text, mixed, pieces, raw, rolled, word_hashes

#: The sketch: rows of saturating counters 0, 1, "2 or more". Its size is fixed, whatever the input: what is
#: broadcast is one bit per counter, 16 MB. More windows than counters make it let more through, never less.
ROWS, CELLS = 2, 1 << 26
CHUNK = 1 << 20
#: A window is counted by that run of this many of its words whose hash is lowest.
RUN = 8
LAST = (1 << 63) - 1
#: Windows a task holds at a time to settle what it can by itself, 10 MB and four times that while it does so.
HELD = 1 << 18
#: A span of windows is begin * RUNS + length.
RUNS = 1 << 31


def windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` words, and the lowest hash of a run of words inside it.

    Equal windows have equal lowest runs, so the count of the run is never below that of the window, while
    neighbouring windows share theirs and need one counter.
    """
    whole = rolled(h, width)
    run = min(RUN, width)
    low = rolled(h, run)
    span, step = width - run + 1, 1
    while step * 2 <= span:
        low = np.minimum(low[:len(low) - step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[:len(low) - (span - step)], low[span - step:])
    return whole, low[:len(whole)]


def cells(low: np.ndarray) -> list[np.ndarray]:
    """Counter of each value in each row of the sketch."""
    h = mixed(low)
    return [(h & np.uint64(CELLS - 1)).astype(np.int64), (h >> np.uint64(64 - 26)).astype(np.int64)]


def partial_sketches(docs: DataFrame, width: int) -> DataFrame:
    """Every partition's sketch, in compressed chunks; a document adds one for each distinct run."""

    def build(batches):
        counts = [np.zeros(CELLS, np.uint8) for _ in range(ROWS)]
        for piece in pieces(batches):
            lows = [np.unique(windows(h, width)[1]) for x in raw(piece.column("text"))
                    if len(h := word_hashes(x)) >= width]
            if not lows:
                continue
            for count, at in zip(counts, cells(np.concatenate(lows)), strict=True):
                at, n = np.unique(at, return_counts=True)
                count[at] = np.minimum(count[at] + np.minimum(n, 2), 2).astype(np.uint8)
        for row, count in enumerate(counts):
            for chunk in range(CELLS // CHUNK):
                part = count[chunk * CHUNK:(chunk + 1) * CHUNK]
                if part.any():
                    once, twice = (zlib.compress(np.packbits(part >= k).tobytes(), 1) for k in (1, 2))
                    yield pa.RecordBatch.from_pydict({"row": [row], "chunk": [chunk], "once": [once], "twice": [twice]},
                                                     schema=schema)

    schema = pa.schema([("row", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    return docs.select("text").mapInArrow(build, "row int, chunk int, once binary, twice binary")


def merged_sketch(parts: DataFrame) -> list[np.ndarray]:
    """One bit per counter that is 2 or more over all partitions. A task adds the parts of a chunk one by one."""

    def add(batches):
        at, once, twice = None, None, None

        def out():
            return pa.RecordBatch.from_pydict({"row": [at[0]], "chunk": [at[1]], "bits": [zlib.compress(twice.tobytes(), 1)]},
                                              schema=pa.schema([("row", pa.int32()), ("chunk", pa.int32()), ("bits", pa.binary())]))

        for batch in batches:
            for part in batch.to_pylist():
                a, b = (np.frombuffer(zlib.decompress(part[k]), np.uint8) for k in ("once", "twice"))
                if at != (part["row"], part["chunk"]):
                    if at is not None:
                        yield out()
                    at, once, twice = (part["row"], part["chunk"]), a, b
                else:
                    twice, once = twice | b | (once & a), once | a
        if at is not None:
            yield out()

    merged = (parts.repartition("row", "chunk").sortWithinPartitions("row", "chunk")
              .mapInArrow(add, "row int, chunk int, bits binary").collect())
    bits = [np.zeros(CELLS // 8, np.uint8) for _ in range(ROWS)]
    for part in merged:
        begin = part.chunk * CHUNK // 8
        bits[part.row][begin:begin + CHUNK // 8] = np.frombuffer(zlib.decompress(part.bits), np.uint8)
    return bits


def repeated(bits: list[np.ndarray], low: np.ndarray) -> np.ndarray:
    """Which of these values the sketch holds for repeated."""
    found = np.ones(len(low), bool)
    for row, at in zip(bits, cells(low), strict=True):
        found &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return found


class Windows:
    """The windows of one text: their words' bytes, and for each the first window of the text with equal words."""

    def __init__(self, text: bytes, width: int):
        self.words = text.split()
        self.joined = b" ".join(self.words)
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1
        self.ends = ends[width - 1:]
        self.begins = np.concatenate([[0], ends[:-1] + 1])[:len(self.ends)]

    def at(self, i: int) -> bytes:
        return self.joined[self.begins[i]:self.ends[i]]

    def heads(self, hashes: np.ndarray) -> np.ndarray:
        """First equal window of each; hashes only propose, the bytes decide."""
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        heads = first[which]
        for i in np.flatnonzero(heads != np.arange(len(heads))).tolist():
            if self.at(i) != self.at(heads[i]):
                seen: dict[bytes, int] = {}
                return np.array([seen.setdefault(self.at(k), k) for k in range(len(heads))])
        return heads

    def digests(self, at: np.ndarray) -> np.ndarray:
        """128 bits of each of these windows' bytes as two numbers."""
        parts = [xxhash.xxh3_128_digest(self.joined[a:b]) for a, b in zip(self.begins[at].tolist(), self.ends[at].tolist(), strict=True)]
        return np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)


def local_first(found: np.ndarray) -> np.ndarray:
    """What of (d1, d2, place, row, begin) still has to meet the rest of the table, as (d1, d2, place, row, span).

    A window with a smaller place beside it here is repeated for sure and leaves as part of a run of such windows of
    its text (span: begin * RUNS + length, dealt by place and row); of the others each one leaves, with length 0.
    """
    order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
    d1, d2, place = (found[order, i] for i in range(3))
    starts = np.flatnonzero(np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])]))
    least = np.repeat(place[starts], np.diff(np.append(starts, len(order))))
    sure = np.zeros(len(found), bool)
    sure[order] = place > least
    left, runs = found[~sure], found[sure]
    left[:, 4] *= RUNS
    if not len(runs):
        return left
    # rows are still in the order of the texts and, inside one, of the windows
    cut = np.concatenate([[True], (runs[1:, 2:4] != runs[:-1, 2:4]).any(1) | (runs[1:, 4] != runs[:-1, 4] + 1)])
    heads = np.flatnonzero(cut)
    length = np.diff(np.append(heads, len(runs)))
    runs = runs[heads]
    runs[:, :2] = runs[:, 2:4]
    runs[:, 4] = runs[:, 4] * RUNS + length
    return np.concatenate([left, runs])


def batches_of(rows: np.ndarray):
    """Arrow batches of moderate size."""
    for i in range(0, len(rows), 1 << 16):
        part = rows[i:i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in part.T], names=["d1", "d2", "place", "row", "span"])


def remove_repeats(docs: DataFrame, width: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row: the text without words that a repeated window covers.

    Words are runs without ASCII white space, unchanged; a window is ``width`` consecutive words of one row,
    and it is repeated if its words also start earlier: in a row of smaller id, or before it in the same row.
    Windows are judged on the input. ``kept`` joins what is left by single blanks. Null, empty and shorter
    texts lose nothing. Rows that share an id are not earlier than each other and judged each by its text; a null
    id comes after all others. Other columns are left out.

    The sketch of the whole table decides which windows go to the exact pass, which groups them by a digest of
    128 bits of their bytes. A task looks at up to ``HELD`` windows at a time and keeps back those that start earlier
    among these already, so a passage in a third of all rows meets as one row for each of these lots. (Rows that share
    one id, or have none, cannot be told earlier or later and all meet.) The way back names windows by their
    position in the text. Inside a row windows are compared by their bytes.
    """
    docs = id_text(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast([b.tobytes() for b in merged_sketch(partial_sketches(docs, width))])
    # place and row name a text: rows of one id, null ones above all, are told apart by a hash of it
    ranked = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("place"), F.xxhash64("text").alias("row"), "doc_id", "text")

    def candidates(batches):
        bits = [np.frombuffer(b, np.uint8) for b in shared.value]
        held, size = [], 0
        for piece in pieces(batches):
            for place, row, x in zip(piece.column("place").to_pylist(), piece.column("row").to_pylist(),
                                     raw(piece.column("text")), strict=True):
                h = word_hashes(x)
                if len(h) < width:
                    continue
                whole, low = windows(h, width)
                may = np.flatnonzero(repeated(bits, low))
                if not len(may):
                    continue
                own = Windows(x, width)
                at = may[own.heads(whole)[may] == may]
                held.append(np.column_stack([own.digests(at), np.tile(np.array([place, row], np.int64), (len(at), 1)), at]))
                size += len(at)
                if size >= HELD:
                    yield from batches_of(local_first(np.concatenate(held)))
                    held, size = [], 0
        if size:
            yield from batches_of(local_first(np.concatenate(held)))

    rows = ranked.select("place", "row", "text").mapInArrow(candidates, "d1 long, d2 long, place long, row long, span long")
    first = F.min("place").over(Window.partitionBy("d1", "d2", F.col("span") % RUNS == 0))
    gone = (rows.withColumn("first", first).where((F.col("place") > F.col("first")) | (F.col("span") % RUNS != 0))
            .groupBy("place", "row").agg(F.collect_list("span").alias("gone")))

    def make():
        def one(x: bytes, gone) -> tuple[int, int, bytes]:
            own = Windows(x, width)
            n = len(own.words)
            if n < width:
                return n, 0, own.joined
            heads = own.heads(rolled(word_hashes(x), width))
            bad = heads != np.arange(len(heads))
            if gone is not None:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, gone // RUNS, 1)
                np.add.at(edge, gone // RUNS + np.maximum(gone % RUNS, 1), -1)
                bad |= np.cumsum(edge)[:len(bad)] > 0
            if not bad.any():
                return n, 0, own.joined
            edge = np.zeros(n + 1, np.int64)
            edge[:len(bad)] += bad
            edge[width:width + len(bad)] -= bad
            covered = np.cumsum(edge[:n]) > 0
            return n, int(covered.sum()), b" ".join([w for w, c in zip(own.words, covered.tolist(), strict=True) if not c])

        def work(piece: pa.RecordBatch) -> dict:
            lists = piece.column("gone")
            done = [one(x, lists[i].values.to_numpy() if lists[i].is_valid else None)
                    for i, x in enumerate(raw(piece.column("text")))]
            n, removed, kept = zip(*done, strict=True)
            return {"doc_id": piece.column("doc_id"), "n_words": pa.array(n, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}

        return work

    return by_piece(ranked.join(gone, ["place", "row"], "left").select("doc_id", "text", "gone"), make,
                    "doc_id long, n_words long, n_removed long, kept string")
