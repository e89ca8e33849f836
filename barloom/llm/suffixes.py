"""Repeated byte strings: sampled suffixes, sorted in runs, exchanged front-coded and merged by loser trees.

A string of ``length`` bytes has one lowest-hashed piece of PIECE bytes, the same wherever the string occurs.
Only suffixes that start at such a piece (anchors, about one in 170 bytes) are sorted, and of those only the
ones whose piece occurs more than once. An anchor stands for a range of window starts to its left; whether
such a window occurs elsewhere is decided on the bytes on both sides of equal anchors.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import as_long, by_piece, id_text, pieces, raw, rolled
from barloom.session import settle

#: Bytes of the piece that makes an anchor, and bits that hold a position while anchors are looked for.
PIECE, PLACE_BITS = 64, 24
#: Bytes that are hashed at a time.
CHUNK = 1 << 20
#: Suffixes are sorted in runs of about so many bytes, and a merge takes ranges of about so many.
RUN_BYTES, RANGE_BYTES = 16 << 20, 8 << 20
#: Anchors with one piece beyond which they are not gathered in one task but compared by their windows' digests.
HOT = 200_000


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: position, first and last window start they stand for, piece hash."""
    wide = length - PIECE + 1
    step = min(CHUNK, (1 << PLACE_BITS) - 2 * length)
    out: list[tuple] = []
    for begin in range(0, max(len(data) - length + 1, 0), step):
        part = data[begin:begin + step + length - 1]
        h = rolled(part.astype(np.uint64) + np.uint64(1), PIECE)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= wide:
            low = np.minimum(low[:len(low) - span], low[span:])
            span *= 2
        if wide > span:
            low = np.minimum(low[:len(low) - (wide - span)], low[wide - span:])
        starts = np.arange(begin, begin + len(low))
        text_end = ends[np.searchsorted(ends, starts, side="right")]
        starts = starts[starts + length <= text_end]
        if not len(starts):
            continue
        at = (low[starts - begin] & mask).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.concatenate([cut[1:], [len(at)]]) - 1
        out.append((at[cut] + begin, starts[cut], starts[last], h[at[cut]]))
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def text_anchors(docs: DataFrame, length: int) -> DataFrame:
    """digest, place, keys, at, lo, hi per row; the last four are arrays over the row's anchors."""

    def make():
        def work(piece: pa.RecordBatch) -> dict:
            texts = raw(piece.column("text"))
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            at, lo, hi, keys = anchors(np.frombuffer(b"".join(texts), np.uint8), ends, length)
            cuts = np.concatenate([[0], np.searchsorted(at, ends)]).astype(np.int32)
            base = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(cuts))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(cuts), pa.array(x, kind))
            return {"digest": piece.column("digest"), "place": piece.column("place"), "keys": lists(as_long(keys), pa.int64()),
                    "at": lists(at - base, pa.int32()), "lo": lists(lo - base, pa.int32()), "hi": lists(hi - base, pa.int32())}

        return work

    return by_piece(docs, make, "digest binary, place long, keys array<long>, at array<int>, lo array<int>, hi array<int>")


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are not looked at again."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


# A suffix is (sort string, left bytes, text id, position, first window, last window); the sort string is the
# piece's hash, then the bytes from the anchor to the end of the last window.
Suffix = tuple[bytes, bytes, bytes, int, int, int]


def front_coded(run: list[Suffix]) -> bytes:
    """A sorted run as one block: of each sort string only what its predecessor does not have."""
    shared = [0] + [common(a[0], b[0], 0) for a, b in zip(run, run[1:], strict=False)]
    numbers = np.array([(c, len(s[0]) - c, len(s[1]), *s[3:]) for c, s in zip(shared, run, strict=True)], "<i4")
    tails = b"".join([s[0][c:] for c, s in zip(shared, run, strict=True)])
    body = (len(run).to_bytes(4, "little"), len(tails).to_bytes(4, "little"), numbers.tobytes(), tails,
            b"".join([s[2] for s in run]), b"".join([s[1] for s in run]))
    return zlib.compress(b"".join(body), 1)


def decoded(block: bytes) -> Iterator[tuple[int, Suffix]]:
    """(bytes shared with the predecessor, suffix), one after the other."""
    data = zlib.decompress(block)
    n, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    numbers = np.frombuffer(data, "<i4", n * 6, 8).reshape(n, 6).tolist()
    tail = 8 + n * 24
    own = tail + size
    left = own + n * 16
    before = b""
    for shared, rest, wide, at, lo, hi in numbers:
        before = before[:shared] + data[tail:tail + rest]
        yield shared, (before, data[left:left + wide], data[own:own + 16], at, lo, hi)
        tail, own, left = tail + rest, own + 16, left + wide


def merged(blocks: list[bytes]) -> Iterator[tuple[int, Suffix]]:
    """All suffixes in order, each with the bytes it shares with the one before.

    A tree of losers: every waiting suffix knows how much it shares with the last winner. Of two, the one that
    shares more comes first and no byte is read; if they share as much, reading starts behind that.
    """
    runs = [decoded(b) for b in blocks]
    k = 1 << max(len(runs) - 1, 0).bit_length()
    heads: list[Suffix | None] = [None] * k
    shares = [0] * k
    losers = [0] * k

    def beats(i: int, j: int) -> bool:
        """Whether i's suffix comes before j's; the loser learns what it shares with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if shares[i] != shares[j]:
            return shares[i] > shares[j]
        h = common(a[0], b[0], shares[i])
        first = a[0][h:h + 1] <= b[0][h:h + 1]
        shares[j if first else i] = h
        return first

    for i, run in enumerate(runs):
        heads[i] = next(run, (0, None))[1]

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        won, lost = (a, b) if beats(a, b) else (b, a)
        losers[node] = lost
        return won

    best = play(1) if runs else 0
    while runs and heads[best] is not None:
        yield shares[best], heads[best]
        shares[best], heads[best] = next(runs[best], (0, None))
        node = (best + k) >> 1
        while node:
            if not beats(best, losers[node]):
                best, losers[node] = losers[node], best
            node >>= 1


def repeated_windows(group: list[tuple[int, Suffix]], length: int) -> Iterator[tuple[Suffix, int, int]]:
    """(suffix, first, last distance): the windows of a group of equal anchors that occur at least twice.

    A window of distance d starts d bytes left of its anchor. ``group`` is in suffix order with the bytes
    shared with the predecessor, so a suffix's best neighbour bounds d from below. Suffixes with the same
    bytes all round are settled at once and one of them stands for all; the rest halve the range of distances
    and part by the bytes that all windows of a half have in common, until those of a half are settled at once
    too, down to single windows at the most.
    """
    skip = 8
    classes: dict[tuple, list[Suffix]] = defaultdict(list)
    for k, (shared, s) in enumerate(group):
        best = max(shared if k else 0, group[k + 1][0] if k + 1 < len(group) else 0) - skip
        least, most = max(s[3] - s[5], length - best), s[3] - s[4]
        if least <= most:
            classes[least, most, s[1], s[0]].append(s)
    members = []
    for (least, most, _, _), same in classes.items():
        places = {(s[2], s[3]) for s in same}
        if len(places) > 1:
            for s in same:
                yield s, least, most
        members.append((same[0], least, most, len(places) > 1))

    def core(s: Suffix, near: int, far: int) -> bytes:
        return s[1][len(s[1]) - near:] + s[0][skip:skip + length - far]

    todo = [(0, (1 << (length - PIECE).bit_length()) - 1, members)]
    while todo:
        near, far, rows = todo.pop()
        parts: dict[bytes, list] = defaultdict(list)
        for row in rows:
            if row[1] <= far and row[2] >= near:
                parts[core(row[0], max(near, 0), min(far, length))].append(row)
        for part in parts.values():
            if len(part) < 2 or all(settled for *_, settled in part):
                continue
            if near == far:
                for s, _, _, settled in part:
                    if not settled:
                        yield s, near, near
                continue
            whole: dict[bytes, list] = defaultdict(list)
            open_rows = []
            for row in part:
                if row[1] <= near and row[2] >= far:
                    whole[row[0][1][len(row[0][1]) - far:] + row[0][0][skip:skip + length - near]].append(row)
                else:
                    open_rows.append(row)
            for same in whole.values():
                if len(same) > 1:
                    for s, _, _, settled in same:
                        if not settled:
                            yield s, near, far
                open_rows.append(same[0] if len(same) == 1 else (*same[0][:3], True))
            if len(open_rows) > 1:
                half = (near + far) // 2
                todo += [(near, half, open_rows), (half + 1, far, open_rows)]


def _contexts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, Suffix]]:
    """(key, suffix) of the candidates of each text."""
    for digest, text, found in zip(batch.column("digest").to_pylist(), raw(batch.column("text")),
                                   batch.column("found").to_pylist(), strict=True):
        for a in found:
            key = a["key"] & (1 << 64) - 1
            at, lo, hi = a["at"], a["lo"], a["hi"]
            yield key, (key.to_bytes(8, "big") + text[at:hi + length], text[lo:at], digest, at, lo, hi)


def _merge_sorted(texts: DataFrame, ranges: int, length: int) -> DataFrame:
    """(digest, start, stop): bytes of repeated windows, found by the distributed merge sort."""

    def runs(batches):
        held: list[tuple[int, Suffix]] = []
        size = 0

        def flush():
            held.sort(key=lambda x: x[1][0])
            begin = 0
            while begin < len(held):
                own = held[begin][0] * ranges >> 64
                stop = begin
                while stop < len(held) and held[stop][0] * ranges >> 64 == own:
                    stop += 1
                block = front_coded([s for _, s in held[begin:stop]])
                yield pa.RecordBatch.from_pydict({"range": pa.array([own], pa.int32()), "block": pa.array([block], pa.binary())})
                begin = stop
            held.clear()

        for batch in pieces(batches):
            for item in _contexts(batch, length):
                held.append(item)
                size += len(item[1][0]) + len(item[1][1])
                if size > RUN_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    def merge(batches):
        def spans(blocks):
            group: list[tuple[int, Suffix]] = []
            for shared, s in merged(blocks):
                if group and shared < 8 + PIECE:
                    if len(group) > 1:
                        yield from repeated_windows(group, length)
                    group = []
                group.append((shared, s))
            if len(group) > 1:
                yield from repeated_windows(group, length)

        def out(blocks):
            found = ((s[2], s[3] - far, s[3] - near + length) for s, near, far in spans(blocks))
            while rows := list(islice(found, 20_000)):
                digest, start, stop = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
                                                 names=["digest", "start", "stop"])

        own, blocks = None, []
        for batch in batches:
            for r, block in zip(batch.column("range").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if r != own and blocks:
                    yield from out(blocks)
                    blocks = []
                own = r
                blocks.append(block)
        if blocks:
            yield from out(blocks)

    return (texts.mapInArrow(runs, "range int, block binary").repartition(F.col("range")).sortWithinPartitions("range")
            .mapInArrow(merge, "digest binary, start int, stop int"))


def _by_digest(texts: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very common pieces: every window by 128 bits of digest, counted with partial sums."""
    import xxhash

    def windows(batches):
        for batch in pieces(batches):
            for _, s in _contexts(batch, length):
                data = s[1] + s[0][8:]
                n = s[5] - s[4] + 1
                made = b"".join([xxhash.xxh3_128_digest(data[i:i + length]) for i in range(n)])
                both = np.frombuffer(made, np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([s[2]] * n, pa.binary()),
                     pa.array(np.arange(s[4], s[5] + 1, dtype=np.int32))], names=["w1", "w2", "digest", "start"])

    found = texts.mapInArrow(windows, "w1 long, w2 long, digest binary, start int")
    twice = found.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return found.join(twice, ["w1", "w2"]).select("digest", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(rows: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(digest, spans): for every distinct text with repeated windows, what they cover, as unsorted spans.

    ``rows`` has digest, place and text. Copies of a text are one text here.
    """
    each = text_anchors(rows, length).groupBy("digest").agg(
        F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("keys", "at", "lo", "hi")])
    flat = settle(each).select("digest", "place", F.inline(F.arrays_zip("keys", "at", "lo", "hi"))).withColumnRenamed("keys", "key")
    counts = settle(flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    candidates = flat.join(counts, "key")
    ranges = max(32, total * 2 * length // RANGE_BYTES)

    def texts(found: DataFrame) -> DataFrame:
        lists = found.groupBy("digest", "place").agg(F.collect_list(F.struct("key", "at", "lo", "hi")).alias("found"))
        return rows.join(lists, ["digest", "place"]).select("digest", "text", "found")

    spans = _merge_sorted(texts(candidates.where(F.col("n") <= hot)), ranges, length)
    if most > hot:
        spans = spans.unionByName(_by_digest(texts(candidates.where(F.col("n") > hot)), length))
    return spans.groupBy("digest").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row: the text's UTF-8 bytes without those that a string
    of ``length`` bytes covers which starts anywhere else, in the same row or another. ``kept`` is binary.

    Strings are judged on the input and do not cross rows; overlapping occurrences count. Null texts are
    empty; shorter texts lose nothing. Rows are told apart by their place in the table, so a repeated row is a
    copy like any other and both lose what they share; a null id is kept as it is. Other columns are left out.
    Texts of any length are taken whole.

    Equal texts meet by digest first: if there are two of at least ``length`` bytes, all of it goes, and only
    one of them is searched.
    """
    if length <= 2 * PIECE:
        raise ValueError(f"length must be above {2 * PIECE}")
    rows = id_text(docs, key, text).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("place"))
    rows = rows.withColumn("digest", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))
    copies = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", F.lit(True).alias("copied"))
    spans = repeated_spans(rows, length, hot)
    marks = spans.join(copies, "digest", "full")

    def make():
        def one(data: bytes, starts, stops, copied: bool) -> tuple[int, int, int, bytes]:
            n = len(data)
            if copied and n >= length:
                return n, n, 1, b""
            if starts is None:
                return n, 0, 0, data
            order = np.argsort(starts, kind="stable")
            starts, reach = starts[order], np.maximum.accumulate(stops[order])
            fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
            begin, end = starts[fresh], reach[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(reach) - 1]])]
            kept, at = [], 0
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                kept.append(data[at:b])
                at = e
            return n, int((end - begin).sum()), len(begin), b"".join([*kept, data[at:]])

        def work(piece: pa.RecordBatch) -> dict:
            lists, copied = piece.column("spans"), piece.column("copied").to_pylist()
            done = []
            for i, data in enumerate(raw(piece.column("text"))):
                own = lists[i].values if lists[i].is_valid else None
                done.append(one(data, *((own.field(0).to_numpy(), own.field(1).to_numpy()) if own is not None else (None, None)),
                                bool(copied[i])))
            n, removed, runs, kept = zip(*done, strict=True)
            return {"doc_id": piece.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary())}

        return work

    return by_piece(rows.join(marks, "digest", "left").select("doc_id", "text", "spans", "copied"), make,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
