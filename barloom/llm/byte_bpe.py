"""Byte-level BPE: encode and decode by a rank file, with a queue that suits very long pre-tokens."""

from __future__ import annotations

import base64
import copy
import heapq
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from barloom.llm.common import by_piece, id_text

#: A rank file is broadcast; a larger one is refused.
MAX_RANK_BYTES = 64 << 20
#: Distinct chunks and pre-tokens whose ids a task remembers between pieces of text, and the longest of them.
MEMORY, LONGEST = 400_000, 48
#: From so many pre-tokens on they are merged together.
MANY = 2_000
#: Bytes of text that are encoded at a time: less takes less memory, but merges fewer pre-tokens together.
PIECE_BYTES = 2 << 20

SPACE_RUN = re.compile(r"\s ")
CHUNK = re.compile(r"(?<=\S)(?= )")


class RankQueue:
    """Positions waiting for a merge, by rank.

    A bucket per rank holds positions, lowest first. Three levels of 64-bit words mark the ranks that wait:
    a bit of ``top`` stands for 4096 ranks, of ``groups`` for 64, of ``words`` for one. The lowest rank is
    found by three find-first-set steps whatever the length of the pre-token.
    """

    __slots__ = ("buckets", "words", "groups", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.groups: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.mark(rank)

    def pop(self) -> tuple[int, int]:
        """Lowest rank, then lowest position."""
        rank = self.lowest()
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.clear(rank)
        return rank, position

    def mark(self, rank: int) -> None:
        word, group = rank >> 6, rank >> 12
        self.words[word] = self.words.get(word, 0) | 1 << (rank & 63)
        self.groups[group] = self.groups.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group

    def lowest(self) -> int:
        group = (self.top & -self.top).bit_length() - 1
        bits = self.groups[group]
        word = (group << 6) + (bits & -bits).bit_length() - 1
        low = self.words[word]
        return (word << 6) + (low & -low).bit_length() - 1

    def clear(self, rank: int) -> None:
        word, group = rank >> 6, rank >> 12
        self.words[word] &= ~(1 << (rank & 63))
        if not self.words[word]:
            self.groups[group] &= ~(1 << (word & 63))
            if not self.groups[group]:
                self.top &= ~(1 << group)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the lowest rank first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    after = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))
    waits: list[int | None] = [None] * n  # the rank for which the part here and the next one wait
    queue = RankQueue()
    for i in range(n - 1):
        rank = get(piece[i:i + 2])
        if rank is not None:
            waits[i] = rank
            queue.push(rank, i)
    while queue.top:
        rank, i = queue.pop()
        if waits[i] != rank:
            continue  # stale: a neighbour was merged meanwhile
        gone = after[i]
        end = after[i] = after[gone]
        waits[gone] = None
        if end < n:
            before[end] = i
            waits[i] = new = get(piece[i:after[end]])
            if new is not None:
                queue.push(new, i)
        else:
            waits[i] = None
        left = before[i]
        if left >= 0:
            waits[left] = new = get(piece[left:end])
            if new is not None:
                queue.push(new, left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Merger:
    """The same merges for many pre-tokens at once, laid end to end with a barrier between them.

    One rank queue serves all of them. A bucket's positions are merged together with array operations; where
    two of them overlap, the leftmost goes first. A merge can, with odd vocabularies, bring up a pair of lower
    rank than its own, which would have to come before the rest of the bucket: such a pre-token is done
    again by itself.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        pairs = [(left << 32 | right, rank) for token, rank in ranks.items() for cut in range(1, len(token))
                 if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None]
        pairs.sort()
        self.pairs = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.ranked = np.array([r for _, r in pairs] + [-1], np.int64)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none or where one side is a barrier (-1)."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        found = self.ranked[at]
        found[(self.pairs[at] != key) | (left < 0) | (right < 0)] = -1
        return found

    def run(self, pre_tokens: list[bytes]) -> list[bytes]:
        """Ids of each, as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        n = int(starts[-1])
        token = np.full(n + 1, -1, np.int64)
        inside = np.ones(n, bool)
        inside[starts[1:] - 1] = False
        token[:n][inside] = self.byte[np.frombuffer(b"".join(pre_tokens), np.uint8)]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n], before[0] = n, n  # the last place is a barrier for both ends
        waits = np.full(n + 1, -1, np.int64)
        waits[:n] = self.pair_ranks(token[:-1], token[1:])
        queue = _Buckets()
        queue.push(waits, np.flatnonzero(waits >= 0))
        odd = []
        while queue.top:
            rank, at = queue.pop()
            at = at[waits[at] == rank]  # the others are stale
            if len(at) > 1:
                at = np.unique(at)
                touching = after[at[:-1]] == at[1:]
                if touching.any():
                    place = np.arange(len(at))
                    heads = np.concatenate([[True], ~touching])
                    at = at[(place - np.maximum.accumulate(np.where(heads, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            end = after[gone]
            token[at] = rank
            token[gone] = -2
            waits[gone] = -1
            after[at] = end
            before[end] = at
            left = before[at]
            waits[at] = right_rank = self.pair_ranks(token[at], token[end])
            waits[left] = left_rank = self.pair_ranks(token[left], token[at])
            changed = np.concatenate([at[right_rank >= 0], left[left_rank >= 0]])
            if len(changed):
                low = waits[changed] < rank
                if low.any():
                    odd.append(changed[low])
                queue.push(waits, changed)
        kept = token[:n]
        ends = np.cumsum(kept >= 0)[starts[1:] - 1].tolist()
        ids = kept[kept >= 0].astype("<u4").tobytes()
        out, begin = [], 0
        for end in ends:
            out.append(ids[4 * begin:4 * end])
            begin = end
        for i in set((np.searchsorted(starts, np.concatenate(odd), side="right") - 1).tolist()) if odd else ():
            out[i] = np.array(merge(pre_tokens[i], self.ranks), "<u4").tobytes()
        return out


class _Buckets(RankQueue):
    """The rank queue with arrays of positions in its buckets."""

    __slots__ = ()

    def push(self, waits: np.ndarray, at: np.ndarray) -> None:
        rank = waits[at]
        if len(at) > 1:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            parts = zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], rank[np.concatenate([[0], cuts])].tolist(), strict=True)
        else:
            parts = [(0, 1, int(rank[0]))]
        for start, stop, r in parts:
            bucket = self.buckets.get(r)
            if bucket is not None:
                bucket.append(at[start:stop])
                continue
            self.buckets[r] = [at[start:stop]]
            self.mark(r)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = self.lowest()
        bucket = self.buckets.pop(rank)
        self.clear(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Codec:
    """Encoder and decoder of one rank file and one split pattern."""

    def __init__(self, data: bytes, pattern: str) -> None:
        self.ranks = parse_ranks(data)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.merger = Merger(self.ranks)
        self.chunks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for memory in (self.chunks, self.known):
            if len(memory) > MEMORY:
                memory.clear()
        seen: set[str] = set()
        for text in texts:  # cut again below, as the chunks of all texts at once are many times their size
            seen.update(cut(text))
        missing = list(seen.difference(self.chunks))
        del seen
        split = list(map(self.find, missing))
        self.known.update(self.merge_all(list(set().union(*split).difference(self.known))))
        for c, found in zip(missing, split, strict=True):
            self.chunks[c] = b"".join(map(self.known.__getitem__, found))
        ids = [b"".join(map(self.chunks.__getitem__, cut(text))) for text in texts]
        for memory, new in ((self.chunks, missing), (self.known, {t for found in split for t in found})):
            for key in new:
                if len(key) > LONGEST:
                    memory.pop(key, None)
        return ids

    def fresh(self) -> Codec:
        """The same codec that remembers nothing yet."""
        other = copy.copy(self)
        other.chunks, other.known = {}, {}
        return other

    def merge_all(self, pre_tokens: list[str]) -> dict[str, bytes]:
        done, rest, raw = {}, [], []
        for t in pre_tokens:
            data = t.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                done[t] = rank.to_bytes(4, "little")
            else:
                rest.append(t)
                raw.append(data)
        if len(rest) >= MANY:
            done.update(zip(rest, self.merger.run(raw), strict=True))
        else:
            done.update((t, np.array(merge(d, self.ranks), "<u4").tobytes()) for t, d in zip(rest, raw, strict=True))
        return done

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def cut(text: str) -> list[str]:
    """Chunks that can be split by themselves: no match of the pattern runs from a character that is no white
    space into a following blank."""
    if SPACE_RUN.search(text) is None:
        head, *tail = text.replace(" ", "\0 ").split("\0") if "\0" not in text else CHUNK.split(text)
        return [head, *tail] if head else tail
    return CHUNK.split(text)


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (binary, little-endian uint32) and decoded (binary).

    Null and empty texts have no tokens, a null key stays null, repeated rows are encoded each, other columns
    are left out. A text of any length is handled whole; its longest pre-token costs n log n steps. The rank
    file (at most 64 MB) is read once by the driver and broadcast.
    """
    if os.path.getsize(ranks_path) > MAX_RANK_BYTES:
        raise ValueError("the rank file is too large to broadcast")
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        codec = _codec(shared.value, pattern).fresh()  # what it remembers goes with the task, as a worker outlives it

        def work(piece: pa.RecordBatch) -> dict:
            ids = codec.encode([x or "" for x in piece.column("text").to_pylist()])
            return {"doc_id": piece.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids],
                    "ids": pa.array(ids, pa.binary()), "decoded": pa.array(map(codec.decode, ids), pa.binary())}

        return work

    return by_piece(id_text(docs, key, text), make, "doc_id long, n_tokens long, ids binary, decoded binary", most=PIECE_BYTES)
