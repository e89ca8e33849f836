"""Benchmark items inside documents: MinHash containment search by size of item, verified on exact shingles."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ODD, mixed, pieces, raw, text_shingles
from barloom.session import settle

#: Chance that an item that is there is not found, at most.
MISS = 1e-6
#: Step from one size partition to the next.
GROWTH = 1.5
#: Items are broadcast in parts of about half this many bytes of text at most, one after the other.
MAX_ITEM_BYTES = 64 << 20

#: Shingles that are compared at a time, so that they stay in a core's cache; strides shorter than SHORT lie crosswise.
CHUNK, SHORT = 1 << 15, 128


class Partition:
    """Items whose number of shingles lies in (low, high].

    Documents are cut into strides of ``high`` shingles, and a block is two neighbouring strides, so a passage
    of that many shingles lies whole in some block. A text with fewer than ``least`` shingles holds the share of no
    item. ``marks`` tells by the last bits of a MinHash value whether an item may have it. An item of which a share t is in a block of 2 * high
    shingles has a Jaccard similarity of at least t * low / (2 * high + (1 - t) * low) with it, and that is the
    chance that one MinHash value of both agrees; the number of values follows from it.
    """

    def __init__(self, low: int, high: int, share: float) -> None:
        self.high = high
        least = max(low, 1)
        chance = share * least / (2 * high + (1 - share) * least)
        self.functions = math.ceil(math.log(MISS) / math.log(1 - chance))
        self.seeds = mixed(np.arange(1, self.functions + 1, dtype=np.uint64) * ODD) | np.uint64(1)
        self.values: list[dict[int, list[int]]] = [{} for _ in range(self.functions)]
        self.sorted: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.share, self.least = share, high

    def add(self, item: int, fingerprints: np.ndarray) -> None:
        self.least = min(self.least, math.floor(self.share * len(fingerprints)))
        for table, seed in zip(self.values, self.seeds, strict=True):
            table.setdefault(int((fingerprints * seed).min()), []).append(item)

    def close(self) -> None:
        self.sorted = [np.array(sorted(t), np.uint64) for t in self.values]
        self.least = max(self.least, 1)
        for keys in self.sorted:
            marks = np.zeros(min(1 << 16, max(1 << 12, 1 << (32 * len(keys)).bit_length())), bool)
            marks[(keys & np.uint64(len(marks) - 1)).view(np.int64)] = True
            self.marks.append(marks)


class Index:
    """The items' MinHash values by size partition, and their full sets for the exact check."""

    def __init__(self, items: list[tuple[int, str | None]], width: int, percent: int) -> None:
        self.width, self.percent = width, percent
        self.sets: list[tuple[int, frozenset]] = []
        self.partitions: dict[int, Partition] = {}
        for item, text in items:
            data = (text or "").encode().lower()
            words = data.split()
            if item is None or not words:
                continue
            fingerprints = np.unique(text_shingles(data, width))
            size = len(fingerprints)
            level = max(0, math.ceil(math.log(size, GROWTH) - 1e-9))
            low, high = (math.floor(GROWTH ** (level - 1)) if level else 0), math.ceil(GROWTH ** level)
            part = self.partitions.setdefault(level, Partition(low, high, percent / 100))
            part.add(len(self.sets), fingerprints)
            self.sets.append((item, word_shingles(words, width)))
        self.lengths = sorted({len(next(iter(s))) for _, s in self.sets} - {width})
        for part in self.partitions.values():
            part.close()

    def search(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(position in ``texts``, position in ``sets``) of candidates.

        All texts lie end to end in one array, made once for a width. Blocks never cross them; one pass of array
        operations per MinHash function covers all blocks.
        """
        found: set[tuple[int, int]] = set()
        lower = [x.lower() for x in texts]
        for width in [self.width, *self.lengths]:
            arrays = [text_shingles(x, width) for x in lower]
            for level in sorted(self.partitions) if width == self.width else [0]:
                found |= self._blocks(self.partitions[level], arrays)
        return sorted(found)

    @staticmethod
    def _blocks(part: Partition, arrays: list[np.ndarray]) -> set[tuple[int, int]]:
        """Candidates of one partition. Every text has two strides at least, and its last one is filled up with its
        last shingle, which changes no minimum, so strides of one length lie side by side in pieces of CHUNK."""
        sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
        full = np.flatnonzero(sizes >= part.least)
        found: set[tuple[int, int]] = set()
        if not len(full):
            return found
        strides = np.maximum(-(-sizes[full] // part.high), 2)
        owner = np.repeat(full, strides)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(strides) - strides, strides)
        ends = np.cumsum(sizes)
        first, last = (ends - sizes)[owner] + within * part.high, ends[owner] - 1
        h, offsets, short = np.concatenate(arrays), np.arange(part.high), part.high < SHORT
        step = max(1, CHUNK // part.high)
        for begin in range(0, len(owner) - 1, step):
            here = slice(begin, begin + step + 1)
            cut = h[np.minimum(first[here, None] + offsets, last[here, None])]
            if short:
                cut = np.ascontiguousarray(cut.T)
            product = np.empty_like(cut)
            for seed, table, keys, marks in zip(part.seeds, part.values, part.sorted, part.marks, strict=True):
                low = np.multiply(cut, seed, out=product).min(axis=0 if short else 1)
                block = np.minimum(low[:-1], low[1:])
                maybe = np.flatnonzero(marks[(block & np.uint64(len(marks) - 1)).view(np.int64)])
                if not len(maybe):
                    continue
                at = np.searchsorted(keys, block[maybe])
                at[at == len(keys)] = 0
                for i in maybe[keys[at] == block[maybe]].tolist():
                    if owner[begin + i] == owner[begin + i + 1]:
                        found.update((int(owner[begin + i]), item) for item in table[int(block[i])])
        return found


def word_shingles(words: list[bytes], width: int) -> frozenset:
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(zip(*(words[i:] for i in range(width)), strict=False))


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id",
                    text: str = "text", item_key: str = "item_id", item_text: str = "text", tell_rows: bool = False,
                    part_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles): items of which at least ``percent`` of the distinct shingles of
    ``width`` words are in the whole document.

    ASCII letters are lower-cased and words are runs without ASCII white space. An item of fewer words is one
    shingle, its word sequence, and is looked for as such. An item counts as found where a passage of about its
    own length holds that share; one whose shingles are strewn over a long document may be missed. Items or
    documents that are null or empty match nothing; a null item_id is left out, a null doc_id is kept; equal
    items and repeated rows give a row each. Other columns are left out; with ``tell_rows`` a column ``row``
    follows, the 64-bit hash of the text, which tells rows of one id apart.

    A benchmark of up to ``part_bytes`` of text goes to every task as one broadcast, and documents are read once,
    without a shuffle. A larger one is dealt by hash into parts of half that on average; each part is searched
    in a pass over all documents, its rows are written to the shared folder, and its broadcast ends before the
    next begins. So neither the driver nor a task holds more than a part (or one item, if that is larger).
    """
    listed = items.select(items[item_key].cast("long").alias("item"), items[item_text].cast("string").alias("text"))
    size = listed.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = 1 if size <= part_bytes else -(-2 * size // part_bytes)
    if parts == 1:
        found = _search(docs, listed, width, percent, key, text)[0]
    else:
        done = []
        for part in range(parts):
            rows, shared = _search(docs, listed.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part),
                                   width, percent, key, text)
            done.append(settle(rows))
            shared.destroy()
        found = reduce(DataFrame.unionByName, done)
    return found if tell_rows else found.drop("row")


def _search(docs: DataFrame, items: DataFrame, width: int, percent: int, key: str, text: str) -> tuple[DataFrame, Broadcast]:
    """Rows found for items that fit a broadcast, and that broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64()),
                        ("row", pa.int64())])

    def search(batches):
        index = Index(shared.value, width, percent)
        for piece in pieces(batches):
            texts, ids, hashes = raw(piece.column("text")), piece.column("doc_id").to_pylist(), piece.column("row").to_pylist()
            rows: list[tuple] = []
            sets: dict[tuple[int, int], frozenset] = {}
            for at, candidate in index.search(texts) if index.sets else ():
                item, wanted = index.sets[candidate]
                length = len(next(iter(wanted)))
                if (at, length) not in sets:
                    words = texts[at].lower().split()
                    sets[at, length] = word_shingles(words, length) if len(words) >= length else frozenset()
                both = len(wanted & sets[at, length])
                if 100 * both >= percent * len(wanted):
                    rows.append((ids[at], item, both, len(wanted), hashes[at]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)],
                                                 schema=schema)

    found = (docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
             .withColumn("row", F.xxhash64("text"))
             .mapInArrow(search, "doc_id long, item_id long, n_shared long, n_shingles long, row long"))
    return found, shared


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` in which no item is found, each judged by its own text, whatever its id; columns as they were."""
    hit = (contained_items(docs, items, width, percent, tell_rows=True)
           .select(F.col("doc_id").alias("that id"), F.col("row").alias("that text")).distinct())
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["that id"])
                     & (F.xxhash64(docs["text"].cast("string")) == hit["that text"]), "left_anti")
