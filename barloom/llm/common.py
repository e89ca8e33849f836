"""Reading tables and walking Arrow batches in bounded pieces; used by every operator of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker holds at a time besides the batch it was sent.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that others cannot clash."""
    return df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each piece stays near ``most`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).cast(pa.large_binary())
        ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + len(sizes) + 1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def by_piece(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str,
             text: str = "text", most: int = PIECE_BYTES) -> DataFrame:
    """Apply ``make()(piece)`` to pieces of every partition; the function returns columns by name.

    ``make`` runs once in a task, so that models and tables are set up once. No shuffle is involved and a
    lost task is simply run again. A worker outlives its task, so Arrow's unused memory is given back at the end.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        work = make()
        for piece in pieces(batches, text, most):
            out = work(piece)
            yield pa.RecordBatch.from_arrays([pa.array(out[n]) if not isinstance(out[n], pa.Array) else out[n]
                                              for n in names], names=names)
        piece = out = None
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """Word to 64-bit hash. The bound keeps a worker's memory flat however many words there are."""

    BOUND = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
SHIFT = np.uint64(31)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all others (a multiply and shift round on both sides)."""
    h = (h ^ (h >> SHIFT)) * MIX
    return (h ^ (h >> np.uint64(29))) * ODD ^ (h >> SHIFT)


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` neighbours of ``h``: len(h) - width + 1 values, none if there are fewer.

    Runs of 1, 2, 4, … neighbours are joined until ``width`` is reached, so the cost is its logarithm.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, step, base = None, 0, h, 1, np.array([ODD])
    while True:
        if width & step:
            out = power[:n] if out is None else out * base + power[done:done + n]
            done += step
        if done == width:
            return mixed(out)
        power = power[:len(power) - step] * base + power[step:]
        step, base = step * 2, base * base


def shingles(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Hashes of all shingles of ``width`` words; fewer words are one shingle, no word is none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return rolled(h, min(width, len(words)))


# Bytes that part words: blank and tab to carriage return.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, as many as the longest text so far needed."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        for i, base in enumerate((ODD, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


#: Longest word that is hashed as a polynomial. Among longer ones there are words, such as those of Thue and Morse,
#: whose polynomials agree in many bits whatever the base.
POLYNOMIAL_BYTES = 24


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of every word of a text, in order, without making the words but for long ones.

    A short word's hash is a polynomial of its bytes: the difference of two running sums over the text, brought to
    the word's own start, so that only array operations touch the bytes. A long word has its XXH3.
    """
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_BLANK[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    powers, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers, out=sums[1:])
    out = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * MIX)
    for i in np.flatnonzero(ends - starts > POLYNOMIAL_BYTES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[starts[i]:ends[i]])
    return out


def text_shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of all shingles of ``width`` words of a text; fewer words are one shingle, no word is none."""
    h = word_hashes(text)
    return rolled(h, min(width, len(h))) if len(h) else h


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def crc_mod(key: str, n: int):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(n))
