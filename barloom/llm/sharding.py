"""Shards by a permutation-filled lookup table: even, stable when shards come or go, one lookup per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime well above 100 times the number of shards keeps shares within a percent or so.
SLOTS = 65_537
MAX_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _name_hash(name: str, seed: int) -> int:
    """FNV-1a over the name and the seed: defined by the name alone, so that every run agrees."""
    h = 0xCBF29CE484222325
    for byte in f"{seed}:{name}".encode():
        h = (h ^ byte) * 0x100000001B3 % (1 << 64)
    h ^= h >> 33
    return h * 0xFF51AFD7ED558CCD % (1 << 64) >> 11


def lookup_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """Index of the shard that owns each slot.

    A shard prefers slots in the order offset, offset + skip, … (mod ``slots``), which visits all of them as
    their number is prime. Shards take turns; in its turn a shard claims the first slot of its order that is
    free, ``weights[i]`` of them if weights are given. The size depends on the parameters alone.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(slots) or slots < len(shards) or slots > MAX_SLOTS:
        raise ValueError("the number of slots must be a prime, at least the number of shards, at most a million")
    turns = weights or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("weights must be non-negative, one per shard, not all 0")
    at = [_name_hash(s, 1) % slots for s in shards]
    skip = [_name_hash(s, 2) % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while True:
        for i, n in enumerate(turns):
            for _ in range(n):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                owner[at[i]] = i
                free -= 1
                if not free:
                    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of its MD5, modulo the number of slots. A null key counts as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """Rows of ``df`` as they are, with ``slot`` (int) and ``shard`` (string) put after them.

    The table of slots is a constant array of the plan (at most a million entries), so placement is one
    lookup per row: no shuffle, however large a share of the rows a key or source holds. Equal keys go to
    equal shards; null keys to one shard. Columns of these two names that are there already are replaced. An
    empty table gives an empty one.
    """
    owner = lookup_table(shards, slots, weights)
    slot = slot_of(df[key], slots)
    owners = F.split(F.lit(",".join(map(str, owner))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    kept = [df[c] for c in df.columns if c not in ("slot", "shard")]
    placed = df.select(*kept, slot.alias("slot"))
    return placed.withColumn("shard", F.element_at(names, F.element_at(owners, F.col("slot") + 1).cast("int") + 1))


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, files_per_shard: int = 1, **options) -> None:
    """Write one folder per shard. Rows of a shard are dealt over ``files_per_shard`` tasks by their slot,
    so a file's size follows from the number of slots, not from how keys are spread over sources."""
    placed = place(df, key, shards, **options)
    spread = F.pmod(F.col("slot"), F.lit(files_per_shard))
    (placed.repartition(len(shards) * files_per_shard, "shard", spread)
     .write.partitionBy("shard").mode("overwrite").parquet(path))
