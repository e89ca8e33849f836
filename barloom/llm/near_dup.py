"""Near duplicates: HyperMinHash registers in bands, corrected estimates, links confirmed on full shingle sets."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import as_long, by_piece, id_text, mixed, pieces, raw, text_shingles
from barloom.llm.graph import components
from barloom.session import settle

#: A sketch has 2**8 registers for estimates. For the search each two of them are one, in 32 bands of 4: at a
#: similarity of 0.8 a pair is missed with 4.6e-8.
BUCKET_BITS, BANDS, PER_BAND = 8, 32, 4
REGISTERS = 1 << BUCKET_BITS
#: Bits that a register keeps after the leading one.
MANTISSA = 10
#: Bits kept for a band's key. A short text fills one register of many of its bands, and with few bits such
#: bands of unrelated texts would be equal by chance.
BAND_MANTISSA = 40
#: Chance at most with which a pair right at the threshold is dropped for its registers, without a look at its texts.
MISS = 1e-6
#: Members and shingles of a group in a block, about; two blocks are compared in one task.
BLOCK, BLOCK_SHINGLES = 2048, 4 << 20
#: Bands that a pair must share to be tried first; at the threshold nearly all pairs share more.
FIRST_BANDS = 3
#: Bits of a sieve for each of its keys, at least, and of the largest sieve.
SIEVE_SHARE, SIEVE_BITS = 8, 1 << 25


def registers(fingerprints: np.ndarray, bucket_bits: int = BUCKET_BITS, mantissa: int = MANTISSA) -> np.ndarray:
    """HyperMinHash of sorted distinct 64-bit fingerprints: the first bits choose a register, which keeps the
    leading-zero count of its smallest remainder and the bits after the leading one. 0 marks an empty one."""
    out = np.zeros(1 << bucket_bits, np.uint64)
    bucket = (fingerprints >> np.uint64(64 - bucket_bits)).astype(np.int64)
    first = np.ones(len(bucket), bool)
    first[1:] = bucket[1:] != bucket[:-1]
    rest = ((fingerprints[first] << np.uint64(bucket_bits)) >> np.uint64(11)).astype(np.int64)  # 53 bits
    length = np.frexp(rest.astype(np.float64))[1]
    shift = length - 1 - mantissa
    tail = np.where(shift >= 0, rest >> np.maximum(shift, 0), rest << np.maximum(-shift, 0)) & ((1 << mantissa) - 1)
    out[bucket[first]] = (54 - length).astype(np.int64) << mantissa | tail
    return out


def band_keys(fingerprints: np.ndarray) -> list[int | None]:
    """One key per band of registers; a band of empty registers has none."""
    packed = registers(fingerprints, (BANDS * PER_BAND).bit_length() - 1, BAND_MANTISSA).reshape(BANDS, PER_BAND)
    joined = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(PER_BAND):
        joined = mixed(joined) + packed[:, i]
    keys = as_long(mixed(joined)).tolist()
    return [k if filled else None for k, filled in zip(keys, packed.any(axis=1).tolist(), strict=True)]


def similarity(agree: np.ndarray, used: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity: registers that agree, less those expected to agree by chance in the bits
    that are kept (approximation of the HyperMinHash paper for sets of n and m elements), over those in use."""
    large, small = np.maximum(n, m), np.minimum(n, m)
    balance = 4.0 * small * large / np.maximum(large + small, 1) ** 2
    chance = 0.169919487159739093975315012348630288992889 * 2.0 ** (BUCKET_BITS - MANTISSA) * balance
    return np.maximum(agree - np.minimum(chance, agree), 0) / np.maximum(used, 1)


@cache
def _least_agreeing(percent: int) -> np.ndarray:
    """By registers in use: the most k of which fewer than k agree with a chance of MISS at most, at the threshold.

    Which elements of the union are the smallest of their registers does not depend on which ones are shared.
    The registers that agree are thus draws without replacement, whose far tail is under the binomial one.
    """
    p, row, least = percent / 100, np.ones(1), [0]
    for _ in range(REGISTERS):
        row = np.append(row * (1 - p), 0) + np.append(0, row * p)
        least.append(int(np.searchsorted(np.cumsum(row), MISS, side="right")))
    return np.array(least)


def may_link(agree: np.ndarray, used: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m elements may reach the threshold, by their registers that agree and are in use.

    A set's element that is not shared spoils one register at most. With few elements this alone decides, and no
    pair that reaches the threshold is dropped.
    """
    total = n + m
    apart = total + 2 * (-percent * total // (100 + percent))  # elements not shared, at most
    least = np.maximum(_least_agreeing(percent)[used], used - apart)
    return similarity(agree, used, n, m) * used >= least - 0.5  # by chance less than half a register agrees


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, n_shingles, and for texts with words: set_key (digest of the whole set), bands and regs."""

    def make():
        def one(text: bytes):
            found = np.unique(text_shingles(text.lower(), width))
            if not len(found):
                return 0, None, None, None
            regs = registers(found).astype(np.uint16)
            return len(found), xxhash.xxh3_128_digest(found.tobytes()), band_keys(found), regs.tobytes()

        def work(piece: pa.RecordBatch) -> dict:
            n, keys, bands, regs = zip(*map(one, raw(piece.column("text"))), strict=True)
            return {"doc_id": piece.column("doc_id"), "row": piece.column("row"), "n_shingles": pa.array(n, pa.int64()),
                    "set_key": pa.array(keys, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())),
                    "regs": pa.array(regs, pa.binary())}

        return work

    return by_piece(docs, make, "doc_id long, row long, n_shingles long, set_key binary, bands array<long>, regs binary")


class _Set:
    """A text's shingles as sorted hashes, their registers, and as words once they are asked for."""

    def __init__(self, text: bytes, width: int):
        self.text, self.width = text.lower(), width
        self.hashes = np.unique(text_shingles(self.text, width))
        self.registers = registers(self.hashes).astype(np.uint16)
        self._words: set | None = None

    @property
    def words(self) -> set:
        if self._words is None:
            words = self.text.split()
            self._words = set(zip(*(words[i:] for i in range(self.width)), strict=False)) if len(words) >= self.width else {tuple(words)}
        return self._words

    def may_link(self, other: _Set, percent: int) -> bool:
        x, y = self.registers, other.registers
        n, m = np.array([len(self.hashes)]), np.array([len(other.hashes)])
        return bool(may_link(((x == y) & (x > 0)).sum(keepdims=True), ((x > 0) | (y > 0)).sum(keepdims=True), n, m, percent)[0])

    def linked(self, other: _Set, percent: int) -> bool:
        """Whether the full sets are similar enough: first by their estimate, then on the words themselves."""
        if not self.may_link(other, percent):
            return False
        both = len(self.words & other.words)
        return 100 * both >= percent * (len(self.words) + len(other.words) - both)


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b), one for each a, whose full sets of shingles are similar enough. A text of an ``a`` is
    shuffled once, and one of a ``b`` is not copied before it meets its pairs."""

    def check(batches):
        sets: OrderedDict[bytes, _Set] = OrderedDict()

        def of(text: bytes) -> _Set:
            key = xxhash.xxh3_128_digest(text)
            if key not in sets:
                sets[key] = _Set(text, width)
                if len(sets) > 8:
                    sets.popitem(last=False)
            sets.move_to_end(key)
            return sets[key]

        for piece in pieces(batches, "text_b"):
            good = [of(x).linked(of(y), percent) for x, y in zip(raw(piece.column("text_b")), raw(piece.column("text_a")), strict=True)]
            yield piece.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    side = lambda x: docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long")


class _Joined:
    """Who is already known to belong together, inside one task."""

    def __init__(self, components: np.ndarray):
        self.label = components.copy()

    def apart(self, others: np.ndarray, k: int) -> np.ndarray:
        return others[self.label[others] != self.label[k]]

    def join(self, i: int, k: int) -> None:
        self.label[self.label == self.label[i]] = self.label[k]


def _dealt(members: DataFrame, *carried: str, weight: Column) -> DataFrame:
    """Members of groups (``grp``) cut into blocks by rows and ``weight``, each row once for every two blocks that
    have it. Groups of one block share tasks, so that a task has about as many members as a block."""
    sizes = members.groupBy("grp").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(weight) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    cut = members.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    total = members.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).first()
    packs = F.lit(max(1, -(-total.n // BLOCK), -(-(total.w or 0) // BLOCK_SHINGLES)))
    pack = F.when(F.col("blocks") > 1, F.col("grp")).otherwise(F.pmod(F.xxhash64("grp"), packs))
    return cut.select((F.col("blocks") > 1).alias("cut"), pack.alias("pack"), "grp", F.least("own", "other").alias("i"),
                      F.greatest("own", "other").alias("j"), "own", "rep", "component", *carried).sortWithinPartitions("grp")


def _pairs_of(group):
    """For each group in a task and each member k of it: (rows of the group, positions to compare k with)."""
    grp, own, i, j = group["grp"].to_numpy(), group["own"].to_numpy(), group["i"].iloc[0], group["j"].iloc[0]
    order = np.argsort(grp, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1):
        left, right = np.flatnonzero(own[rows] == i), np.flatnonzero(own[rows] == j)
        yield rows, [(k, left[:at] if i == j else left) for at, k in enumerate(right)]


def _near(regs: np.ndarray, n: np.ndarray, k: int, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``others`` whose estimate does not rule a link with k out, the most alike first."""
    agree = ((regs[others] == regs[k]) & (regs[k] > 0)).sum(1)
    used = ((regs[others] > 0) | (regs[k] > 0)).sum(1)
    near = may_link(agree, used, n[others], n[k], percent)
    return others[near][np.argsort(-agree[near], kind="stable")]


def _estimated(members: DataFrame, percent: int) -> DataFrame:
    """What may still be linked, by registers, in each bucket (``grp``) of members in different components: (rep, rep)
    of each member that has a partner, and component pairs that tie all such components of the bucket together."""

    def compare(group):
        rep, comp, n = (group[c].to_numpy() for c in ("rep", "component", "n_shingles"))
        regs = np.frombuffer(b"".join(group["regs"]), np.uint16).reshape(len(group), REGISTERS)
        found, a, b = set(), [], []
        for rows, pairs in _pairs_of(group):
            own_regs, own_n, own_comp = regs[rows], n[rows], comp[rows]
            joined = _Joined(own_comp)
            for k, others in pairs:
                others = others[own_comp[others] != own_comp[k]]
                if not len(others):
                    continue
                near = _near(own_regs, own_n, k, others, percent)
                if len(near):
                    found.update(rep[rows[near]].tolist(), [int(rep[rows[k]])])
                for other in joined.apart(near, k):
                    if joined.label[other] != joined.label[k]:
                        joined.join(other, k)
                        a.append(own_comp[k])
                        b.append(own_comp[other])
        members_ = np.array(sorted(found), np.int64)
        return type(group)({"a": np.concatenate([members_, np.array(a, np.int64)]), "b": np.concatenate([members_, np.array(b, np.int64)]),
                            "member": np.arange(len(members_) + len(a)) < len(members_)})

    return (_dealt(members, "n_shingles", "regs", weight=F.lit(1)).groupBy("cut", "pack", "i", "j")
            .applyInPandas(compare, "a long, b long, member boolean"))


def _across(members: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a > b) that join members (grp, rep, component, n_shingles, text) of a group that lie in different components.

    Two blocks of a group meet in one task with their full texts. Members are compared by their registers, those whose
    estimate is high enough on their sets, and only links that join two components leave the task: a spanning forest,
    at most one link for a member.
    """

    def compare(group):
        rep, comp, a, b = group["rep"].to_numpy(), group["component"].to_numpy(), [], []
        for rows, pairs in _pairs_of(group):
            sets = [_Set(group["text"].iloc[r].encode(), width) for r in rows]
            regs, n = np.stack([x.registers for x in sets]), np.array([len(x.hashes) for x in sets])
            joined = _Joined(comp[rows])
            for k, others in pairs:
                others = joined.apart(others, k)
                for other in _near(regs, n, k, others, percent) if len(others) else ():
                    if joined.label[other] != joined.label[k] and sets[k].linked(sets[other], percent):
                        joined.join(other, k)
                        x, y = rep[rows[k]], rep[rows[other]]
                        a.append(max(x, y))
                        b.append(min(x, y))
        return type(group)({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return (_dealt(members, "text", weight=F.col("n_shingles")).groupBy("cut", "pack", "i", "j")
            .applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
                    tell_rows: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the smallest doc_id reachable over links of sets whose
    intersection is at least ``percent`` of their union.

    ASCII letters are lower-cased, words are runs without ASCII white space, a set holds the distinct shingles
    of ``width`` words of the whole text, or its word sequence if that is shorter. Texts without words, null
    ones too, are linked with nothing. Equal sets, repeated rows included, meet as one class by their digest
    before any search, so copies are not paired. A row with a null id takes no part and keeps a null
    component; rows that share an id are judged each by its text. Other columns are left out; with ``tell_rows`` a
    column ``row`` follows, the 64-bit hash of the text, which tells rows of one id apart.

    Search: each text is first tried with the smallest member of the buckets that it shares with it most often, one
    pair for a text. Where members of a bucket then still lie in different components, they are compared by their
    registers, in blocks. Components that may be linked after that form groups, whose members meet in blocks with their
    texts, so that no link of a bucket is lost.
    """
    docs = id_text(docs, key, text)
    rows = settle(sketches(docs.withColumn("row", F.xxhash64("text")), width))
    classes = settle(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    bands = classes.select("rep", F.explode("bands").alias("key")).where("key IS NOT NULL")
    shared = (bands.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("most"), F.count("*").alias("n"))
              .where("b < most").drop("most"))
    members = settle(bands.join(shared, "key"))
    stars = members.where("rep <> b").groupBy(F.col("rep").alias("a"), "b").agg(F.count("*").alias("c"))
    primary = settle(stars.groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("b"))).alias("best"))
                     .where(F.col("best.c") >= FIRST_BANDS).select("a", (-F.col("best.b")).alias("b")))
    first = settle(_confirmed(primary, _of_ids(docs, primary), width, percent))
    found = settle(components(first))
    placed = (members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
              .join(primary.select(F.col("a").alias("rep"), F.col("b").alias("tried")), "rep", "left")
              .select("key", "rep", "b", F.coalesce("component", "rep").alias("component"),
                      ((F.col("n") == 2) & F.col("b").eqNullSafe(F.col("tried"))).alias("settled")))
    mixed_keys = (placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("settled").alias("settled"))
                  .where("lo < hi AND NOT settled").select("key"))
    apart = placed.join(mixed_keys, "key").select(F.col("key").alias("grp"), "rep", "component")
    sets = rows.where("n_shingles > 0").join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"]).select(
        F.col("doc_id").alias("rep"), "n_shingles", "regs").dropDuplicates(["rep"])
    likely = settle(_estimated(settle(apart.join(sets, "rep")), percent))
    if not likely.isEmpty():
        # groups are tied by components, so that all members of two that may be linked meet
        groups = components(likely.where("NOT member").select("a", "b")).select(
            F.col("node").alias("component"), F.col("component").alias("grp"))
        open_ = (likely.where("member").select(F.col("a").alias("rep")).distinct()
                 .join(apart.select("rep", "component").distinct(), "rep").join(groups, "component"))
        texts = _of_ids(docs, open_.select(F.col("rep").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("doc_id", "rep")
        open_ = settle(open_.join(texts, "rep").join(classes.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles")), "rep"))
        more = settle(_across(open_, percent, width))
        joined = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = settle(components(joined.unionByName(more)))

    of_set = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component"))
    named = ["row"] if tell_rows else []
    return (rows.select("doc_id", "n_shingles", "set_key", *named).join(of_set, "set_key", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), *named))


def _sieve(keys: DataFrame, *names: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function of (rows, how): with ``left_semi`` the rows whose values of ``names`` may be among those of ``keys``,
    with ``left_anti`` all others, which are not. Rows are not shuffled; a bit for the hash of each key goes to all of
    them, in one broadcast of a bounded size. With more keys than it has bits for, more rows may be among them.
    """
    count = keys.count()
    bits = min(SIEVE_BITS, max(64, 1 << (SIEVE_SHARE * count - 1).bit_length() if count else 64))
    at = F.pmod(F.xxhash64(*names), F.lit(bits))
    word, bit = F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")
    filled = keys.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("held"))
    words = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(filled, "word", "left")
    one = settle(words.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("held", F.lit(0)).alias("held")))).alias("all"))
                 .select(F.col("all.held").alias("held in words")))
    return lambda rows, how: rows.join(F.broadcast(one), F.getbit(F.get("held in words", word.cast("int")), bit) == 1, how)


def _of_ids(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id and text of the rows that the pairs (a, b) name, repeated rows once. Of the others few are shuffled."""
    ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    named = _sieve(ids, "doc_id")(docs, "left_semi").join(ids, "doc_id", "left_semi").withColumn("digest", F.xxhash64("text"))
    return named.dropDuplicates(["doc_id", "digest"]).drop("digest")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` without those that are near duplicates of a document of smaller id.

    Every row is judged by its own text, also where rows share an id: of rows with equal id and equal text one stays,
    and a row does not go for another row of its id. Rows with a null id stay. Columns are as they were.
    """
    judged = (near_duplicates(docs, width, percent, tell_rows=True).where("component_id IS NOT NULL")
              .groupBy("doc_id", "row").agg(F.min("component_id").alias("component"), F.count("*").alias("n"),
                                            F.max("n_shingles").alias("size")))
    found = settle(judged.where("component <> doc_id OR (n > 1 AND size > 0)")
                   .select("doc_id", "row", (F.col("component") != F.col("doc_id")).alias("goes")))
    # the whole row goes as one column, so that its names cannot clash
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("row"),
                        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("whole"))
    sieve = _sieve(found, "doc_id", "row")  # most rows stay without a shuffle
    judged_rows = sieve(named, "left_semi")
    kept = sieve(named, "left_anti").union(judged_rows.join(found, ["doc_id", "row"], "left_anti").select(named.columns)).select("whole")
    again = found.where("NOT goes")
    if not again.isEmpty():
        kept = kept.union(judged_rows.join(again, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("whole"))
    return kept.select("whole.*")
