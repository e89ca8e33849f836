"""Fingerprints, thresholds and links of the SimHash search, against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from barloom.llm import simhash
from barloom.llm.queries import op11_simhash
from barloom.llm.simhash import allot, expected, fingerprint, flips, group_bits, links_within, parts_for, simhash_duplicates, within


def plain(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_reachable(nodes: dict[int, int], distance: int = 2) -> dict[int, int]:
    ids, parent = sorted(nodes), {i: i for i in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (nodes[a] ^ nodes[b]).bit_count() <= distance:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def clustered(n: int, seed: int) -> list[int]:
    """Distinct fingerprints, many of them a few bits from a few centres, and one value within two bits of many."""
    pick = random.Random(seed)
    centres = [pick.getrandbits(64) for _ in range(4)] + [0]
    out = set()
    while len(out) < n:
        x = pick.choice(centres)
        for _ in range(pick.randint(0, 4)):
            x ^= 1 << pick.choice([pick.randrange(64), pick.randrange(8)])
        out.add(x)
    return sorted(out)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "a b c", "a b c a b c a b c", "É é  x y\x0bz",
                                  "w " * 40_000, "\x85 \x1c\x1d q"])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) % (1 << 64) == plain(text)


def test_thresholds_are_the_best():
    costs = np.random.default_rng(1).integers(0, 50, (4, 4, 30)).astype(float)
    costs[:, 0] = 0
    for total in (-2, -1, 0, 3):
        limits, cost = allot(costs, total)
        assert (limits.sum(0) == total).all()
        for i in range(30):
            ways = [w for w in itertools.product(range(-1, 3), repeat=4) if sum(w) == total]
            assert cost[i] == min(sum(costs[g, t + 1, i] for g, t in enumerate(w)) for w in ways)


def test_expected_counts():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 64, 500)
    counts = np.bincount(values, minlength=64)
    shells = within(counts, 2)
    at = expected([np.arange(64)], [shells], 500, 2)
    for r in range(3):
        assert at[r].tolist() == [int((np.bitwise_count(values ^ v) <= r).sum()) for v in range(64)]
    assert len(flips(21, 2)) == 1 + 21 + 210 and len(flips(64, 1)) == 65 and len(set(flips(5, 2).tolist())) == 16


def test_bit_groups_hold_each_bit_once():
    bits = (np.random.default_rng(3).random((300, 64)) < .5).astype(float)
    bits[:, 40] = bits[:, 3]
    for m in (2, 3, 4):
        groups = group_bits(bits.T @ bits, 300, m)
        assert sorted(b for g in groups for b in g) == list(range(64)) and len(groups) == m
        assert any({3, 40} <= set(g) for g in groups)
    assert [parts_for(n) for n in (10, 5 << 20, 1 << 30)] == [4, 3, 2]


@pytest.mark.parametrize("parts,meets", [(4, simhash.MEETS), (3, 200), (2, simhash.MEETS), (4, 60), (4, 0)])
def test_links(spark, parts, meets):
    """Every link once or more and no other, with groups of bits that a third share, and with wide fingerprints."""
    fps = clustered(400, parts)
    rows = spark.createDataFrame([(signed(x), i) for i, x in enumerate(fps)], "fp long, rep long").repartition(3)
    got = [(r.a, r.b) for r in links_within(rows, 2, parts, meets).collect()]
    want = {(a, b) for b, a in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2}
    assert set(got) == want and len(got) == len(want) > 500


def test_components(spark):
    """Repeated rows, null ids and texts, empty ones, near copies; a further column with a clashing name."""
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(400)]
    texts: list[str | None] = [None, "", " ", "one", "One", "one two three four"]
    for i in range(12):
        near = list(base)
        near[17 * i] = word()
        texts.append(" ".join(near))
    rows = [(50 - i, t, i, "x") for i, t in enumerate(texts)] + [(None, texts[6], 1, "x"), (50, None, 1, "x"), (44, texts[6], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component string").repartition(3)
    got = sorted((r.doc_id or -1, r.fp % (1 << 64), r.component_id) for r in simhash_duplicates(docs).collect())
    of = smallest_reachable({r[0]: plain(r[1]) for r in rows if r[0] is not None})
    assert got == sorted((r[0] or -1, plain(r[1]), of.get(r[0])) for r in rows)
    assert simhash_duplicates(docs.limit(0)).collect() == []


def test_query(spark, sf_dir):
    rows = op11_simhash(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: plain(t) for i, t in texts.items()}
    of = smallest_reachable(prints)
    assert sorted(map(tuple, rows)) == sorted((i, f"{prints[i]:016x}", of[i]) for i in texts)
