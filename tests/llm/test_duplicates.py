"""Removal of repeated bytes and words, and groups of near copies, each against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import near_dup, suffixes
from barloom.llm.graph import components
from barloom.llm.near_dup import keep_one, near_duplicates, registers, similarity
from barloom.llm.substrings import RUNS, Windows, local_first, remove_repeats

SCHEMA = "doc_id long, text string, kept string, digest int"


def hand_made():
    """Shared passages at all places, copies, near copies, repeated lines, very long and very short texts."""
    pick = random.Random(11)
    word = lambda: "".join(pick.choice("abcdefghiklmnoprstu") for _ in range(pick.randint(1, 9)))
    prose = lambda n: [word() for _ in range(n)]
    passage, line, base = prose(130), prose(25), prose(200)
    texts: list[str | None] = [None, "", "one", "one two three", " \t\n ", "é" * 500, "é" * 500 + "x"]
    for i in range(12):
        texts.append(" ".join(prose(pick.randint(5, 90)) + passage[i:100 + 2 * i] + prose(pick.randint(0, 60))))
        texts.append("\n".join([" ".join(line)] * pick.randint(1, 4) + [" ".join(prose(40))]))
        near = list(base)
        for _ in range(pick.randint(1, 4)):
            near[pick.randrange(len(near))] = word()
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 3 + ["ab" * 900, "ab" * 850, "z" * 1200, " ".join(prose(9000) + passage)]
    return [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, " ".join(base), "k", 1), (8, texts[8], "k", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hand_made(), SCHEMA).repartition(3)


def bytes_without_repeats(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for row, t in zip(rows, texts, strict=True):
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                covered[i:i + length] = b"\1" * length
        runs = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out.append((row[0], len(t), sum(covered), runs, bytes(b for b, c in zip(t, covered, strict=True) if not c)))
    return Counter(out)


@pytest.mark.parametrize("length,hot", [(400, suffixes.HOT), (400, 2), (200, suffixes.HOT)])
def test_repeated_bytes(docs, length, hot):
    got = suffixes.remove_repeats(docs, length, hot=hot).collect()
    assert Counter((*r[:4], bytes(r[4])) for r in got) == bytes_without_repeats(hand_made(), length)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert suffixes.remove_repeats(none).collect() == []
    assert remove_repeats(none).collect() == []
    assert near_duplicates(none).collect() == []
    assert keep_one(none).collect() == []


def test_anchors_past_one_chunk(monkeypatch):
    pick = np.random.default_rng(3)
    data = pick.integers(97, 101, 30_000).astype(np.uint8)
    ends = np.array([9_000, 9_100, 30_000])
    whole = suffixes.anchors(data, ends, 400)
    monkeypatch.setattr(suffixes, "PLACE_BITS", 12)
    parts = suffixes.anchors(data, ends, 400)
    covers = lambda x: {(a, w) for a, lo, hi in zip(*x[:3], strict=True) for w in range(lo, hi + 1)}
    assert {w for _, w in covers(parts)} == {w for _, w in covers(whole)}
    assert all(a >= w and a + suffixes.PIECE <= w + 400 for a, w in covers(parts) | covers(whole))


def test_merge_gives_sorted_order_and_shared_lengths():
    pick = random.Random(2)
    all_runs, everything = [], []
    for r in range(7):
        run = sorted((bytes(pick.choice(b"ab") for _ in range(pick.randint(0, 40))), b"l", b"d" * 16, r, 0, 1) for _ in range(pick.randint(0, 60)))
        if run:
            all_runs.append(suffixes.front_coded(run))
        everything += run
    got = list(suffixes.merged(all_runs))
    assert [s[0] for _, s in got] == sorted(s[0] for s in everything)
    for (_, a), (shared, b) in zip(got, got[1:], strict=False):
        n = next((i for i, (x, y) in enumerate(zip(a[0], b[0], strict=False)) if x != y), min(len(a[0]), len(b[0])))
        assert shared == n


def words_without_repeats(rows, width):
    seen: dict[tuple, int] = {}
    order = sorted(rows, key=lambda r: 1 << 63 if r[0] is None else r[0])
    firsts = {}
    for r in order:
        w = (r[1] or "").encode().split()
        for i in range(len(w) - width + 1):
            firsts.setdefault(tuple(w[i:i + width]), 1 << 63 if r[0] is None else r[0])
    out = []
    for r in order:
        place = 1 << 63 if r[0] is None else r[0]
        w = (r[1] or "").encode().split()
        covered, own = bytearray(len(w)), set()
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            if k in own or firsts[k] < place:
                covered[i:i + width] = b"\1" * width
            own.add(k)
        out.append((r[0], len(w), sum(covered), b" ".join(x for x, c in zip(w, covered, strict=True) if not c).decode()))
    return Counter(out)


@pytest.mark.parametrize("width", [20, 5])
def test_repeated_words(docs, width):
    assert Counter(map(tuple, remove_repeats(docs, width).collect())) == words_without_repeats(hand_made(), width)


def groups(rows, width, percent):
    """(doc_id, size of set, component) by comparing all pairs."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    at = {r[0]: r[0] for r in rows}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(rows[i][0]), root(rows[j][0])
                at[max(x, y)] = min(x, y)
    return Counter((r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("width,percent", [(4, 80), (5, 80)])
def test_near_copies(docs, width, percent):
    got = near_duplicates(docs, width, percent).collect()
    assert Counter(map(tuple, got)) == groups(hand_made(), width, percent)


@pytest.mark.parametrize("block", [near_dup.BLOCK, 3])
def test_chain_of_near_copies(spark, monkeypatch, block):
    """Each text is near the next one only, and buckets hold texts that are not near their smallest member."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(7))
    text, rows = [word() for _ in range(300)], []
    for i in range(25):
        rows.append((100 - i if i % 2 else i, " ".join(text), "k", 1))
        for _ in range(5):
            text[pick.randrange(300)] = word()
    df = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, near_duplicates(df, 4, 80).collect())) == groups(rows, 4, 80)
    kept = keep_one(df, 4, 80)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in groups(rows, 4, 80) if i == c}


def test_rows_that_share_an_id(spark):
    pick = random.Random(8)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(7))
    a, b = (" ".join(word() for _ in range(60)) for _ in range(2))
    rows = [(1, a, "first", 1), (7, a, "copy", 1), (7, b, "other", 1), (7, b, "other", 1), (9, "", "empty", 1),
            (9, "", "empty", 1), (None, a, "no id", 1), (None, b, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `that id` string, goes int").repartition(3)
    kept = keep_one(df, 5, 80)
    assert kept.columns == df.columns
    assert Counter(r["that id"] for r in kept.collect()) == {"first": 1, "other": 1, "empty": 2, "no id": 2}


def test_words_of_rows_that_share_an_id(spark):
    pick = random.Random(9)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(7))
    a, b, c = (" ".join(word() for _ in range(40)) for _ in range(3))
    rows = [(1, a, "", 1), (3, f"{b} {a}", "", 1), (3, f"{a} {c}", "", 1), (None, f"{c} {b}", "", 1), (None, f"x {b} {c}", "", 1),
            (None, c, "", 1), (None, "y " + c, "", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert Counter(map(tuple, remove_repeats(df, 20).collect())) == words_without_repeats(rows, 20)


def test_windows_are_told_apart_by_their_bytes():
    own = Windows(b" a b\ta b  aa b ", 2)
    assert [own.at(i) for i in range(5)] == [b"a b", b"b a", b"a b", b"b aa", b"aa b"]
    for hashes in (np.zeros(5, np.uint64), np.array([5, 6, 5, 7, 8], np.uint64)):
        assert own.heads(hashes).tolist() == [0, 1, 0, 3, 4]
    assert len({tuple(d) for d in own.digests(np.arange(5)).tolist()}) == 4


@pytest.mark.parametrize("lot", [1, 7, 1000])
def test_lots_settle_what_they_can(lot):
    pick = random.Random(lot)
    found = np.array([(pick.randrange(9), 0, place, place + 50, begin) for place in range(12) for begin in range(6)])
    parts = [local_first(found[i:i + lot].copy()) for i in range(0, len(found), lot)]
    sure = {(int(p), int(s) // RUNS + k) for part in parts for _, _, p, _, s in part for k in range(int(s) % RUNS)}
    left = [(int(d), int(p), int(s) // RUNS) for part in parts for d, _, p, _, s in part if not s % RUNS]
    least = {d: min(p for e, p, _ in left if e == d) for d, _, _ in left}
    want = {(p, b) for d, _, p, _, b in found.tolist() if any(e == d and q < p for e, _, q, _, _ in found.tolist())}
    assert sure | {(p, b) for d, p, b in left if p > least[d]} == want
    assert lot == 1 or sure


def test_estimates_follow_similarity():
    pick = np.random.default_rng(9)
    for share in (0.5, 0.8, 0.95):
        n = 4000
        both = int(n * 2 * share / (1 + share))
        all_ = np.unique(pick.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        pick.shuffle(all_)
        a, b = (registers(np.sort(x)) for x in (all_[:n], all_[n - both:]))
        est = similarity(((a == b) & (a > 0)).sum(), ((a > 0) | (b > 0)).sum(), np.array(n), np.array(n))
        assert abs(est - share) < 0.1125


def test_components(spark):
    pick = random.Random(6)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    links += [(600 + i, 999) for i in range(50)] + [(5, 5)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in want.items() if near[x] != {x}}
