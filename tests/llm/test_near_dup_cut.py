"""The cut on registers before texts are compared: links of short texts pass, tails are what they are said to be."""

from __future__ import annotations

from math import comb

import numpy as np
import pytest

from barloom.llm import near_dup
from barloom.llm.common import text_shingles, word_hashes
from barloom.llm.near_dup import MISS, REGISTERS, _across, _least_agreeing, band_keys, may_link, near_duplicates, registers, similarity
from barloom.llm.substrings import remove_repeats


@pytest.mark.parametrize("shared,apart", [(4, 1), (8, 2), (12, 3), (40, 10)])
def test_links_of_few_shingles_pass(shared, apart):
    pick = np.random.default_rng(shared)
    for _ in range(20_000 if shared == 4 else 2_000):
        h = pick.integers(0, 1 << 63, shared + apart, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.sort(h[:shared + apart // 2]), np.sort(np.append(h[:shared], h[shared + apart // 2:]))
        x, y = registers(a), registers(b)
        agree, used = ((x == y) & (x > 0)).sum(keepdims=True), ((x > 0) | (y > 0)).sum(keepdims=True)
        assert may_link(agree, used, np.array([len(a)]), np.array([len(b)]), 80).all()


def test_two_collisions_among_five_pass():
    """Three registers in use, two agree: four shared shingles of five can look like this."""
    assert may_link(np.array([2]), np.array([3]), np.array([5]), np.array([4]), 80).all()
    assert not may_link(np.array([1]), np.array([3]), np.array([5]), np.array([4]), 80).any()


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_tails_stay_below_the_miss_chance(percent):
    least = _least_agreeing(percent)
    for total in (100, 300, 1000, 10_000):
        both = -(-percent * total // 100)
        for used in (10, 50, 90, 200, REGISTERS):
            if used <= total:
                tail = sum(comb(both, k) * comb(total - both, used - k) for k in range(least[used])) / comb(total, used)
                assert tail <= MISS


def test_far_pairs_are_dropped():
    assert not may_link(np.array([150]), np.array([256]), np.array([4000]), np.array([4000]), 80).any()


def test_short_near_copies_with_collisions_are_linked(spark):
    """Texts of 8 and 7 words, four of five shingles shared, with registers that show a similarity under 0.6875."""
    pick, rows = np.random.default_rng(5), []
    while len(rows) < 6:
        long = " ".join(f"w{x}" for x in pick.integers(0, 1 << 40, 8))
        short = long.rsplit(" ", 1)[0]
        a, b = (np.unique(text_shingles(t.encode(), 4)) for t in (long, short))
        x, y = registers(a), registers(b)
        est = similarity(((x == y) & (x > 0)).sum(), ((x > 0) | (y > 0)).sum(), np.array(5), np.array(4))
        if est < 0.6875 and any(k is not None and k == m for k, m in zip(band_keys(a), band_keys(b), strict=True)):
            rows += [(len(rows), long), (len(rows) + 1, short)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i - i % 2 for i, _ in rows}


def thue_morse(n: int) -> tuple[str, str]:
    """A word over two letters and its complement; polynomials of both agree modulo 2**64 for any odd base."""
    ones = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones)


@pytest.mark.parametrize("n", [32, 512, 1024, 4096])
def test_words_whose_polynomials_agree_differ(n):
    a, b = (word_hashes(x.encode())[0] for x in thue_morse(n))
    assert a != b


def test_texts_of_such_words_are_not_taken_for_each_other(spark):
    a, b = thue_morse(1024)
    rows = [(1, " ".join([a] * 30)), (2, " ".join([b] * 30)), (3, " ".join([a, b] * 15)), (4, " ".join([b, a] * 15))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 4, 80).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    gone = {r.doc_id: r.n_removed for r in remove_repeats(docs, 20).collect()}
    seen, want = set(), {}
    for i, text in rows:
        words, bad = text.split(), set()
        for at in range(len(words) - 19):
            window = tuple(words[at:at + 20])
            if window in seen:
                bad |= set(range(at, at + 20))
            seen.add(window)
        want[i] = len(bad)
    assert gone == want


@pytest.mark.parametrize("block", [near_dup.BLOCK, 40])
def test_a_group_just_under_the_threshold(spark, monkeypatch, block):
    """Texts of one template whose pairs lie on both sides of the threshold: no link is lost, and what the blocks
    hand on is a forest, not the pairs."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    emitted = []
    monkeypatch.setattr(near_dup, "_across", lambda *a: emitted.append(_across(*a)) or emitted[-1])
    pick = np.random.default_rng(12)
    base = [f"w{x}" for x in pick.integers(0, 1 << 30, 150)]
    texts = []
    for i in range(240):
        words = list(base)
        for at in pick.choice(150, pick.integers(2, 6), replace=False):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 4, 80).collect()}
    sets = [{tuple(t.split()[i:i + 4]) for i in range(147)} for t in texts]
    label, near = list(range(240)), 0
    for a in range(240):
        for b in range(a):
            both = len(sets[a] & sets[b])
            whole = len(sets[a] | sets[b])
            near += 65 * whole <= 100 * both < 80 * whole
            if 100 * both >= 80 * whole and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert near > 2000 and 1 < len(set(label)) < 240
    assert got == dict(enumerate(label))
    blocks = -(-240 // block)
    assert 0 < emitted[0].count() <= 240 * blocks


@pytest.mark.parametrize("most", [64, 1 << 25])
def test_few_rows_pass_the_sieve(spark, monkeypatch, most):
    """All rows that are among the keys pass, in a large sieve few others; what passes and what does not is the whole."""
    monkeypatch.setattr(near_dup, "SIEVE_BITS", most)
    rows = spark.range(20_000).selectExpr("id * 7 as doc_id", "xxhash64(id) as row", "'text' as text")
    rows = rows.union(spark.sql("SELECT CAST(null AS BIGINT), 5L, 'null'"))
    for names, keys in ((["doc_id"], rows.where("doc_id % 100 = 0")), (["doc_id", "row"], rows.where("row % 97 = 0"))):
        sieve = near_dup._sieve(keys, *names)
        passed, held = sieve(rows, "left_semi"), sieve(rows, "left_anti")
        assert passed.columns == rows.columns and "Exchange" not in _without_broadcast(passed)
        assert passed.count() + held.count() == 20_001
        assert held.join(keys, names, "left_semi").count() == 0
        assert most == 64 or passed.count() < 0.2 * 20_000
    nothing = near_dup._sieve(rows.limit(0), "doc_id")
    assert nothing(rows, "left_semi").count() == 0 and nothing(rows, "left_anti").count() == 20_001


def _without_broadcast(df):
    return df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def test_texts_of_few_rows_are_shuffled(spark, monkeypatch):
    """Only rows that may be named meet the ids in a shuffle, and the result does not hang on the sieve's size."""
    docs = spark.createDataFrame([(i if i % 50 else None, f"words of document {i % 190} and {i % 190} more for it {i % 190}", i)
                                  for i in range(200)], "doc_id long, text string, x int")
    got = []
    for most in (64, 1 << 25):
        monkeypatch.setattr(near_dup, "SIEVE_BITS", most)
        got.append(sorted(r.x for r in near_dup.keep_one(docs, 4, 80).collect()))
    judged = {r.doc_id: r.component_id for r in near_duplicates(docs, 4, 80).collect()}
    assert got[0] == got[1] == [i for i in range(200) if i % 50 == 0 or judged[i] == i]
    named = near_dup._of_ids(docs.select("doc_id", "text"), docs.limit(1).selectExpr("11L as a", "12L as b"))
    assert sorted(r.doc_id for r in named.collect()) == [11, 12]
    assert "getbit" in named._jdf.queryExecution().optimizedPlan().toString()
