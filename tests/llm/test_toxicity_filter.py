"""Terms of the toxicity model, its scores by plain sums, and what the filter keeps when nothing speaks against a row."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from barloom.llm import toxicity

ROWS = [(1, "a calm text"), (2, None), (3, "")]


@pytest.mark.parametrize("labels,kept", [([], {1, 2, 3}), ([1] * 40, {2}), ([0] * 40, {1, 2, 3})])
def test_rows_with_nothing_against_them_stay(spark, labels, kept):
    features = toxicity._Lazy()
    model = toxicity.fit([features(b"some text")] * len(labels), np.array(labels))
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert {r.doc_id for r in toxicity.drop_toxic(df, model, 0.3).collect()} == kept


def texts_of_pairs(seed, rows, toxic):
    """Texts of common words with two marks, each there in half of them whatever the other."""
    pick, texts, labels = random.Random(seed), [], []
    for i in range(rows):
        words = [f"w{pick.randrange(400)}" for _ in range(30)]
        one, other = i % 4 in (0, 1), i % 4 in (0, 2)
        words += ["insulting"] * one + ["groupname"] * other
        pick.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(float(toxic(one, other)))
    return [toxicity._Lazy()(t) for t in texts], texts, np.array(labels)


@pytest.mark.parametrize("toxic", [lambda a, b: a == b, lambda a, b: a != b])
def test_pairs_of_which_neither_tells_alone(toxic):
    found, texts, labels = texts_of_pairs(8, 1200, toxic)
    score = toxicity.make_score(toxicity.fit(found[:900], labels[:900]))
    right = [(score(t) >= 0.5) == bool(y) for t, y in zip(texts[900:], labels[900:], strict=True)]
    assert np.mean(right) > 0.97


@pytest.mark.parametrize("block,rows", [(1024, 2048), (37, 50)])
def test_pairs_against_plain_sums(monkeypatch, block, rows):
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", block)
    monkeypatch.setattr(toxicity, "PAIR_ROWS", rows)
    monkeypatch.setattr(toxicity, "LEAST", -10.0)  # so that chance pairs are found too
    found, _, labels = texts_of_pairs(5, 300, lambda a, b: a == b)
    have = np.bincount(np.concatenate(found), minlength=toxicity.BINS).astype(float)
    bins = [b for b in np.flatnonzero(have) if 0.01 <= have[b] / 300 <= 0.99]
    x = np.array([[float(b in set(f.tolist())) for b in bins] for f in found])
    x -= x.mean(0)
    want, y = set(), labels - labels.mean()
    for i in range(len(bins)):
        for j in range(i):
            chance = 300 * y.var() * x[:, i].var() * x[:, j].var()
            if chance >= 1 and (y * x[:, i] * x[:, j]).sum() ** 2 >= (4 * math.log(len(bins)) - 10) * chance:
                want |= {bins[i], bins[j]}
    assert 2 < len(want) < len(bins)
    assert toxicity._pairs(found, labels, have).tolist() == sorted(want)


def test_score_is_the_sum_over_terms_and_pairs():
    found, texts, labels = texts_of_pairs(3, 200, lambda a, b: a and b)
    model = toxicity.fit(found, labels)
    bias, n, _ = np.frombuffer(model, np.float64, 3)
    n, k = int(n), toxicity.FACTORS
    bins = np.frombuffer(model, np.int64, n, 24).tolist()
    w, v = np.frombuffer(model, np.float64, n, 24 + 8 * n), np.frombuffer(model, np.float64, n * k, 24 + 16 * n).reshape(n, k)
    score = toxicity.make_score(model)
    for f, t in zip(found[:20], texts[:20], strict=True):
        at = [bins.index(b) for b in f.tolist() if b in bins]
        z = bias + sum(w[i] for i in at) + sum(float(v[i] @ v[j]) for i in at for j in at if i < j)
        assert abs(score(t) - 1 / (1 + math.exp(-z))) < 1e-9


def test_constant_terms_and_pairs_that_add_nothing():
    """A term of every row pairs with none; of two terms that exclude each other, the pair adds nothing to each alone."""
    labels = np.array([0.0, 1.0] * 25)
    bins = [np.array([1, 2 + i % 2], np.int32) for i in range(50)]
    have = np.bincount(np.concatenate(bins), minlength=toxicity.BINS).astype(float)
    assert toxicity._pairs(bins, labels, have).tolist() == []
    assert toxicity.telling(bins, labels).tolist() == [2, 3]
    assert toxicity.telling([np.array([1], np.int32)] * 50, labels).tolist() == []
