"""Toxicity: a factorisation machine over hashed terms, which also weighs pairs of terms in one text.

The machine sees every term that tells about the label by itself and every term of a pair that tells together, so also
pairs of terms of which neither tells alone. How many they are follows from the sample.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WordHashes
from barloom.llm.labelled import SAMPLE_ROWS, fitted, labelled_sample, scored, sigmoid, terms

BINS = 1 << 20
#: Bytes of a word's beginning that make a term of their own, for words that are built from a stem.
STEM_BYTES = 4
#: Chi-square from which a term tells by itself, and how much more than the largest of that many by chance a pair needs.
LEAST = 15.0
#: Pairs are looked at among terms that at least this share of the sample has, and at least this share has not.
PAIR_SHARE = 0.01
#: Terms of a block of pairs, and rows that are spread out at once for it.
PAIR_BLOCK, PAIR_ROWS = 1024, 2048
FACTORS, EPOCHS, RATE, L2 = 8, 12, 0.1, 1e-4


class TermBins(WordHashes):
    """Word to two bins in one number: that of the word and that of its stem."""

    BOUND = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        stem = word[:STEM_BYTES]
        both = (xxhash.xxh3_64_intdigest(word) % BINS) << 32 | xxhash.xxh3_64_intdigest(stem, 1) % BINS
        if len(word) <= 64:
            self[word] = both
        return both


class _Lazy:
    """Bins of texts; the words seen are kept for one task, as a worker outlives it and lends its memory to others."""

    def __init__(self):
        self.made: TermBins | None = None

    def __call__(self, text: bytes) -> np.ndarray:
        """Distinct bins of a text's words and stems."""
        if self.made is None:
            self.made = TermBins()
        both = self.made.of(list(set(terms(text))))
        return np.unique(np.concatenate([both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)])).astype(np.int32)


def _singles(found: list[np.ndarray], labels: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Bins whose presence goes with the label, by chi-square."""
    total, ones, hits = len(labels), labels.sum(), np.zeros(BINS)
    for bins, y in zip(found, labels, strict=True):
        if y:
            hits[bins] += 1
    want = have * ones / total
    spread = want * (1 - ones / total) * (1 - have / total)
    chi = np.divide((hits - want) ** 2, spread, out=np.zeros(BINS), where=spread > 0)
    return np.flatnonzero(chi >= LEAST)


def _pairs(found: list[np.ndarray], labels: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Bins of pairs that go with the label together, whatever each does alone.

    For every pair the sum over rows of (label - mean) (a - mean) (b - mean), squared over its variance by chance.
    Pairs for which that variance is less than one row are left alone: nothing can be told from them.
    """
    total = len(labels)
    share = have / total
    terms_ = np.flatnonzero((share >= PAIR_SHARE) & (share <= 1 - PAIR_SHARE))
    place, off = np.full(BINS, -1), (labels - labels.mean()).astype(np.float32)
    place[terms_] = np.arange(len(terms_))
    own = [(at := place[f])[at >= 0] for f in found]
    least = LEAST + 4 * np.log(max(len(terms_), 1))
    var, tell = share[terms_] * (1 - share[terms_]), np.zeros(len(terms_), bool)
    blocks = range(0, len(terms_), PAIR_BLOCK)
    for i in blocks:
        for j in blocks[i // PAIR_BLOCK:]:
            sums = 0.0
            for r in range(0, total, PAIR_ROWS):
                x = [_spread(own[r:r + PAIR_ROWS], first, share[terms_][first:first + PAIR_BLOCK]) for first in (i, j)]
                sums = sums + (x[0] * off[r:r + PAIR_ROWS, None]).T @ x[1]
            chance = total * labels.var() * np.outer(var[i:i + PAIR_BLOCK], var[j:j + PAIR_BLOCK])
            both = (chance >= 1) & (sums**2 >= least * chance)
            if i == j:
                np.fill_diagonal(both, False)
            tell[i:i + PAIR_BLOCK] |= both.any(1)
            tell[j:j + PAIR_BLOCK] |= both.any(0)
    return terms_[tell]


def _spread(own: list[np.ndarray], first: int, share: np.ndarray) -> np.ndarray:
    """Presence less its mean, rows by the terms of a block."""
    x = np.tile(-share.astype(np.float32), (len(own), 1))
    rows = np.repeat(np.arange(len(own)), [len(at) for at in own])
    at = np.concatenate(own) - first if own else np.empty(0, np.int64)
    inside = (at >= 0) & (at < len(share))
    x[rows[inside], at[inside]] += 1
    return x


def telling(found: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Bins that tell about the label over all rows of the sample: by themselves, or as one of a pair."""
    if not 0 < labels.sum() < len(labels):
        return np.empty(0, np.int64)
    have = np.zeros(BINS)
    for bins in found:
        have[bins] += 1
    return np.union1d(_singles(found, labels, have), _pairs(found, labels, have))


def fit(found: list[np.ndarray], labels: np.ndarray) -> bytes:
    """Adaptive gradient steps on the logistic loss. Without both labels the model has no terms."""
    bins = telling(found, labels)
    place = np.full(BINS, -1)
    place[bins] = np.arange(len(bins))
    rng = np.random.default_rng(11)
    w, v, bias = np.zeros(len(bins)), rng.normal(0, 0.05, (len(bins), FACTORS)), 0.0
    gw, gv, gb = np.full(len(bins), 1e-6), np.full(v.shape, 1e-6), 1e-6
    examples = [(at := place[f])[at >= 0] for f in found]
    for _ in range(EPOCHS):
        for at, y in zip(examples, labels, strict=True):
            va = v[at]
            s = va.sum(axis=0)
            err = sigmoid(bias + w[at].sum() + 0.5 * ((s * s).sum() - (va * va).sum())) - y
            gb += err * err
            bias -= RATE * err / np.sqrt(gb)
            if not len(at):
                continue
            d = err + L2 * w[at]
            gw[at] += d * d
            w[at] -= RATE * d / np.sqrt(gw[at])
            d = err * (s - va) + L2 * va
            gv[at] += d * d
            v[at] -= RATE * d / np.sqrt(gv[at])
    head = np.array([bias, len(bins), len(labels)], np.float64).tobytes()
    return head + bins.astype(np.int64).tobytes() + w.tobytes() + v.tobytes()


def make_score(model: bytes):
    bias, n, _ = np.frombuffer(model, np.float64, 3)
    n = int(n)
    bins = np.frombuffer(model, np.int64, n, 24)
    w = np.frombuffer(model, np.float64, n, 24 + 8 * n)
    v = np.frombuffer(model, np.float64, n * FACTORS, 24 + 16 * n).reshape(n, FACTORS)
    place = np.full(BINS, -1, np.int32)
    place[bins] = np.arange(n)
    features = _Lazy()

    def score(text: bytes) -> float:
        at = place[features(text)]
        at = at[at >= 0]
        va = v[at]
        s = va.sum(axis=0)
        return float(sigmoid(bias + w[at].sum() + 0.5 * ((s * s).sum() - (va * va).sum())))

    return score


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", rows: int = SAMPLE_ROWS) -> bytes:
    """A model of the terms that tell, alone or in pairs, learned from at most ``rows`` labelled texts for which ``usable`` holds."""
    return fitted(labelled_sample(docs, labels, label, usable, rows), _Lazy(), fit)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, score): probability that a text is toxic, for every row, from its whole text and nothing else.

    Null and empty texts get the intercept's probability, repeated rows a row each, null keys stay null, an
    empty table gives an empty one, other columns are left out. One pass without a shuffle.
    """
    return scored(docs, model, make_score)


def drop_toxic(docs: DataFrame, model: bytes, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose score is below ``threshold``; columns as they were.

    Null texts stay, and all rows stay if the model was trained on no row: nothing speaks against them.
    """
    if not np.frombuffer(model, np.float64, 3)[2]:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept: dict[int, object] = {}

    @F.pandas_udf("double")
    def toxic(texts):
        if 0 not in kept:
            kept[0] = make_score(shared.value)
        return texts.map(lambda x: kept[0]((x or "").encode()))

    return docs.where(docs["text"].isNull() | (toxic(docs["text"].cast("string")) < threshold))
