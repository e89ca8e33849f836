"""Quality: logistic regression on hashed word n-grams, learned with follow-the-regularised-leader steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from barloom.llm.common import WordHashes, rolled
from barloom.llm.labelled import SAMPLE_ROWS, fitted, labelled_sample, scored, sigmoid, terms

#: Bins of the hashing trick; the model is this many 32-bit weights and an intercept.
BINS = 1 << 18
ORDERS = (1, 2)
#: Bins that repeats share with whatever hashes there.
REPEATS = 100
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.5


def make_features():
    hashes = WordHashes()

    def features(text: bytes) -> np.ndarray:
        h = hashes.of(terms(text))
        grams = [rolled(h, n) % np.uint64(BINS) for n in ORDERS]
        # a term that comes again at once, or after one other, is an n-gram of its own whatever the term is
        again = [np.full((h[d:] == h[:-d]).sum(), REPEATS + d, np.uint64) for d in (1, 2)]
        return np.concatenate(grams + again).astype(np.int32)

    return features


class _Lazy:
    """Features of a process, set up at first use, so that tasks do not ship a memory of words."""

    made = None

    def __call__(self, text: bytes) -> np.ndarray:
        if _Lazy.made is None:
            _Lazy.made = make_features()
        return _Lazy.made(text)


def sparse(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins and their damped counts, of length one."""
    at, n = np.unique(bins, return_counts=True)
    x = 1.0 + np.log(n)
    return at, x / np.sqrt((x * x).sum()) if len(x) else x


def fit(found: list[np.ndarray], labels: np.ndarray) -> bytes:
    """FTRL-proximal with per-coordinate rates. The last place of each array is the intercept, which is not
    penalised. Without rows all weights are 0."""
    z, n, w = np.zeros(BINS + 1), np.zeros(BINS + 1), np.zeros(BINS + 1)
    examples = [sparse(bins) for bins in found]
    for _ in range(EPOCHS):
        for (at, x), y in zip(examples, labels, strict=True):
            at, x = np.append(at, BINS), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            kept = np.abs(zi) > L1
            kept[-1] = True
            step = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
            step[-1] = -zi[-1] / ((BETA + np.sqrt(ni[-1])) / ALPHA)
            wi = np.where(kept, step, 0.0)
            g = (sigmoid(wi @ x) - y) * x
            moved = ni + g * g
            z[at] = zi + g - (np.sqrt(moved) - np.sqrt(ni)) / ALPHA * wi
            n[at] = moved
    body = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) > L1] = body[np.abs(z) > L1]
    w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
    return w.astype(np.float32).tobytes()


def make_score(model: bytes):
    w = np.frombuffer(model, np.float32).astype(np.float64)
    features = _Lazy()

    def score(text: bytes) -> float:
        at, x = sparse(features(text))
        return float(sigmoid(w[at] @ x + w[-1]))

    return score


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> bytes:
    """Weights learned from at most ``rows`` labelled texts for which ``usable`` (a condition on labels) holds."""
    return fitted(labelled_sample(docs, labels, label, usable, rows), _Lazy(), fit)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, score): probability of label 1 for every row, from its whole text and nothing else.

    Null and empty texts get the intercept's probability, repeated rows a row each, null keys stay null, an
    empty table gives an empty one, other columns are left out. One pass without a shuffle.
    """
    return scored(docs, model, make_score)
