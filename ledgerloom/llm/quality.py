"""Quality: logistic regression on hashed word n-grams, fitted with follow-the-regularised-leader updates.

The stream of a text's tokens holds its words (lower-cased) and its runs of punctuation; a token that
repeats the one before it, or a word that repeats the token two before it, becomes a mark of its own, so
runs of one word look alike whatever the word.
Features are hashed counts of the stream's unigrams and bigrams over the square root of its length.
The score is the logistic function of a sparse dot product with the learned weights.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ledgerloom.llm.labelled import scored, training_sample

TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS = 20
#: Rows of either class that the fit may use, and the longest text among them.
PER_CLASS = 2500
MAX_TRAIN_CHARS = 30_000
FIXED = float(1 << 32)
REPEAT = np.uint64(zlib.crc32(b"\0repeat"))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts end to end, and how many each text has (twice its tokens, less one)."""
    known: dict[str, int] = {}
    ids: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        tokens = TOKEN.findall(t.lower())
        counts[k] = len(tokens)
        ids += [known.setdefault(w, len(known)) for w in tokens]
    token_hash = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in known], dtype=np.uint64)
    at = np.array(ids, dtype=np.int64)
    h = token_hash[at]
    text = np.repeat(np.arange(len(texts)), counts)
    inner = np.r_[False, text[1:] == text[:-1]] if len(h) else np.zeros(0, bool)
    if len(h) > 2:
        word = np.array([w[0].isalnum() for w in known])[at]
        again = inner & np.r_[False, at[1:] == at[:-1]]
        again[2:] |= word[2:] & (text[2:] == text[:-2]) & (at[2:] == at[:-2])
        h = np.where(again, REPEAT, h)
    mix = np.uint64(0x9E3779B97F4A7C15)
    one = h * mix >> np.uint64(64 - BITS)
    pairs = ((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * mix >> np.uint64(64 - BITS))[inner[1:]]
    order = np.argsort(np.r_[text, text[1:][inner[1:]]], kind="stable") if len(h) else np.zeros(0, np.int64)
    return np.r_[one, pairs].astype(np.int64)[order], counts + np.maximum(counts - 1, 0)


@dataclass
class Quality:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        f, counts = features(texts)
        # Sums of fixed-point numbers are exact, so a score depends on its text alone, not on the texts beside it.
        total = np.r_[0, np.cumsum(np.rint(self.weights.astype(np.float64)[f] * FIXED).astype(np.int64))]
        end = np.cumsum(counts)
        z = (total[end] - total[end - counts]) / FIXED / np.sqrt(np.maximum(counts, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(texts: list[str], y: np.ndarray, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 1.0, seed: int = 7) -> Quality:
    """FTRL-proximal, one text at a time in a fixed shuffled order; weights are rebuilt lazily from z and n."""
    if len(set(y.tolist())) < 2:
        return Quality(np.zeros(1 << BITS, np.float32), 20.0 if len(y) and y[0] == 1 else -20.0)
    f, counts = features(texts)
    end = np.cumsum(counts)
    rows = []
    for k in range(len(texts)):
        at, times = np.unique(f[end[k] - counts[k] : end[k]], return_counts=True)
        rows.append((np.r_[at, 1 << BITS], np.r_[times / np.sqrt(max(counts[k], 1)), 1.0]))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at) -> np.ndarray:
        over = np.abs(z[at]) > l1
        return np.where(over, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(texts)):
            at, x = rows[k]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -50, 50))) - y[k]) * x
            sigma = (np.sqrt(n[at] + g**2) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g**2
    w = weights(slice(None))
    return Quality(w[:-1].astype(np.float32), float(w[-1]))


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_TRAIN_CHARS) -> Quality:
    return fit(*training_sample(docs, labels, "quality", per_class, max_chars))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score in [0, 1] and predicted for every row of ``docs``.

    Null and empty texts score the model's bias alone. Repeated rows each get the same score. A null
    doc_id counts as held out. Without usable labels every score is 0. Other columns of either table are
    ignored; empty tables give empty results.
    """
    return scored(docs, train_quality(docs, labels).score, threshold)
