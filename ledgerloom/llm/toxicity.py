"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (3 to 5, with ``<`` and ``>`` at its
ends) and of itself, so a misspelt or inflected word that was never seen shares most of its vectors
with the known one. A window of words is the mean of its words; a linear softmax over that mean gives
the window's class. A text scores as its worst window, so that a few toxic lines in a very long text
are not averaged away.

The fit goes in rounds over windows. In the first, a spread of windows of each training text carries the
text's label. In the later ones each toxic text counts as its worst window only, while clean texts give
their worst window and another spread. Subwords seen in fewer than MIN_TEXTS texts keep a zero vector.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import trimmed
from ledgerloom.llm.labelled import in_groups, scored, training_sample

WORD = re.compile(r"\w+")
#: A longer run of letters is read in overlapping pieces of about a word's length, so that each n-gram lies in one.
MAX_WORD = 40
PIECE, OVERLAP = 12, 4
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 4
WINDOW, STRIDE = 8, 4
#: Windows of each text in a round of the fit, and the texts a subword must occur in to be learnt.
SPREAD = 16
MIN_TEXTS = 4
#: Rows of either class that the fit may use, and the longest text among them.
PER_CLASS = 1500
MAX_TRAIN_CHARS = 20_000
FIXED = float(1 << 32)
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The words of a text; pieces of a run longer than MAX_WORD count as words each."""
    out: list[str] = []
    for w in WORD.findall(text.lower()):
        if len(w) <= MAX_WORD:
            out.append(w)
        else:
            out += [w[at : at + PIECE] for at in range(0, len(w) - OVERLAP, PIECE - OVERLAP)]
    return out


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word ids of all texts end to end, the number of words of each text, and the distinct words."""
    known: dict[str, int] = {}
    ids: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        words = words_of(t)
        counts[k] = len(words)
        ids += [known.setdefault(w, len(known)) for w in words]
    return np.array(ids, dtype=np.int64), counts, list(known)


def subwords(words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each subword, by word."""
    parts = [_subwords(words[at : at + step], at) for at in range(0, len(words), step)] or [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _subwords(words: list[str], number: int) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(f"<{w}>" for w in words)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # characters to the word's end
    first = np.cumsum(lengths) - lengths
    place = (np.arange(len(chars)) - first[owner] + 1).astype(np.uint64)
    whole = np.add.reduceat(chars * place**np.uint64(3) * _P, first)
    owners, hashes = [np.arange(len(words))], [whole]
    rolling = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolling = rolling[: len(chars) - n + 1] * _P + chars[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            at = np.flatnonzero(left[: len(rolling)] >= n)
            owners.append(owner[at])
            hashes.append(rolling[at])
    owners, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owners, kind="stable")
    bucket = ((h ^ (h >> np.uint64(29))) * _P >> np.uint64(40)) % np.uint64(BUCKETS)
    return (owners[order] + number).astype(np.int32), bucket[order].astype(np.int32)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, end) of each window; a text without words has none."""
    ends = np.cumsum(counts)
    starts = ends - counts
    per = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(counts)), per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = starts[text] + np.minimum(k * STRIDE, np.maximum(counts[text] - WINDOW, 0))
    return text, begin, np.minimum(begin + WINDOW, ends[text])


@dataclass
class Toxicity:
    """What scoring needs: each bucket's share in the log odds of class 1, and their bias."""

    odds: np.ndarray
    bias: float

    def word_values(self, words: list[str]) -> np.ndarray:
        owner, bucket = subwords(words)
        return np.bincount(owner, self.odds[bucket], len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)

    def score(self, texts: list[str]) -> np.ndarray:
        ids, counts, words = split(texts)
        z = np.full(len(texts), -np.inf)
        if len(ids):
            # Sums of fixed-point numbers are exact, so a score depends on its text alone, not on the texts beside it.
            total = np.r_[0, np.cumsum(np.rint(self.word_values(words) * FIXED).astype(np.int64)[ids])]
            text, a, b = windows(counts)
            np.maximum.at(z, text, (total[b] - total[a]) / (b - a) / FIXED)
        z = np.where(np.isfinite(z), z, 0.0) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _mean(values: np.ndarray, row: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sparse mean: out[r] = sum of weight * values[at] over entries of row r."""
    return np.stack([np.bincount(row, weight * values[at, d], n) for d in range(values.shape[1])], axis=1)


def fit(texts: list[str], y: np.ndarray, rounds: int = 5, steps: int = 30, rate: float = 0.1, decay: float = 1e-6, seed: int = 7) -> Toxicity:
    """Adam on the class-balanced log loss; with no texts of one class, every text scores that of the other (none at all: 0)."""
    if len(set(y.tolist())) < 2:
        return Toxicity(np.zeros(BUCKETS, np.float32), 20.0 if len(y) and y[0] == 1 else -20.0)
    rng = np.random.default_rng(seed)
    ids, counts, words = split(texts)
    text, a, b = windows(counts)
    e, u, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    params = [e, u, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def spread() -> np.ndarray:
        """SPREAD random windows of each text, or all it has."""
        order = np.lexsort((rng.random(len(text)), text))
        start = np.flatnonzero(np.r_[True, text[order][1:] != text[order][:-1]])
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
        return order[rank < SPREAD]

    seen = np.unique(np.repeat(np.arange(len(texts)), counts) * len(words) + ids)
    owner, bucket = subwords(words)
    texts_of_word = np.bincount(seen % len(words), minlength=len(words))
    often = np.bincount(bucket, texts_of_word[owner], BUCKETS) >= MIN_TEXTS
    e[~often] = 0
    size = np.bincount(owner, minlength=len(words))
    first_entry = np.cumsum(size) - size
    step = 0
    for r in range(rounds):
        if r:
            odds = e @ (u[:, 1] - u[:, 0])
            total = np.r_[0, np.cumsum((np.bincount(owner, odds[bucket], len(words)) / size)[ids])]
            z = (total[b] - total[a]) / (b - a)
            order = np.lexsort((-z, text))
            worst = order[np.r_[True, text[order][1:] != text[order][:-1]]]
            some = spread()
            kept = np.unique(np.r_[worst, some[y[text[some]] == 0]])
        else:
            kept = spread()
        target = y[text[kept]]
        n = b[kept] - a[kept]
        row = np.repeat(np.arange(len(kept)), n)
        local, word = np.unique(ids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[kept][row]], return_inverse=True)
        of = np.repeat(np.arange(len(local)), size[local])
        at = bucket[np.arange(len(of)) - np.repeat(np.cumsum(size[local]) - size[local], size[local]) + first_entry[local][of]]
        known = often[at]
        of, at = of[known], at[known]
        used, at = np.unique(at, return_inverse=True)
        share, weight = 1 / size[local][of], 1 / n[row]
        balance = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum()))[:, None]
        for _ in range(steps):
            step += 1
            bags = _mean(_mean(e[used], of, at, share, len(local)), row, word, weight, len(kept))
            z = bags @ u + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(kept)), target] -= 1
            p *= balance
            grown = np.zeros_like(e)
            grown[used] = _mean(_mean(p @ u.T, word, row, weight, len(local)), at, of, share, len(used)) + decay * e[used]
            for param, g, m, v in zip(params, (grown, bags.T @ p, p.sum(axis=0)), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Toxicity((e @ (u[:, 1] - u[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_TRAIN_CHARS) -> Toxicity:
    return fit(*training_sample(docs, labels, "toxic", per_class, max_chars))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score in [0, 1] and predicted for every row of ``docs``.

    Null and empty texts, and texts without a word, score the model's bias alone. Repeated rows each get
    the same score. A null doc_id counts as held out. Without usable labels every score is 0. Other
    columns of either table are ignored; empty tables give empty results.
    """
    return scored(docs, train_toxicity(docs, labels).score, threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept; the fit and the scores are those of ``toxicity``.

    So null, empty and wordless texts go by the model's bias, repeated rows share one decision, and without usable
    labels every row stays. A row goes or stays by its text alone, whatever its id. An empty table stays empty.
    """
    model, at = train_toxicity(docs, labels), docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            scores = [model.score(g) for g in in_groups(b.column(at).fill_null("").to_pylist())]
            yield b.filter(pa.array(np.concatenate(scores) < threshold)) if scores else b

    return docs.mapInArrow(trimmed(run), docs.schema)
