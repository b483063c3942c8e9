"""Benchmark decontamination: CGK embeddings, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words (runs of letters and digits, lower-cased). An item of L words leaks
into a document if some passage lies within k = floor(0.2 * L) word edits of it, similarity 0.8 or more.

1. Windows. A passage within k edits of an item keeps a run of ceil((L - k) / (k + 1)) of its words
   unchanged, so windows of the item's size are opened only where such a run (of 4 words at most) occurs,
   at each start that k edits allow, and only if the region around holds as many pairs and triples of words that stand
   side by side in some item as k edits must leave (an edit takes two pairs and three triples). No leak is lost by this.
2. CGK. A window is walked by a pointer that stays or advances as a random bit of (word, step) says; the
   symbols read are its embedding, of 3L symbols. Walks with the same bits meet again after an edit, so a
   small edit distance becomes a small Hamming distance.
3. LSH. Each repetition samples a few places of one walk; windows and items whose samples agree are
   candidates. The number of repetitions is the least that finds the target share of simulated passages at
   the very threshold (k random edits of each item), measured when the operator is set up.
4. Verification. Edit distance of the item to the best passage of the candidate region, exactly.

What opens a window is a run's hash, its place and the item's length, so the run table has one entry for all items of
one length that share a run there, and a common phrase opens a window once, not once for each item that holds it.
The benchmark is taken in blocks of checked size. The driver builds them one at a time and writes each to the shared
folder, and a task holds one block at a time, so neither's memory grows with the benchmark.
"""

from __future__ import annotations

import logging
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import new_path, trimmed
from ledgerloom.llm.labelled import in_groups

WORD = re.compile(r"\w+")
SIMILARITY = 0.8
RUN = 4
SAMPLES = 3
TARGET_RECALL = 0.999
MOST_REPETITIONS = 96
#: Simulated passages of each kind, to choose the repetitions by and, fresh ones, to confirm the choice: mixed edits,
#: insertions, deletions, replacements.
EDITS = (None, 0, 1, 2)
TUNE_PASSAGES, CONFIRM_PASSAGES = 250, 2000
#: Items are broadcast in blocks of about so many bytes of text; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20
GROUP_CHARS = 8_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def allowed(length: int) -> int:
    """The edits that an item of so many words may take."""
    return int((1 - SIMILARITY) * length + 1e-9)


def run_length(length: int) -> int:
    k = allowed(length)
    return max(1, min(RUN, -(-(length - k) // (k + 1))))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    return h ^ (h >> np.uint64(29))


def gram_hash(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(ids) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = _mix(h * _B + ids[k : len(ids) - n + 1 + k].astype(np.uint64))
    return h


def walk(symbols: np.ndarray, lengths: np.ndarray, repetition: int) -> np.ndarray:
    """Keys of one repetition: a hash of the symbols that the CGK walk over each row reads at that length's places.

    Rows are windows of ``lengths`` words, padded on the right; past its window a walk reads -1.
    """
    rows = np.arange(len(symbols))
    at = np.zeros(len(symbols), dtype=np.int64)
    key = np.uint64(repetition * 1_000_003) + lengths.astype(np.uint64)
    distinct, of = np.unique(lengths, return_inverse=True)
    wanted = np.zeros((len(distinct), 3 * int(distinct.max(initial=1))), dtype=bool)
    for k, n in enumerate(distinct.tolist()):
        wanted[k, places_of(repetition, n)] = True
    last = np.flatnonzero(wanted.any(axis=0)).max(initial=-1)
    bits = np.arange(wanted.shape[1], dtype=np.uint64) * np.uint64(2654435761) + np.uint64(repetition * 97 + 1)
    for step in range(int(last) + 1):
        s = np.where(at < lengths, symbols[rows, np.minimum(at, symbols.shape[1] - 1)], -1).astype(np.uint64)
        if wanted[:, step].any():
            read = wanted[of, step]
            key[read] = _mix(key[read] * _B + s[read] + np.uint64(step))
        at += (((s * _B + bits[step]) * _A) >> np.uint64(63)).astype(np.int64)
    return key


@cache
def places_of(repetition: int, length: int) -> np.ndarray:
    rng = np.random.default_rng((repetition, length))
    return np.sort(rng.choice(3 * length, size=min(SAMPLES, 3 * length), replace=False))


def stacked(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows as one matrix padded with -1, and their lengths."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    out = np.full((len(rows), int(lengths.max())), -1, dtype=np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, lengths


def fitting_distance(item: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least edit distance of ``item`` to any passage of each row of ``regions`` (padded with -1)."""
    width = regions.shape[1]
    slope = np.arange(width + 1)
    row = np.zeros((len(regions), width + 1), dtype=np.int64)
    for k, w in enumerate(item, 1):
        step = np.empty_like(row)
        step[:, 0] = k
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != w), out=step[:, 1:])
        row = np.minimum.accumulate(step - slope, axis=1) + slope
    return row.min(axis=1)


@dataclass
class Index:
    """Items as word numbers, their runs, and their LSH keys."""

    item_ids: list[list[int]]  # the ids of each distinct text
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # by run length: hash, item length, offset; distinct
    grams: dict[int, np.ndarray] = field(default_factory=dict)  # by length, 2 and 3: the hashes of all items' word groups
    repetitions: int = 0
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    key_items: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    simulated_recall: float = 1.0

    @classmethod
    def build(cls, rows: list[tuple[int, str]], target: float = TARGET_RECALL) -> Index:
        by_words: dict[tuple[str, ...], set[int]] = {}
        for item_id, text in rows:
            if w := tuple(words_of(text)):
                by_words.setdefault(w, set()).add(item_id)
        vocabulary: dict[str, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in t], dtype=np.int64) for t in by_words]
        out = cls([sorted(ids) for ids in by_words.values()], items, vocabulary)
        parts: dict[int, list] = {}
        for item in items:
            n = run_length(len(item))
            h = gram_hash(item, n)
            parts.setdefault(n, []).append((h, np.full(len(h), len(item)), np.arange(len(h))))
        for n, p in parts.items():
            h, length, at = map(np.concatenate, zip(*p, strict=True))
            order = np.lexsort((at, length, h))
            h, length, at = h[order], length[order], at[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (length[1:] != length[:-1]) | (at[1:] != at[:-1])]
            out.runs[n] = h[new], length[new], at[new]
        out.grams = {n: np.unique(np.concatenate([gram_hash(i, n) for i in items if len(i) >= n] or [np.zeros(0, np.uint64)])) for n in (2, 3)}
        out._tune(target)
        if items:
            padded, lengths = stacked(items)
            keys = np.concatenate([walk(padded, lengths, r) for r in range(out.repetitions)])
            order = np.argsort(keys, kind="stable")
            out.keys, out.key_items = keys[order], np.tile(np.arange(len(items)), out.repetitions)[order]
        return out

    def _passages(self, rng: np.random.Generator, count: int, edit: int | None) -> tuple[np.ndarray, ...]:
        """Windows of simulated passages with k edits, mixed or of one kind, their lengths, passages and distances from the passage's start; the items and their lengths."""
        items, windows = [], []
        for t in range(count):
            item = self.items[int(rng.integers(len(self.items))) if len(self.items) > count else t % len(self.items)]
            k, text = allowed(len(item)), list(item)
            for _ in range(k):
                at, kind = int(rng.integers(len(text) + 1)), int(rng.integers(3)) if edit is None else edit
                if kind == 0:
                    text.insert(at, 0)
                elif kind == 1 and len(text) > 1:
                    del text[min(at, len(text) - 1)]
                else:
                    text[min(at, len(text) - 1)] = 0
            padded = np.array([0] * k + text + [0] * (len(item) + k), dtype=np.int64)
            items.append(item)
            windows += [padded[start : start + len(item)] for start in range(2 * k + 1)]
        of = np.repeat(np.arange(count), [2 * allowed(len(i)) + 1 for i in items])
        off = np.concatenate([np.abs(np.arange(2 * allowed(len(i)) + 1) - allowed(len(i))) for i in items])
        return *stacked(windows), of, off, *stacked(items)

    def _found(self, passages: tuple, found: np.ndarray, repetitions: range) -> np.ndarray:
        """Which passages some window finds in these repetitions, those found before included; only the others are walked.

        Windows at the passage's start or beside it find most, so the others are walked for what those leave.
        """
        rows, lengths, of, off, targets, target_lengths = passages
        found = found.copy()
        for apart in (off <= 1, off > 1):
            for r in repetitions:
                open_ = np.flatnonzero(~found)
                own = np.flatnonzero(apart & ~found[of])
                if not len(own):
                    break
                place = np.searchsorted(open_, of[own])
                same = walk(rows[own], lengths[own], r) == walk(targets[open_], target_lengths[open_], r)[place]
                found[open_] = np.bincount(place, same, len(open_)) > 0
        return found

    def _tune(self, target: float) -> None:
        """Repetitions until the target share of TUNE_PASSAGES of each kind is found, and of CONFIRM_PASSAGES fresh ones.

        When fresh ones miss the target, repetitions are added, at least one, and others are drawn.
        """
        if not self.items:
            return
        rng = np.random.default_rng(11)
        for kind in EDITS:
            passages = self._passages(rng, TUNE_PASSAGES, kind)
            found = self._found(passages, np.zeros(TUNE_PASSAGES, dtype=bool), range(self.repetitions))
            while self.repetitions < MOST_REPETITIONS and (self.repetitions == 0 or found.mean() < target):
                found = self._found(passages, found, range(self.repetitions, self.repetitions + 1))
                self.repetitions += 1
        hardest = list(EDITS)
        while True:
            recalls = []
            for kind in hardest:
                recalls.append(self._confirmed(rng, kind))
                if recalls[-1] < target:
                    break
            self.simulated_recall = min(recalls)
            if self.simulated_recall >= target:
                return
            if self.repetitions >= MOST_REPETITIONS:
                raise ValueError(f"{MOST_REPETITIONS} repetitions find {self.simulated_recall:.4f} of simulated passages, fewer than {target}")
            hardest.insert(0, hardest.pop(len(recalls) - 1))  # the kind that failed is tried first
            # Misses fall by about one factor a repetition.
            wanted = self.repetitions * np.log(1 - target) / np.log(1 - self.simulated_recall) if 0 < self.simulated_recall < 1 else 0
            self.repetitions = min(MOST_REPETITIONS, max(self.repetitions + 1, int(wanted)))

    def _confirmed(self, rng: np.random.Generator, kind: int | None) -> float:
        """The share of fresh passages that are found, drawn in parts to bound memory."""
        parts = [self._found(self._passages(rng, TUNE_PASSAGES, kind), np.zeros(TUNE_PASSAGES, dtype=bool), range(self.repetitions)) for _ in range(CONFIRM_PASSAGES // TUNE_PASSAGES)]
        return float(np.concatenate(parts).mean())

    def leaks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item number, distance) of each item that leaks into a text, best passage only."""
        none = np.zeros(0, np.int64)
        get = self.vocabulary.get
        ids: list[int] = []
        ends = np.zeros(len(texts) + 1, dtype=np.int64)
        for k, t in enumerate(texts):
            ids += [get(w, 0) for w in WORD.findall(t.lower())]
            ends[k + 1] = len(ids)
        words = np.array(ids, dtype=np.int64)
        opened = []
        for n, (hashes, length, offset) in self.runs.items():
            if len(words) < n:
                continue
            known = words > 0
            at = known[: len(words) - n + 1].copy()
            for k in range(1, n):
                at &= known[k : len(words) - n + 1 + k]
            at = np.flatnonzero(at)
            doc = np.searchsorted(ends, at, side="right") - 1
            inside = at + n <= ends[doc + 1]
            at, doc = at[inside], doc[inside]
            h = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                h = _mix(h * _B + words[at + k].astype(np.uint64))
            low, high = np.searchsorted(hashes, h, side="left"), np.searchsorted(hashes, h, side="right")
            times = high - low
            which = np.repeat(np.arange(len(at)), times)
            entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + low[which]
            opened.append(np.stack([doc[which], length[entry], at[which] - offset[entry]], axis=1))
        if not opened or not len(opened := np.unique(np.concatenate(opened), axis=0)):
            return none, none, none
        hits = []
        opened = opened[self._dense(opened, words, ends)]
        if not len(opened):
            return none, none, none
        limits = np.array([allowed(n) for n in range(int(opened[:, 1].max()) + 1)])[opened[:, 1]]
        shift = np.arange(-int(limits.max()), int(limits.max()) + 1)
        spread = np.abs(shift)[None, :] <= limits[:, None]
        base, at = np.nonzero(spread)
        pairs = np.unique(np.stack([opened[base, 0], opened[base, 1], np.maximum(opened[base, 2] + shift[at], ends[opened[base, 0]])], axis=1), axis=0)
        for at in range(0, len(pairs), 20_000):
            doc, length, start = pairs[at : at + 20_000].T
            place = start[:, None] + np.arange(length.max())
            windows = np.where(place < ends[doc + 1][:, None], words[np.minimum(place, len(words) - 1)], -1)
            for r in range(self.repetitions):
                h = walk(windows, length, r)
                low, high = np.searchsorted(self.keys, h, side="left"), np.searchsorted(self.keys, h, side="right")
                times = high - low
                which = np.repeat(np.arange(len(h)), times)
                entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + low[which]
                hits.append(np.unique(np.stack([self.key_items[entry], doc[which], start[which]], axis=1), axis=0))
        if not hits or not len(hits := np.unique(np.concatenate(hits), axis=0)):
            return none, none, none
        return self._verified(hits, words, ends)

    def _dense(self, opened: np.ndarray, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the windows (text, length, start) have as many of the items' word groups around them as a leak must hold."""
        # Only texts with a window are read, end to end.
        texts, doc = np.unique(opened[:, 0], return_inverse=True)
        sizes = ends[texts + 1] - ends[texts]
        last = np.cumsum(sizes)
        moved = last - sizes - ends[texts]  # from a text's place among all texts to that among those
        words = words[np.arange(last[-1]) - np.repeat(moved, sizes)]
        length, start = opened[:, 1], opened[:, 2] + moved[doc]
        k = np.array([allowed(n) for n in range(int(length.max()) + 1)])[length]
        first, end = (last - sizes)[doc], last[doc]
        low, high = np.clip(start - 2 * k, first, end), np.clip(start + length + 2 * k, first, end)
        out = np.ones(len(opened), dtype=bool)
        for n, hashes in self.grams.items():
            if len(words) < n or not len(hashes):
                continue
            h = gram_hash(words, n)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            total = np.r_[0, np.cumsum(hashes[at] == h)]
            held = total[np.clip(high - n + 1, low, len(h))] - total[np.minimum(low, len(h))]
            out &= held >= length - n + 1 - n * k
        return out

    def _verified(self, hits: np.ndarray, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        for item in np.unique(hits[:, 0]).tolist():
            own, length = hits[hits[:, 0] == item], len(self.items[item])
            k = allowed(length)
            # Starts close to one another belong to one passage and share a region.
            new = np.r_[True, (own[1:, 1] != own[:-1, 1]) | (own[1:, 2] - own[:-1, 2] > k + 1) | (own[1:, 2] // (length + 2 * k) != own[:-1, 2] // (length + 2 * k))]
            first = np.flatnonzero(new)
            doc, low, high = own[first, 1], own[first, 2], own[np.r_[first[1:], len(own)] - 1, 2]
            # A hit may lie k off the passage's start, which takes up to length + k words.
            low, high = np.maximum(low - 2 * k, ends[doc]), np.minimum(high + length + 2 * k, ends[doc + 1])
            for at in range(0, len(doc), 2_000):
                part = slice(at, at + 2_000)
                place = low[part][:, None] + np.arange((high - low)[part].max())
                regions = np.where(place < high[part][:, None], words[np.minimum(place, len(words) - 1)], -1)
                d = fitting_distance(self.items[item], regions)
                good = d <= k
                out.append(np.stack([doc[part][good], np.full(good.sum(), item), d[good]], axis=1))
        found = np.concatenate(out)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        if len(found):
            found = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)]]
        return found[:, 0], found[:, 1], found[:, 2]


class Blocks:
    """The indexes of a benchmark's blocks, each built when it is asked for; the size is checked first, so none outgrows its block by much."""

    def __init__(self, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
        text = F.col("text").cast("string").alias("text")
        self.items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text).where("text is not null and item_id is not null")
        self.count = max(1, -(-(self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[Index]:
        part = F.expr(f"pmod(xxhash64(item_id, text), {self.count})")
        for k in range(self.count):
            yield Index.build([(r.item_id, r.text) for r in self.items.where(part == k).orderBy("item_id", "text").collect()])

    def stored(self) -> list[str]:
        """A file in the shared folder for each block; the driver holds one at a time."""
        folder = new_path(self.items.sparkSession, "benchmark")
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for k, index in enumerate(self):
            logging.getLogger(__name__).info("block %d: %d items, %d repetitions, simulated recall %.4f", k, len(index.items), index.repetitions, index.simulated_recall)
            with store.open_output_stream(f"{root}/{k}") as out:
                pickle.dump(index, out, protocol=5)
        return [f"{folder}/{k}" for k in range(self.count)]


indexes = Blocks


@lru_cache(maxsize=1)
def _block(uri: str) -> Index:
    """A block of the benchmark; the last one stays with the worker."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as stream:
        return pickle.loads(stream.read())


def _found(uris: list[str], texts: list[str]) -> Iterator[tuple[Index, np.ndarray, np.ndarray, np.ndarray]]:
    """What each block finds in the texts, in groups of bounded size: the block, and text, item and distance of each leak."""
    for uri in uris:
        index, at = _block(uri), 0
        for group in in_groups(texts, GROUP_CHARS):
            doc, item, distance = index.leaks(group)
            yield index, doc + at, item, distance
            at += len(group)


def _pairs(uris: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column(0).to_pylist()
            for index, doc, item, distance in _found(uris, b.column(1).to_pylist()):
                rows = [(ids[d], i, len(index.items[k]), e) for d, k, e in zip(doc.tolist(), item.tolist(), distance.tolist(), strict=True) for i in index.item_ids[k]]
                cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.int64()) for c in cols], names=["doc_id", "item_id", "item_words", "edit_distance"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, edit_distance, similarity: each item that leaks into each document.

    Null and empty texts hold nothing; items that are null or have no word leak nowhere; a null doc_id stays
    null. Repeated documents each give their rows; repeated rows of one item count once, and an item_id with
    several texts gives a row for each that leaks. Other columns are ignored; if either table is empty, so
    is the result.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = plain.mapInArrow(trimmed(_pairs(Blocks(benchmark).stored())), "doc_id long, item_id long, item_words long, edit_distance long")
    return found.withColumn("similarity", 1 - F.col("edit_distance") / F.col("item_words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, all columns kept.

    Null and empty texts hold nothing and stay, as do all rows if the benchmark is empty or null; a row goes or stays
    by its text alone, whatever its id, and so do repeated rows. An empty table stays empty.
    """
    at, uris = docs.columns.index("text"), Blocks(benchmark).stored()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = np.ones(b.num_rows, dtype=bool)
            for _, doc, _, _ in _found(uris, b.column(at).fill_null("").to_pylist()):
                keep[doc] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(trimmed(run), docs.schema)
