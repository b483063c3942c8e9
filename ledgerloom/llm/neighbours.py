"""Nearest neighbours by vantage-point trees, one per shard.

A vantage-point tree fitted on a bounded sample routes every vector to a cell; the sample grows with the table up to
SAMPLE_BYTES, which gives cells of about one shard up to about 5e8 vectors of 64 dimensions. A cell of too many
vectors (a hot one, say copies of one vector) is dealt into several shards by hash. Each query starts with a
radius that is sure to hold enough neighbours, its k-th distance within the sample, and goes to the shards of
all cells that the triangle inequality does not rule out. There a tree over the shard's vectors is searched
for a block of queries at once.

Pruning is relaxed by ``factor``: a subtree is skipped if the lower bound of its distances times the factor
exceeds the query's radius. Factor 1 skips only what cannot matter, so the search is exact; larger factors
skip more, and queries that they leave with too few neighbours are searched again at factor 1.
Distances that count are always computed on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import saved, trimmed

FACTOR = 1.25
NEIGHBOURS = 10
#: Vectors that the starting radius is taken from, and the least that the routing tree is fitted on.
SAMPLE = 4096
#: The routing tree is fitted on so many vectors a cell, as far as the sample's bytes allow; fewer than CELL_LEAST end its growth.
CELL_SAMPLE, CELL_LEAST = 16, 4
SAMPLE_BYTES = 64 << 20
#: Numbers in a block of vectors that are compared at once: bounds memory at any dimension.
BLOCK_NUMBERS = 1 << 21
SHARD_ROWS = 8192
QUERY_BLOCK = 2048
LEAF = 128


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part: an id, and finite components that are not all zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    return rows.where("vec_id is not null and embedding is not null").where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances between rows of both, or of the one to the other, in blocks of bounded size."""
    out, step = np.empty(len(points)), max(1, BLOCK_NUMBERS // max(1, points.shape[1]))
    for at in range(0, len(points), step):
        other = to if to.ndim == 1 else to[at : at + step]
        out[at : at + step] = np.sqrt(((points[at : at + step] - other) ** 2).sum(axis=1))
    return out


class Router:
    """The top of the tree, fitted on a sample: heap-ordered vantage points and radii for one vector length."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, depth: int, k: int):
        self.k = k
        self.depth = max(0, min(depth, int(log2(max(len(sample) / CELL_LEAST, 1)))))
        n = (1 << self.depth) - 1
        points, self.radii = np.zeros(n, dtype=np.int64), np.zeros(n)
        held = {0: np.arange(len(sample))}
        for node in range(n):
            own = held.pop(node)
            if len(own) < 2:  # nothing to divide: one side gets all
                points[node], self.radii[node] = own[0] if len(own) else 0, np.inf
                held[2 * node + 1], held[2 * node + 2] = own, own[:0]
                continue
            far = own[np.argmax(_distances(sample[own], sample[own[0]]))]
            points[node] = far
            d = _distances(sample[own], sample[far])
            self.radii[node] = np.median(d)
            inner = d <= self.radii[node]
            if inner.all():
                inner = np.arange(len(own)) < len(own) // 2
            held[2 * node + 1], held[2 * node + 2] = own[inner], own[~inner]
        self.points = sample[points] if n else np.zeros((0, sample.shape[1]))
        self.ids, self.sample = ids[:SAMPLE], sample[:SAMPLE]
        self.squares = (self.sample**2).sum(axis=1)

    def cells(self, v: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(v), dtype=np.int64), max(1, BLOCK_NUMBERS // max(1, v.shape[1]))
        for at in range(0, len(v), step):
            part = v[at : at + step]
            node = np.zeros(len(part), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (_distances(part, self.points[node]) > self.radii[node])
            out[at : at + step] = node - len(self.radii)
        return out

    def radius(self, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
        """An upper bound, by no more than rounding, of the k-th distance to vectors of the sample but the query's own; infinite if they are too few."""
        out, step = np.full(len(v), np.inf), 256
        if len(self.sample) < self.k:
            return out
        for at in range(0, len(v), step):
            part = v[at : at + step]
            squares = (part**2).sum(axis=1)
            d = self.squares[None, :] + squares[:, None] - 2 * part @ self.sample.T
            d[ids[at : at + step, None] == self.ids[None, :]] = np.inf
            slack = 1e-9 * (self.squares.max() + squares)
            out[at : at + step] = np.sqrt(np.maximum(np.partition(d, self.k - 1, axis=1)[:, self.k - 1], 0) + slack)
        return out

    def visits(self, v: np.ndarray, radius: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query number, cell) of each cell whose lower bound times factor is within the radius; only such subtrees are entered."""
        who, node, bound = np.arange(len(v)), np.zeros(len(v), dtype=np.int64), np.zeros(len(v))
        for _ in range(self.depth):
            gap = np.empty(len(who))
            step = max(1, BLOCK_NUMBERS // max(1, v.shape[1]))
            for at in range(0, len(who), step):
                gap[at : at + step] = _distances(v[who[at : at + step]], self.points[node[at : at + step]])
            gap -= self.radii[node]
            inner, outer = np.maximum(bound, gap), np.maximum(bound, -gap)
            go_in, go_out = inner * factor <= radius[who], outer * factor <= radius[who]
            who, node, bound = np.r_[who[go_in], who[go_out]], np.r_[2 * node[go_in] + 1, 2 * node[go_out] + 2], np.r_[inner[go_in], outer[go_out]]
        return who, node - len(self.radii)


class Tree:
    """A vantage-point tree over one shard, searched for many queries at once."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], v[order]
        self.squares = (self.v**2).sum(axis=1)
        self.root = self._grow(np.arange(len(v)))

    def _grow(self, own: np.ndarray):
        if len(own) <= LEAF:
            return own
        d = _distances(self.v[own], self.v[own[np.argmax(_distances(self.v[own], self.v[own[0]]))]])
        point, radius = self.v[own[np.argmin(d)]], np.median(d)
        inner = d <= radius
        if inner.all():  # equal vectors, or as good as: no radius tells them apart
            return own
        return point, radius, self._grow(own[inner]), self._grow(own[~inner])

    def search(self, ids: np.ndarray, q: np.ndarray, radius: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vector id, distance): up to k nearest of each query within its radius."""
        self.q, self.own, self.k, self.factor = q, ids, k, factor
        self.q_squares = (q**2).sum(axis=1)
        self.radius = radius.copy()
        self.best: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self._visit(self.root, np.arange(len(q)))
        return self.best

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            for at in range(0, len(node), 4096):
                self._scan(node[at : at + 4096], who)
            return
        point, r, inner, outer = node
        gap = _distances(self.q[who], point) - r
        near = gap <= 0
        self._visit(inner, who[near])
        self._visit(outer, who[~near])
        gap_out, gap_in = -gap[near] * self.factor, gap[~near] * self.factor
        self._visit(outer, who[near][gap_out <= self.radius[who[near]]])
        self._visit(inner, who[~near][gap_in <= self.radius[who[~near]]])

    def _scan(self, rows: np.ndarray, who: np.ndarray) -> None:
        rough = self.squares[rows][None, :] + self.q_squares[who][:, None] - 2 * self.q[who] @ self.v[rows].T
        slack = 1e-9 * (self.squares[rows].max() + self.q_squares[who])
        i, j = np.nonzero(rough <= (self.radius[who] ** 2 + slack)[:, None])
        w, x = who[i], rows[j]
        other = self.ids[x] != self.own[w]
        w, x = w[other], x[other]
        d, step = np.empty(len(w)), max(1, BLOCK_NUMBERS // max(1, self.v.shape[1]))
        for at in range(0, len(w), step):
            d[at : at + step] = _distances(self.v[x[at : at + step]], self.q[w[at : at + step]])
        inside = d <= self.radius[w]
        if not inside.any():
            return
        w, x, d = (np.concatenate([a, b]) for a, b in zip(self.best, (w[inside], self.ids[x[inside]], d[inside]), strict=True))
        order = np.lexsort((x, d, w))
        w, x, d = w[order], x[order], d[order]
        start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        rank = np.arange(len(w)) - np.repeat(start, np.diff(np.r_[start, len(w)]))
        kept = rank < self.k
        self.best = w[kept], x[kept], d[kept]
        last = rank == self.k - 1
        self.radius[w[last]] = np.minimum(self.radius[w[last]], d[last])


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each vector length in the batch."""
    sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield n, rows, b.column(1).take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), n)


def nearest(vectors: DataFrame, query_filter, k: int = NEIGHBOURS, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row that passes ``query_filter``.

    Candidates are all rows but those with the query's own id; rank follows distance, ties the smaller vec_id.
    Fewer candidates give fewer rows. Rows whose vector is null, empty, all zero or holds null or non-finite
    components, and rows without an id, take no part. Vectors of different lengths are not compared. Of
    repeated query rows one counts (that of the least vector); repeated candidates each count. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = usable(vectors)
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    depth = ceil(log2(max(1, n / shard_rows)))
    size = max(SAMPLE, min(CELL_SAMPLE << depth, SAMPLE_BYTES // (8 * longest)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow().combine_chunks().to_batches()
    routers = {m: Router(b.column(0).to_numpy()[at], v, depth, k) for b in sample for m, at, v in _by_length(b)}

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cells = np.zeros(b.num_rows, dtype=np.int64)
            for m, at, v in _by_length(b):
                cells[at] = (m << 32) + (routers[m].cells(v) if m in routers else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells)], names=["vec_id", "embedding", "cell"])

    placed = rows.mapInArrow(trimmed(place), "vec_id long, embedding array<double>, cell long")
    queries = rows.where(query_filter).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def run(queries: DataFrame, factor: float) -> DataFrame:
        def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for m, at, v in _by_length(b):
                    ids = b.column(0).take(pa.array(at)).to_numpy()
                    if m in routers:
                        radius = routers[m].radius(ids, v)
                        who, cell = routers[m].visits(v, radius, factor)
                    else:
                        radius, who, cell = np.full(len(v), np.inf), np.arange(len(v)), np.zeros(len(v), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who]), b.column(1).take(pa.array(at[who])), pa.array((m << 32) + cell), pa.array(radius[who])], names=["vec_id", "embedding", "cell", "radius"])

        sent = queries.mapInArrow(trimmed(send), "vec_id long, embedding array<double>, cell long, radius double")

        # How many shards a cell needs, and how many blocks its queries: a row per cell.
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * shard_rows)).cast("int").alias("parts"))
        blocks = sent.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        layout = saved(parts.join(blocks, "cell"), "cells")
        salt = lambda of, seed: F.expr(f"cast(pmod(xxhash64(vec_id, {seed}), {of}) as int)")
        upto = lambda of: F.explode(F.expr(f"sequence(0, {of} - 1)"))
        left = placed.join(layout, "cell").withColumn("part", salt("parts", 1)).withColumn("block", upto("blocks")).select("cell", "part", "block", "vec_id", "embedding")
        right = sent.join(layout, "cell").withColumn("block", salt("blocks", 2)).withColumn("part", upto("parts")).select("cell", "part", "block", "vec_id", "embedding", "radius")

        def search(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(shard) or not len(asked):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            tree = Tree(shard["vec_id"].to_numpy(), np.stack(shard["embedding"].to_numpy()))
            ids = asked["vec_id"].to_numpy()
            who, found, d = tree.search(ids, np.stack(asked["embedding"].to_numpy()), asked["radius"].to_numpy(), k, factor)
            return pd.DataFrame({"query_id": ids[who], "vec_id": found, "score": d})

        keys = ["cell", "part", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")

    found = run(queries, factor)
    if factor > 1:
        # The starting radius holds k vectors, but pruning may skip some of them: queries left short are searched exactly.
        found = saved(found, "neighbours")
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        short = saved(queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"), "short-queries")
        if short.limit(1).count():
            again = short.select(F.col("vec_id").alias("query_id"))
            found = found.join(again, "query_id", "left_anti").unionByName(run(short, 1.0))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
