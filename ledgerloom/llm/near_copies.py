"""Near copies of whole texts: links of operator 9 and what they miss, each checked for its exact similarity.

A 64-bit SimHash within 3 bits finds only a part of the pairs of similarity 0.8 (on five-word shingles) and links
others far below it. So SimHash links are candidates here beside MinHash bands of the five-word shingles, and a pair
counts only if the shingle sets of both texts have a Jaccard similarity of 0.8 or more:

1. Texts with equal shingle sets collapse to one node, so exact copies never multiply.
2. Candidates are nodes that SimHash links (``simhash.links``: pivot distance tables) or that share one of ``BANDS``
   bands of ``ROWS`` minima: a pair at 0.8 shares one with probability 0.9996, one at 0.85 with more than 0.99999.
3. The least node of each bucket is checked against its others, and SimHash's links are checked. What that joins is one
   component.
4. Buckets whose nodes still lie in different components are dealt into tiles of bounded size, with the texts. All
   pairs of a tile that lie in different components are checked there, those of larger tiles by one matrix product of
   nodes and shingles; a tile returns what spans the components it joins, never its pairs. Nothing is left out: a pair
   within one component would change nothing.

A check streams the nodes that are compared with one hub behind the hub's text, which is hashed once; a hub of many
nodes is dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, saved, trimmed
from ledgerloom.llm.components import components
from ledgerloom.llm.simhash import by_tile, fingerprint, keep_least, plain, representatives, settled, tiled
from ledgerloom.llm.simhash import links as simhash_links

SHINGLE = 5
#: Similarity as a fraction, so that the test is exact.
NEAR = (4, 5)
BANDS, ROWS = 20, 5
HASH_SEED = 42
CHUNK = 256
#: A tile holds about so many nodes, or bytes of text, at most (but a node at least).
TILE, TILE_BYTES = 512, 8 << 20
#: Tiles of more nodes are compared by a matrix product, so many shingles at a time.
FEW, COLUMNS = 16, 2048
#: Nodes that one task compares with a hub.
HUB_ROWS = 256
_RNG = np.random.default_rng(5)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct XXH64 of a text's five-word shingles, sorted; of all its words if they are fewer, none if there are none."""
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII whitespace only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(s), HASH_SEED) for s in zip(*(words[k:] for k in range(SHINGLE)), strict=False)], dtype=np.uint64))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    over, under = NEAR
    if min(len(a), len(b)) * under < max(len(a), len(b)) * over:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * under >= (len(a) + len(b) - both) * over


def minima(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), CHUNK):
        h = own[at : at + CHUNK, None] * _A
        h += _B
        np.minimum(least, h.min(axis=0), out=least)
    return least


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of minima; texts without words have none."""
    if not len(own):
        return np.zeros(0, np.uint64)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(minima(own).reshape(BANDS, ROWS))], dtype=np.uint64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_rows
        nodes, fps, keys, ends = np.zeros(n, np.uint64), np.zeros(n, np.uint64), [np.zeros(0, np.uint64)], np.zeros(n + 1, np.int32)
        for k, t in enumerate(b.column(1)):
            text = t.as_py()
            own = shingles(text)
            nodes[k], fps[k] = xxhash.xxh64_intdigest(own.tobytes(), HASH_SEED), fingerprint(text)[0]
            keys.append(bands(own))
            ends[k + 1] = ends[k] + len(keys[-1])
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), lists], names=["doc_id", "key", "node", "fp", "bands"])


def _check_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of the nodes v that are near the hub u; the hub's own row comes before those of its nodes."""
    here, own = None, None
    for b in batches:
        us, vs, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        good = []
        for k, (u, v) in enumerate(zip(us, vs, strict=True)):
            if v is None:
                here, own = u, shingles(texts[k].as_py())
            elif u == here and near(own, shingles(texts[k].as_py())):
                good.append(k)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).take(pa.array(good, type=pa.int32()))


def joined_roots(roots: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): pairs of roots that span what near pairs among the nodes join; roots and shingles of each node."""
    _, label = np.unique(roots, return_inverse=True)
    parent = list(range(int(label.max(initial=-1)) + 1))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    if len(roots) <= FEW:
        pairs = ((i, j) for i in range(len(sets)) for j in range(i) if find(label[i]) != find(label[j]) and near(sets[i], sets[j]))
    else:
        pairs = zip(*_near_pairs(sets), strict=True)
    u, v = [], []
    first = {int(k): r for k, r in zip(label, roots, strict=True)}
    for i, j in pairs:
        a, b = find(int(label[i])), find(int(label[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            u.append(first[int(label[i])])
            v.append(first[int(label[j])])
    return np.array(u, dtype=np.int64), np.array(v, dtype=np.int64)


def _near_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All near pairs (i > j), by the products of the rows of a matrix of nodes and shingles; those of one node alone are left out of it."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(n), sizes), times[column] > 1
    row, column = row[often], (np.cumsum(times > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), dtype=np.float32)  # counts below 2^24 are exact
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((n, COLUMNS), dtype=np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part @ part.T
    i, j = np.nonzero(np.tril(both * NEAR[1] >= (sizes[:, None] + sizes[None, :] - both) * NEAR[0], -1))
    return i, j


def _across_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): pairs of roots that span the components joined within each (bucket, tile); rows come sorted by them."""
    here, roots, sets = None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        if len(set(roots)) > 1:
            u, v = joined_roots(np.array(roots, dtype=np.int64), sets)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        keys, texts = zip(*(b.column(c).to_pylist() for c in range(3)), strict=True), b.column(3)
        for k, (bucket, tile, root) in enumerate(keys):
            if (bucket, tile) != here:
                yield from close()
                here, roots, sets = (bucket, tile), [], []
            roots.append(root)
            sets.append(shingles(texts[k].as_py()))
    yield from close()


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are near by their exact similarity; ``texts`` has a row for each node. A saved table."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = saved(pairs.groupBy("u").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("parts")).where("parts > 1"), "near-hubs")
    dealt = pairs.join(large, "u", "left").select("u", "v", F.expr("coalesce(cast(pmod(xxhash64(v), parts) as int), 0)").alias("part"))
    dealt = saved(dealt, "near-dealt")
    nodes = dealt.join(texts.withColumnRenamed("node", "v").hint("merge"), "v").select("u", "part", "v", "text")
    hubs = dealt.select("u", "part").distinct().join(texts.withColumnRenamed("node", "u").hint("merge"), "u").select("u", "part", F.lit(None).cast("long").alias("v"), "text")
    rows = hubs.unionByName(nodes).repartition(n, "u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    out = saved(rows.select("u", "v", "text").mapInArrow(trimmed(_check_batches), "u long, v long"), "near")
    discard(large, dealt)
    return out


def _texts(reps: DataFrame, texts: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, text, bytes): for each of the nodes ``ends`` the text of its representative. A saved table."""
    one = reps.join(ends, "node", "left_semi").select("node", F.col("first.key").alias("k"), F.col("first.doc_id").alias("d"))
    found = texts.join(one.hint("merge"), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return saved(found.select("node", "text").dropDuplicates(["node"]).withColumn("bytes", F.octet_length("text").cast("long")), "near-texts")


def _candidates(sketches: DataFrame, buckets: DataFrame) -> DataFrame:
    """(u, v), u < v: the least node of each bucket with its others, and what SimHash links; a saved table."""
    of_fp = saved(sketches.groupBy("fp", "node").count().select("fp", "node"), "near-fp")
    least = saved(of_fp.groupBy("fp").agg(F.min("node").alias("hub")), "near-fp-hubs")
    alike = of_fp.join(least.hint("merge"), "fp").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    linked = simhash_links(least.select("fp", F.array("fp").alias("fps")))
    end = lambda f, name: least.select(F.col("fp").alias(f), F.col("hub").alias(name)).hint("merge")
    close = linked.withColumnRenamed("u", "f").withColumnRenamed("v", "g").join(end("f", "u"), "f").join(end("g", "v"), "g").select("u", "v")
    stars = buckets.select(F.col("hub").alias("u"), F.col("node").alias("v")).unionByName(alike).unionByName(close)
    stars = saved(stars.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-stars")
    discard(of_fp, least, linked)
    return stars


def _across(buckets: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): links between components that near pairs of one bucket join; a saved table."""
    joined = saved(buckets.join(roots.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "near-joined")
    split = saved(joined.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket"), "near-split")
    left = saved(joined.join(split.hint("merge"), "bucket").join(texts.select("node", "bytes").hint("merge"), "node").select("bucket", "node", "root", "bytes"), "near-open")
    load = left.groupBy("bucket").agg(F.greatest(F.count("*") / TILE, F.sum("bytes") / TILE_BYTES).alias("load")).where("load > 1")
    parts = saved(load.select("bucket", F.ceil(F.col("load") * 2).cast("int").alias("parts")), "near-parts")
    tiles = tiled(left.drop("bytes"), parts, "node").join(texts.select("node", "text").hint("merge"), "node").select("bucket", "tile", "root", "text")
    out = saved(by_tile(tiles).mapInArrow(trimmed(_across_batches), "u long, v long").distinct(), "near-across")
    discard(joined, split, left, parts)
    return out


def clusters(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches of the documents (doc_id, key, node), and what ``settled`` says of their nodes; saved tables.

    Null, empty and blank texts are copies of one another; rows without an id are documents like any other, and
    repeated rows each have a sketch. Other columns are ignored; an empty table gives empty ones.
    """
    sketches = saved(plain(docs).mapInArrow(trimmed(_sketch_batches), "doc_id long, key long, node long, fp long, bands array<long>"), "sketches")
    each = saved(sketches.select("node", F.explode("bands").alias("bucket")).distinct(), "near-each")
    shared = saved(each.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "near-shared")
    buckets = saved(each.join(shared.hint("merge"), "bucket").select("bucket", "node", "hub"), "near-buckets")
    discard(each, shared)
    stars, reps = _candidates(sketches, buckets), representatives(sketches, "node")
    texts = _texts(reps, plain(docs), stars.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    found = _checked(stars, texts)
    roots = components(found)
    more = _across(buckets, roots, texts)
    if more.limit(1).count():
        discard(roots)
        roots = components(found.unionByName(more))
    out = settled(reps, roots, "node")
    discard(buckets, stars, reps, texts, found, roots, more)
    return sketches, out


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the least doc_id joined to it by near copies; a row for each of ``docs``.

    A component without any doc_id has a null id; see ``clusters`` for the rest.
    """
    sketches, nodes = clusters(docs)
    return sketches.join(nodes.select("node", F.col("least.doc_id").alias("component_id")).hint("merge"), "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when each set of near copies keeps its least doc_id; all columns (see ``keep_least``)."""
    sketches, nodes = clusters(docs)
    out = keep_least(docs, nodes, sketches)
    discard(sketches, nodes)
    return out
