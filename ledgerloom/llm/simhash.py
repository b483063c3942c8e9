"""SimHash near-duplicates, linked through pivot distance tables.

Pairs at Hamming distance 3 or less are found without comparing all pairs:

1. Equal fingerprints collapse to one row first, so exact copies never multiply.
2. Five bit blocks: two fingerprints that differ in at most 3 bits agree on at least two blocks, so
   they share one of ten two-block keys (25 or 26 bits). Nothing within range is missed.
3. Inside a key's group, each fingerprint has a row of Hamming distances to reference fingerprints
   (pivots). By the triangle inequality |d(x,p) - d(y,p)| <= d(x,y), so a pair whose largest coordinate
   difference exceeds 3 is discarded; survivors are verified by XOR and bit count.
4. Groups are counted first (partial sums). One of more than ``TILE`` fingerprints is dealt into tiles, each of
   two salted parts and so of bounded size, before any of its rows are brought together. Groups and tiles return a
   spanning forest of their links, never all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, fresh, row_hash, saved, trimmed
from ledgerloom.llm.components import components

MAX_BITS = 3
SHINGLE = 3
HASH_SEED = 42
BLOCKS = (13, 13, 13, 13, 12)
TILE = 2048
CHUNK = 1 << 16
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Reference fingerprints: XXH64 of their number, so about half of all bits differ between any two.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, HASH_SEED) for i in range(24)], dtype=np.uint64)


def fingerprint(text: bytes | None, family: int = 1) -> np.ndarray:
    """Unsigned 64-bit fingerprints of a UTF-8 text; null, empty and blank texts give 0.

    The first comes from the shingles' XXH64; the others of the family from that hash mixed with their number.
    """
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII whitespace only
    if not words:
        return np.zeros(family, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    votes, total = np.zeros((family, 64), dtype=np.int64), 0
    last = max(1, len(words) - SHINGLE + 1)
    for at in range(0, last, CHUNK):
        part = words[at : min(at + CHUNK, last) + SHINGLE - 1]
        shingles = zip(part, part[1:], part[2:], strict=False) if len(words) >= SHINGLE else [part]
        h = np.array([digest(b" ".join(s), HASH_SEED) for s in shingles], dtype="<u8")
        total += len(h)
        for k in range(family):
            if k:
                h = (h ^ (h >> np.uint64(31))) * _MIX + np.uint64(k)
                h ^= h >> np.uint64(29)
            votes[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > total, axis=1, bitorder="little").view("<u8")[:, 0]


def _fingerprint_batches(family: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.concatenate([fingerprint(t.as_py(), family) for t in b.column(1)]) if b.num_rows else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fps) + 1, family, dtype=np.int32)), pa.array(fps.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists], names=["doc_id", "key", "fps"])

    return run


def plain(docs: DataFrame) -> DataFrame:
    """doc_id, text (UTF-8; null: empty) and key, the text's hash: (doc_id, key) tells rows apart but for repeated ones."""
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def fingerprints(docs: DataFrame, family: int = 1) -> DataFrame:
    """(doc_id, key, fps, fp): one row per document, its fingerprints as signed longs and the first of them."""
    return plain(docs).mapInArrow(trimmed(_fingerprint_batches(family)), "doc_id long, key long, fps array<long>").withColumn("fp", F.col("fps")[0])


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of i and j; label holds each row's root, the least row of its set."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def link_rows(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row, root row) among rows of one group within MAX_BITS; rows of a group stand together."""
    n = len(fp)
    label = np.arange(n)
    away = np.bitwise_count(fp[None, :] ^ PIVOTS[:, None]).astype(np.int8)
    left = np.arange(n)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for k in range(1, n):
        left = left[left + k < n]
        left = left[group[left] == group[left + k]]
        if not len(left):
            break
        i = left
        for p in range(len(PIVOTS)):
            i = i[np.abs(away[p][i] - away[p][i + k]) <= MAX_BITS]
            if not len(i):
                break
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= MAX_BITS]
        if len(i):
            held.append((i, i + k))
            waiting += len(i)
        if waiting > 200_000:
            _hook(label, *map(np.concatenate, zip(*held, strict=True)))
            held, waiting = [], 0
    if held:
        _hook(label, *map(np.concatenate, zip(*held, strict=True)))
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _spanning(key: list[np.ndarray], fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of nodes whose fingerprints are near within groups of equal keys; rows of a group stand together."""
    new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in key])]
    rows, roots = link_rows(fp.view(np.uint64), np.cumsum(new))
    return node[rows], node[roots]


def _tile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) within each (bucket, tile); rows come sorted by them, and a tile that a batch cuts off waits for the next one."""
    rest = [np.zeros(0, np.int64)] * 4

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        u, v = _spanning(cols[:2], cols[2], cols[3])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        cols = [np.concatenate([r, b.column(c).to_numpy(zero_copy_only=False)]) for c, r in enumerate(rest)]
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        start = len(last) - int(last[::-1].argmin()) if not last.all() else 0
        rest = [c[start:] for c in cols]
        if start:
            yield links([c[:start] for c in cols])
    if len(rest[0]):
        yield links(rest)


def _bucket_keys(seed, fp) -> F.Column:
    blocks, at = [], 0
    for bits in BLOCKS:
        blocks.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1)))
        at += bits
    pairs = [(a, b) for a in range(len(BLOCKS)) for b in range(a + 1, len(BLOCKS))]
    table = lambda k: F.shiftleft((seed * len(pairs) + k).cast("long"), 40)
    return F.array(*[table(k) + F.shiftleft(blocks[a], 20) + blocks[b] for k, (a, b) in enumerate(pairs)])


def tiled(rows: DataFrame, parts: DataFrame, node: str) -> DataFrame:
    """``rows`` with a tile of their bucket each; ``parts`` has bucket and parts of the buckets that are dealt into more than one.

    A row goes to the tiles of its part with each part, so any two rows of a bucket meet in a tile; buckets without
    parts are one tile. ``parts`` is a saved table, so a hot bucket's rows are split among tasks while they are joined.
    """
    if not parts.limit(1).count():
        return rows.withColumn("tile", F.lit(0).cast("long"))
    columns = rows.columns
    rows = rows.join(parts, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64({node}), parts) as int)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return rows.select(*columns, F.expr("cast(least(salt, other) as long) * 4294967296 + greatest(salt, other)").alias("tile"))


def by_tile(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "bucket", "tile").sortWithinPartitions("bucket", "tile")


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): links that span each set of nodes joined by steps of MAX_BITS or fewer in one of their fingerprints; a saved table.

    Input: fp, the node, and fps, its fingerprints; distinct rows.
    """
    each = saved(nodes.select(F.col("fp").alias("node"), F.posexplode("fps").alias("seed", "fp")).distinct(), "nodes")
    dealt = each.select(F.explode(_bucket_keys(F.col("seed"), F.col("fp"))).alias("bucket"), "fp", "node")
    large = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    parts = saved(large.select("bucket", F.ceil(F.col("n") / (TILE // 2)).cast("int").alias("parts")), "large-buckets")
    tiles = by_tile(tiled(dealt, parts, "node").select("bucket", "tile", "fp", "node"))
    out = saved(tiles.mapInArrow(trimmed(_tile_batches), "u long, v long"), "links")
    discard(each, parts)
    return out


def representatives(rows: DataFrame, node: str) -> DataFrame:
    """``node`` and first, the least (none, doc_id, key) of its documents, null ids last; a saved table."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    return saved(rows.groupBy(node).agg(first), "representatives")


def settled(reps: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``node``, first and least, the least ``first`` of its component; ``roots`` are those of ``components``. A saved table.

    All this is done with a row per node. Documents join it once, in the order they were read, so the many documents
    of one node come from many tasks and can be split among others.
    """
    each = saved(reps.join(roots.withColumnRenamed("node", node).hint("merge"), node, "left").select(node, F.coalesce("root", node).alias("root"), "first"), "rooted")
    least = saved(each.groupBy("root").agg(F.min("first").alias("least")), "least-of-root")
    out = saved(each.join(least.hint("merge"), "root").select(node, "first", "least"), "settled")
    discard(each, least)
    return out


def clusters(docs: DataFrame, family: int = 1) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of the documents, and what ``settled`` says of them; saved tables."""
    fps = saved(fingerprints(docs, family), "fingerprints")
    linked = links(fps.select("fp", "fps").distinct())
    stars = components(linked)
    reps = representatives(fps, "fp")
    out = settled(reps, stars, "fp")
    discard(linked, stars, reps)
    return fps, out


def simhash_components(docs: DataFrame, family: int = 1) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id joined by links, its own included).

    With a larger ``family`` documents have that many fingerprints and a link in any of them counts, which
    finds more of the near copies whose fingerprints differ in a few more bits by chance.

    Nulls: a null text counts as empty (fingerprint 0, linked like any other); a row with a null doc_id
    has a component too, whose id is the least non-null doc_id in it, or null if there is none. Repeated
    rows each return a row. Other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    fps, nodes = clusters(docs, family)
    named = fps.join(nodes.select("fp", F.col("least.doc_id").alias("component_id")).hint("merge"), "fp")
    out = saved(named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "components")
    discard(fps, nodes)
    return out


def one_of_each(docs: DataFrame, family: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay when each component of ``simhash_components`` keeps one document (see ``keep_least``)."""
    fps, nodes = clusters(docs, family)
    out = keep_least(docs, nodes, fps)
    discard(fps, nodes)
    return out


def keep_least(docs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of ``nodes`` (see ``settled``): that of the least doc_id, null last, and of
    the least text hash among its rows; all columns. ``rows`` has the doc_id and key of each document.

    Wholly repeated rows count once. Null and empty texts are texts like any other here, and rows without an id a
    document each. No column name of ``docs`` clashes; an empty table gives an empty one.
    """
    doc, key, again, row = fresh(docs, "kept_id", "kept_key", "again", "row")
    kept = nodes.where(F.col("first") == F.col("least")).select(F.col("first.doc_id").alias(doc), F.col("first.key").alias(key))
    several = rows.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1").withColumn(again, F.lit(True))
    kept = kept.join(several, F.col(doc).eqNullSafe(F.col("d")) & (F.col(key) == F.col("k")), "left")
    kept = saved(kept.select(doc, key, F.coalesce(again, F.lit(False)).alias(again)), "kept")
    own = F.xxhash64(F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")))
    stay = docs.join(kept.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (own == F.col(key)))  # one plan at every size
    if not kept.where(again).limit(1).count():
        return stay.select(*docs.columns)
    least_row = F.min_by(F.struct(*docs.columns), row_hash(docs)).alias(row)
    one = stay.where(F.col(again)).groupBy(doc, key).agg(least_row).select(f"{row}.*")
    return stay.where(~F.col(again)).select(*docs.columns).unionByName(one)
