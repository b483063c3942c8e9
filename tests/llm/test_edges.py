"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns, for every operator and stage."""

import random
import time

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import decontaminate, mixing, neighbours, quality, queries, simhash, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["copies", "taken", "row", "kept_id", "kept_key", "key", "root", "number", "whole", "taken_words", "_id", "_words", "_size", "score", "fp", "size", "n", "part", "h", "done", "node", "bands", "edit_distance"]
LONG = "lorem ipsum dolor " * 120_000


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int").selectExpr("*", "1 - toxic AS quality").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark passage of some twenty words that none of the other texts hold in any order at all here"), (2, None), (None, "x y z"), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def odd_rows():
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 80)))
    rows = [(i, text(), "en", rng.choice(["a", "b", None]), 1) for i in range(40)]
    return rows + [(None, text(), None, None, None), (None, rows[3][1], "en", "a", 1), (None, None, None, None, None), (50, None, "en", "a", 0), (51, "", "en", "b", 0), (52, LONG, "en", "a", 1), rows[5], rows[5], (5, text(), "en", "b", 1)]


def clashing(df):
    return df.selectExpr("*", *[f"'c{k}' AS `{c}`" for k, c in enumerate(CLASHES) if c.lower() not in {x.lower() for x in df.columns}])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = clashing(spark.createDataFrame(odd_rows(), DOCS))
    out = stage(spark, docs, tables)
    rows = out.collect()
    assert out.columns == ([c for c in docs.columns if c != "taken"] + ["taken"] if name == "mix" else docs.columns)
    ids = [r.doc_id for r in rows]
    if name == "toxicity":
        scores = toxicity.toxicity(docs, spark.read.parquet(f"{tables}/labels.parquet")).where("predicted = 0")
        assert sorted(ids, key=repr) == sorted([r.doc_id for r in scores.collect()], key=repr) and 0 < len(ids) < len(odd_rows())
    if name in ("decontaminate", "secrets"):
        assert sorted(ids, key=repr) == sorted([r[0] for r in odd_rows()], key=repr)
    if name == "near_dedup":
        # 50 and 51 are empty, as is a row without an id; the copy of row 3 goes; row 5 stays once, and its other text has a group of its own.
        assert sorted(ids, key=repr) == sorted([*range(40), None, 50, 52, 5], key=repr)
    if name == "mix":
        assert all(r.text for r in rows) and sum(r.taken for r in rows) == int(1.5 * sum(len((r[1] or "").split()) for r in odd_rows()))
    none = stage(spark, docs.limit(0), tables)
    assert none.columns == out.columns and none.collect() == []


def test_near_dedup_reads_no_name_but_its_own(spark):
    docs = clashing(spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (3, "else", "en", "s", 1)], DOCS))
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 3]


def test_very_long_texts(spark, make):
    docs = make([(1, LONG, "en", "a", 1), (2, "short one", "en", "b", 1)], DOCS)
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()} == {1: 360_000, 2: 2}
    texts = ["good words here", "bad words there"] * 20
    model = quality.fit(texts, np.array([1, 0] * 20))
    assert abs(model.score([texts[0] * 40_000])[0] - model.score([texts[0] * 40_000, "x"])[0]) == 0
    item = [f"b{k}" for k in range(20)]
    index = decontaminate.Index.build([(1, " ".join(item))])
    doc, found, distance = index.leaks([LONG + " ".join(item) + " " + LONG, LONG])
    assert (doc.tolist(), found.tolist(), distance.tolist()) == ([0], [0], [0])
    out = url_filter.judge(make([(1, "http://a.example.com/en/7" + "x" * 500_000, ""), (2, "http://x.org/" + "casino-poker-" * 40_000, "")], "page_id long, url string, html string")).collect()
    assert [r.verdict for r in sorted(out)] == ["allow", "block"]


def test_a_common_stem_opens_few_windows():
    rng = random.Random(4)
    stem = "which of the following is".split()
    items = [(k, " ".join(stem + [f"v{rng.randrange(4000)}" for _ in range(rng.randrange(10, 50))])) for k in range(2000)]
    index = decontaminate.Index.build(items)
    filler = [f"v{rng.randrange(4000)}" for _ in range(1900)]
    leak = items[77][1].split()
    text = " ".join(filler[:700] + stem + filler[700:1200] + leak + filler[1200:1500] + stem + filler[1500:])
    began = time.perf_counter()
    doc, found, _ = index.leaks([text])
    assert 77 in found.tolist() and time.perf_counter() - began < 2
    assert sum(len(h) for h, _, _ in index.runs.values()) < sum(len(t.split()) for _, t in items)


def test_blocks_find_what_one_block_finds(spark, make, monkeypatch):
    rng = random.Random(5)
    items = [(k, " ".join(f"b{rng.randrange(500)}" for _ in range(25))) for k in range(60)]
    benchmark = make(items, "item_id long, text string")
    docs = make([(k, f"before {t} after", "en", "s", 1) for k, t in items] + [(99, "none of it", "en", "s", 1)], DOCS)
    one = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert {(k, k) for k, _ in items} <= one
    monkeypatch.setattr(decontaminate.Blocks.__init__, "__defaults__", (2_000,))
    assert len(decontaminate.Blocks(benchmark)) > 2
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()} == one
    assert [r.doc_id for r in decontaminate.without_leaks(docs, benchmark).collect()] == [99]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_neighbours_at_many_dimensions_and_of_repeated_rows(spark, make, monkeypatch):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(900, 1024)).astype(np.float32)
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    got = {}
    for r in neighbours.nearest(make(rows, VECTORS), "vec_id % 100 = 0", shard_rows=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    wide, hits = points.astype(float), 0
    for q in range(0, 900, 100):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        hits += len(set(want.tolist()) & {v for _, v in got[q]})
    assert hits >= 0.9 * 90
    few = make([(100, [1.0, 0.0], 0), (100, [0.0, 1.0], 0), (7, [1.0, 1.0], 0), (7, [1.0, 1.0], 0), (8, [5.0, 5.0], 0)], VECTORS)
    out = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours.nearest(few, "vec_id % 100 = 0").orderBy("rank").collect()]
    assert out == [(100, 1, 7, 1.0), (100, 2, 7, 1.0), (100, 3, 8, round(float(np.sqrt(41)), 6))]


def test_a_deep_router_loses_nothing(spark, make, monkeypatch):
    rng = np.random.default_rng(7)
    points = np.r_[rng.normal(size=(3000, 4)), np.ones((300, 4))].astype(np.float32)
    df = make([(i, p.tolist(), 0) for i, p in enumerate(points)], VECTORS)
    monkeypatch.setattr(neighbours, "SAMPLE", 64)
    got = {}
    for r in neighbours.nearest(df, "vec_id % 100 = 0", factor=1.0, shard_rows=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    wide = points.astype(float)
    for q in range(0, 3300, 100):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [v for _, v in sorted(got[q])] == np.lexsort((np.arange(len(d)), d))[:10].tolist()


def test_every_query_reads_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "op6_chat" else 0), name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_and_ties_score_alike(spark, make):
    rows = [(i, "some words of it" if i % 2 else "other words of it", "en", "s", 1) for i in range(40)]
    labels = make([(i, i % 2, i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    for f in (toxicity.toxicity, quality.quality):
        out = f(make(rows + rows, DOCS), labels).collect()
        assert len(out) == 80 and len({r.score for r in out}) == 2
        assert all(len({r.score for r in out if r.doc_id == i}) == 1 for i in range(40))
