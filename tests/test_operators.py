"""State changes and sources on small rows."""

import os

import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.operators import control, joins, upserts
from ledgerloom.plans import normalise
from ledgerloom.sources import files
from ledgerloom.streaming import jobs


def test_merge_upsert_is_idempotent(spark):
    schema = "company int, k string, v int, title string, source string, urls array<string>"
    old = spark.createDataFrame([(1, "a", 0, "T", "", ["u1"])], schema)
    new = spark.createDataFrame([(1, "a", 1, "X", "s", ["u1", "u2"]), (1, "b", 1, "N", None, [])], schema)
    args = dict(keys=["company", "k"], version="v", unions=["urls"], first_filled=["source"], keep=["title"])
    once = upserts.merge_upsert(old, new, **args)
    rows = {r.k: (r.title, r.source, r.urls) for r in once.collect()}
    assert rows == {"a": ("T", "s", ["u1", "u2"]), "b": ("N", None, [])}
    again = upserts.merge_upsert(once.select(*old.columns), new, **args)
    assert {r.k: (r.title, r.source, r.urls) for r in again.collect()} == rows


def test_ledger_never_downgrades(spark):
    df = spark.createDataFrame([("x", "done", 1), ("x", "failed", 2), ("y", "failed", 1), ("y", "done", 2), ("z", "failed", 1)], "k string, s string, v int")
    assert {r.k: r.s for r in upserts.never_downgrade(df, ["k"], "s", "done", "v").collect()} == {"x": "done", "y": "done", "z": "failed"}


def test_repair_keeps_the_old_value(spark):
    df = spark.createDataFrame([("A", "B", "", ""), ("A", "A", None, "n")], "title string, t2 string, date string, d2 string")
    rows = upserts.repair(df, {"title": "t2", "date": "d2"}).collect()
    assert (rows[0].title, rows[0].date, rows[0].meta_fixed) == ("B", "", {"title": "A"})
    assert (rows[1].title, rows[1].date, rows[1].meta_fixed) == ("A", "n", {})


def test_backoff(spark):
    rows = upserts.backoff(spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, fail_count int"), "id").collect()
    assert [r.status for r in rows] == ["failed", "failed", "dead_letter"]
    assert 30 <= rows[0].delay_s < 40 and 60 <= rows[1].delay_s < 70


def test_stale_tokens_change_nothing(spark):
    q = spark.createDataFrame([(1, "a", "running"), (2, "b", "running")], "id int, token string, status string")
    done = spark.createDataFrame([(1, "a", "queued"), (2, "old", "queued")], "id int, token string, s2 string")
    assert {r.id: r.status for r in upserts.fenced(q, done, "id", "token", {"status": "s2"}).collect()} == {1: "queued", 2: "running"}


def test_artifacts_of_one_table_only(spark):
    e = lambda s: spark.createDataFrame([], s)
    audio = spark.createDataFrame([(7, "a")], "event_id long, url string")
    r = joins.artifact_counts(e("event_id long, kind string"), e("event_id long, ord long"), audio, e("event_id long, raw_status string")).collect()
    assert [(x.event_id, x.audio, x.blocks, x.urls, x.file_kinds) for x in r] == [(7, 1, 0, 0, None)]


def test_accepted_requests_count_alone(spark):
    r = spark.createDataFrame([(i, "ip", float(t)) for i, t in enumerate([0, 1, 2, 3, 61, 62])], "id long, ip string, t double")
    assert [x.ok for x in control.accepted(r, "ip", "t", 2, 60.0).orderBy("id").collect()] == [True, True, False, False, True, True]


def test_crawl_keeps_to_its_limits(spark):
    links = spark.createDataFrame([("s", f"p{i}", 0.9 - i / 100) for i in range(20)] + [("s", "weak", 0.1)], "url string, target string, score double")
    out = normalise.crawl(spark.createDataFrame([("x", "s")], "site string, url string"), links, max_pages=8)
    rows = out.collect()
    assert len(rows) == 8 and "weak" not in {r.url for r in rows}
    assert {r.url for r in rows if r.round == 1} == {f"p{i}" for i in range(5)}


def test_crawl_sends_no_table_through_the_driver(spark):
    store = spark._jsparkSession.sharedState().statusStore()

    def executions() -> list:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        every = store.executionsList()
        return [every.apply(k) for k in range(every.size())]

    last = max((e.executionId() for e in executions()), default=-1)
    seeds = spark.range(30).selectExpr("id AS site", "concat('https://s', id, '.com/0') AS url")
    links = seeds.selectExpr("url", "explode(array('1', '2')) AS p").selectExpr("url", "concat(substring_index(url, '/', 3), '/', p) AS target", "0.9D AS score", "1.0D AS takes")
    assert normalise.crawl(seeds, links, same_site=True, page_s="takes").count() == 90
    joins_of = [p for e in executions() if e.executionId() > last and "Join" in (p := e.physicalPlanDescription())]
    assert joins_of and not [p for p in joins_of if "BroadcastExchange" in p]


def test_hash_gate_opens_without_a_snapshot(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, content string")
    before = pages.where("id = 1").select("id", F.sha2("content", 256).alias("content_hash"))
    assert {r.id: r.changed for r in normalise.hash_gate(pages, before, ["id"]).collect()} == {1: False, 2: True, 3: False}


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "ev_1.json").write_text('{"id": "a",\n "n": 1}')
    (tmp_path / "d" / "_manifest.json").write_text('{"id": "no"}')
    assert [r.id for r in files.read_records(spark, f"file://{tmp_path}/d", "id string, n int").collect()] == ["a"]
    for k in ("x", "y"):
        os.makedirs(tmp_path / "t" / k)
        (tmp_path / "t" / k / "page.html").write_text("12345")
    (tmp_path / "t" / "x" / "meta.json").write_text("{}")
    assert [(r.meta, r.n_html, r.n_content) for r in files.read_traces(spark, f"file://{tmp_path}/t").collect()] == [("{}", 5, None)]
    rows = spark.createDataFrame([(1, 'a\t"b"\nc'), (2, None)], "id int, s string")
    files.write_tsv(rows, f"file://{tmp_path}/tsv")
    assert {r.id: r.s for r in files.read_tsv(spark, f"file://{tmp_path}/tsv", "id int, s string").collect()} == {1: 'a\t"b"\nc', 2: None}


def test_traces_take_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ARCHIVE_BYTES", 1 << 16, raising=False)
    rows = [(f"{i % 7}/{i}", f'{{"n": {i}}}' if i % 50 else None, "é" * (i % 400) if i % 3 else None, "" if i % 2 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, meta string, html string, content string").repartition(2)
    for _ in range(2):  # a second writing replaces the first
        files.write_traces(df, f"file://{tmp_path}/t/a")
    kept = [f for _, _, names in os.walk(tmp_path) for f in names if not f.endswith(".crc")]
    assert 2 < len(kept) < 60
    (tmp_path / "t" / "a" / "loose").mkdir()
    (tmp_path / "t" / "a" / "loose" / "meta.json").write_text("{}")
    want = {(f"a/{k}", m, h if h is None else len(h.encode()), c if c is None else 0) for k, m, h, c in rows if m is not None} | {("a/loose", "{}", None, None)}
    out = files.read_traces(spark, f"file://{tmp_path}/t").collect()
    assert len(out) == len(want) and {(r.folder.partition("/t/")[2], r.meta, r.n_html, r.n_content) for r in out} == want


def test_a_batch_delivered_twice(spark, tmp_path):
    sink = jobs.upsert_sink(f"file://{tmp_path}/s", lambda old, new: upserts.latest(old.unionByName(new), ["k"], "v"))
    one, two = (spark.createDataFrame(r, "k string, v int") for r in ([("a", 1), ("b", 1)], [("a", 2)]))
    for batch, n in ((one, 0), (two, 1), (two, 1)):
        sink(batch, n)
    assert {r.k: r.v for r in jobs.read_snapshot(spark, f"file://{tmp_path}/s").collect()} == {"a": 2, "b": 1}


def test_change_state_across_batches(spark, tmp_path):
    for i, h in enumerate("aab"):
        pd.DataFrame({"key": ["k"], "content_hash": [h], "ord": [i]}).to_parquet(tmp_path / f"{i}.parquet")
    out = jobs.run_available(jobs.changes(jobs.read_files(spark, f"file://{tmp_path}", 1)), "changes_test")
    assert sum(r.changed for r in out.collect()) == 2
