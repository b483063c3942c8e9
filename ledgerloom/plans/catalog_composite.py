"""Queries over sources, nested blocks, pipelines, streams, the control plane and graph evaluation."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text, udfs, urls
from ledgerloom.functions.nested import table_kind
from ledgerloom.operators import aggregates, blocks, control, graph, readers
from ledgerloom.plans import normalise
from ledgerloom.plans.catalog_scalar import EACH_URL, SQL_PERIOD, SQL_UNWRAP, each_url, media, picked, sql_picked
from ledgerloom.plans.domain import EVENTS_NOW, QUEUE_NOW, load, ts, with_tables
from ledgerloom.registry import query
from ledgerloom.sources import files
from ledgerloom.streaming import jobs

EV = with_tables("disc_events")
WQ = with_tables("work_queue")
UL = with_tables("url_ledger")
NOW_SQL = f"TIMESTAMP '{EVENTS_NOW}'"


def scratch(spark, tag: str) -> str:
    """A new folder that executors share, under ``spark.checkpoint.dir``; only a local master may go without that setting."""
    return files.shared_folder(spark, tag)


# --- Sources and sinks ---


@query("src_01_table_scan", EV + "SELECT event_id, title FROM disc_events WHERE status = 'failed' ORDER BY created_at DESC, event_id LIMIT 1000")
def _(spark, d):
    return load(spark, d, "disc_events").where("status = 'failed'").orderBy(F.desc("created_at"), "event_id").limit(1000).select("event_id", "title")


@query("src_02_paged_scan", EV + "SELECT event_id, title, (row_number() OVER (ORDER BY created_at DESC, event_id) - 1) // 1000 AS page FROM disc_events WHERE status <> 'enriched'")
def _(spark, d):
    from ledgerloom.operators import ordering

    e = load(spark, d, "disc_events").where("status <> 'enriched'")
    ranked = ordering.ranked(e, [F.desc("created_at"), "event_id"], F.date_trunc("hour", F.col("created_at").cast("timestamp")), part_ascending=False)
    return ranked.select("event_id", "title", F.floor(F.col("rank") / 1000).alias("page"))


@query("src_03_exact_counts", EV + "SELECT count(*) AS n_all, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE media <> '') AS n_media FROM disc_events")
def _(spark, d):
    return load(spark, d, "disc_events").agg(F.count("*").alias("n_all"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("media") != "").alias("n_media"))


@query("src_04_tracked_tickers", with_tables("companies") + "SELECT DISTINCT upper(ticker) AS ticker FROM companies")
def _(spark, d):
    return files.tracked_tickers(load(spark, d, "companies"), "ticker")


@query("src_05_record_files", "SELECT item_id, text FROM benchmark")
def _(spark, d):
    folder = scratch(spark, "records")
    load(spark, d, "benchmark").select("item_id", "text").write.json(f"{folder}/out")
    return spark.read.schema("item_id long, text string").option("pathGlobFilter", "part*.json").json(f"{folder}/out")


@query("src_06_trace_tree", "SELECT c_custkey::VARCHAR AS id, length(c_name)::BIGINT AS n_html, (CASE WHEN c_custkey % 2 = 0 THEN 7 END)::BIGINT AS n_content FROM customer")
def _(spark, d):
    folder = scratch(spark, "traces")
    meta = F.format_string('{"id": "%d"}', "c_custkey")
    files.write_traces(load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), meta.alias("meta"), F.col("c_name").alias("html"), F.when(F.col("c_custkey") % 2 == 0, "content").alias("content")), f"{folder}/a")
    t = files.read_traces(spark, folder)
    return t.select(F.get_json_object("meta", "$.id").alias("id"), "n_html", "n_content")


@query("src_07_tsv_snapshot", WQ + "SELECT id, type, status FROM work_queue WHERE priority = 0")
def _(spark, d):
    folder = scratch(spark, "tsv")
    files.write_tsv(load(spark, d, "work_queue").where("priority = 0").select("id", "type", "status"), folder)
    return files.read_tsv(spark, folder, "id long, type string, status string")


@query("src_08_pages", "SELECT page_id, url, length(html)::BIGINT AS n FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("src_09_inline_text")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", udfs.html_inline("html", "url").alias("inline"))


@query("src_10_body_extraction")
def _(spark, d):
    p = load(spark, d, "pages").select("page_id", udfs.body_udf("html", "url").alias("b"), F.size(udfs.html_tables("html")).alias("n_tables"))
    return p.select("page_id", "b.tier", F.length("b.body").alias("n_chars"), F.md5("b.body").alias("body_md5"), "n_tables")


SYNTHETIC_TABLE = "concat('<table><tr><th>Year</th><th>', c_mktsegment, '</th></tr><tr><td>2024</td><td>', c_custkey, '</td></tr></table><table role=\"presentation\"><tr><td>', c_name, '</td></tr></table>')"


@query("src_11_html_tables", "SELECT c_custkey, 0 AS table_idx, 'Year|' || c_mktsegment AS headers, '2024|' || c_custkey AS cells FROM customer UNION ALL SELECT c_custkey, 1, '', c_name FROM customer")
def _(spark, d):
    t = load(spark, d, "customer").select("c_custkey", F.explode(udfs.html_tables(F.expr(SYNTHETIC_TABLE))).alias("t"))
    return t.select("c_custkey", "t.table_idx", F.array_join("t.headers", "|").alias("headers"), F.array_join(F.flatten("t.rows"), "|").alias("cells"))


@query("src_12_coordinate_columns", "WITH w AS (SELECT l_suppkey, l_linenumber * 10 + l_quantity / 50 AS x FROM lineitem), f AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY l_suppkey ORDER BY x) > 4.0 THEN 1 ELSE 0 END AS new FROM w), i AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY x ROWS UNBOUNDED PRECEDING) AS island FROM f), c AS (SELECT l_suppkey, island, count(*) AS n, max(x) AS edge FROM i GROUP BY 1, 2 HAVING count(*) >= 3) SELECT l_suppkey, count(*) AS n_columns, max(edge) AS last_edge FROM c GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    from ledgerloom.operators import ordering

    words = load(spark, d, "lineitem").select("l_suppkey", (F.col("l_linenumber") * 10 + F.col("l_quantity") / 50).alias("x"))
    columns = ordering.islands(words, ["l_suppkey"], "x", 4.0).groupBy("l_suppkey", "island").agg(F.count("*").alias("n"), F.max("x").alias("edge")).where("n >= 3")
    return columns.groupBy("l_suppkey").agg(F.count("*").alias("n_columns"), F.max("edge").alias("last_edge")).where("n_columns >= 2")


@query("src_13_reader_ladder", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'text' WHEN doc_id % 3 = 1 THEN 'ocr' ELSE 'empty' END AS via, CASE WHEN doc_id % 3 < 2 THEN length(text) ELSE 0 END::BIGINT AS n_chars FROM documents WHERE trim(text) <> ''")
def _(spark, d):
    x = load(spark, d, "documents").where(F.trim("text") != "")
    tiers = {"text": F.when(F.col("doc_id") % 3 == 0, F.col("text")), "ocr": F.when(F.col("doc_id") % 3 == 1, F.col("text")), "legacy": F.lit(" ")}
    via, body = files.reader_ladder(tiers)
    return x.select("doc_id", via.alias("via"), F.length(body).cast("long").alias("n_chars"))


@query(
    "src_14_sheet_tables",
    """WITH c AS (SELECT l_orderkey AS file, 'Tab' || l_linenumber % 2 AS sheet, l_linenumber * 2 AS row, l_partkey % 3 * 5 AS col,
    CASE WHEN l_linenumber = 1 THEN 'Sales of ' || l_returnflag WHEN l_linenumber = 2 THEN '2018-05-11 00:00' WHEN l_linenumber = 5 THEN ' ' ELSE l_partkey::VARCHAR END AS value FROM lineitem),
  f AS (SELECT file, sheet, row, col, min(trim(value)) AS v FROM c WHERE trim(value) <> '' GROUP BY ALL),
  p AS (SELECT file, sheet, dense_rank() OVER (PARTITION BY file, sheet ORDER BY row) - 1 AS r, dense_rank() OVER (PARTITION BY file, sheet ORDER BY col) - 1 AS c, v FROM f),
  w AS (SELECT file, sheet, max(r) AS last_r, max(c) AS last_c, arg_min(v, r * 1000 + c) FILTER (WHERE r < 2 AND length(v) BETWEEN 4 AND 60 AND len(regexp_extract_all(v, '[0-9]')) * 2 < length(v)) AS heading FROM p GROUP BY 1, 2),
  g AS (SELECT file, sheet, r, unnest(range(0, last_c + 1)) AS c FROM (SELECT file, sheet, last_c, unnest(range(0, last_r + 1)) AS r FROM w)),
  l AS (SELECT g.file, g.sheet, g.r, string_agg(coalesce(v, ''), '|' ORDER BY g.c) AS line FROM g LEFT JOIN p USING (file, sheet, r, c) GROUP BY 1, 2, 3)
  SELECT file, sheet, coalesce(heading, sheet) AS heading, string_agg(line, '/' ORDER BY r) AS grid FROM l JOIN w USING (file, sheet) GROUP BY 1, 2, 3""",
)
def _(spark, d):
    n = F.col("l_linenumber")
    value = F.when(n == 1, F.concat(F.lit("Sales of "), "l_returnflag")).when(n == 2, "2018-05-11 00:00").when(n == 5, " ").otherwise(F.col("l_partkey").cast("string"))
    cells = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.concat(F.lit("Tab"), (n % 2).cast("string")).alias("sheet"), (n * 2).alias("row"), (F.col("l_partkey") % 3 * 5).alias("col"), value.alias("value"))
    t = readers.sheet_tables(cells)
    return t.select("file", "sheet", "heading", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("grid"))


@query(
    "src_16_transcripts",
    """WITH a AS (SELECT conv_id AS id, CASE WHEN conv_id % 13 = 0 THEN 0 ELSE 9 END AS n_bytes, CASE WHEN conv_id % 7 = 0 THEN 9000.0 ELSE 60.0 END AS duration_s FROM conversations GROUP BY conv_id),
  s AS (SELECT conv_id AS id, turn, trim(text) AS t FROM conversations WHERE conv_id % 5 <> 4), u AS (SELECT id, count(*) AS n, trim(string_agg(t, ' ' ORDER BY turn)) AS said FROM s GROUP BY id),
  r AS (SELECT a.id, CASE WHEN n_bytes = 0 THEN 'empty-bytes' WHEN duration_s > 7200 THEN 'too-long' WHEN n IS NULL THEN 'transcribe-failed' WHEN a.id % 5 = 3 THEN 'fallback:small' ELSE '' END AS reason, n, said FROM a LEFT JOIN u USING (id))
  SELECT id, reason, CASE WHEN reason IN ('', 'fallback:small') THEN n ELSE 0 END AS n_segments, md5(CASE WHEN reason IN ('', 'fallback:small') THEN said ELSE '' END) AS said FROM r""",
)
def _(spark, d):
    c = load(spark, d, "conversations").withColumnRenamed("conv_id", "id")
    i, start = F.col("id"), F.col("turn") * 2.504
    audio = c.select("id").distinct().select("id", F.when(i % 13 == 0, 0).otherwise(9).alias("n_bytes"), F.when(i % 7 == 0, 9000.0).otherwise(60.0).alias("duration_s"))
    by = lambda model, rows: rows.select("id", F.lit(model).alias("model"), start.alias("start_s"), (start + 1).alias("end_s"), "text")
    # The large model heard three in five recordings, the small one all but one in five.
    said = by("large", c.where(i % 5 < 3)).unionByName(by("small", c.where(i % 5 < 4))).unionByName(by("unknown", c))
    out = readers.transcripts(audio, said, ["large", "small"], 7200.0)
    return out.select("id", "reason", "n_segments", F.md5("text").alias("said"))


@query("blk_01_html_blocks")
def _(spark, d):
    p = load(spark, d, "pages")
    html = F.concat("html", F.when(F.col("page_id") % 3 == 0, F.expr("concat('<table><tr><th>Year</th><th>Id</th></tr><tr><td>2024</td><td>', page_id, '</td></tr></table><p>After it.</p>')")).otherwise(""))
    page = p.select("page_id", "url", html.alias("html"))
    b = page.select("page_id", F.explode(blocks.spliced_udf(udfs.markdown_udf("html", "url"), udfs.html_tables("html"))).alias("b"))
    return b.select("page_id", "b.ord", "b.type", F.md5("b.md").alias("md_md5"), F.array_join("b.headers", "|").alias("headers"), F.size("b.rows").alias("n_rows"))


HEADS = (
    (b"%PDF-1.7", "pdf"), (b" <!DOCTYPE html>", "html"), (b"\n<HTML lang=x>", "html"), (b"PK\x03\x04aaxl/w", "xlsx"), (b"PK\x03\x04aaword/", "docx"), (b"PK\x03\x04bbppt/", "pptx"), (b"PK\x03\x04nothing", "guess"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1..", "ole"),
    (b"plain <html>", "guess"), (b"", "guess"), (b"%PD", "guess"),
)


@query("src_15_magic_bytes", f"SELECT c_custkey, {sql_picked([k for _, k in HEADS], 'c_custkey')} AS fmt FROM customer")
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", files.sniffed_format(picked([h for h, _ in HEADS], "c_custkey"), F.lit("guess")).alias("fmt"))


@query("src_17_batch_upsert", EV + "SELECT company_id, run_id, min(event_id) AS event_id, count(DISTINCT nullif(source_url, '')) AS sources FROM disc_events GROUP BY 1, 2")
def _(spark, d):
    from ledgerloom.operators import upserts

    e = load(spark, d, "disc_events").select("company_id", "run_id", "event_id", F.filter(F.array("source_url"), lambda u: u != "").alias("sources"))
    out = upserts.merge_upsert(e.where("event_id < 500"), e.where("event_id >= 500"), ["company_id", "run_id"], "event_id", ["sources"], [], [])
    return out.select("company_id", "run_id", "event_id", F.size("sources").cast("long").alias("sources"))


@query("src_18_page_snapshot", UL + "SELECT url, max(event_id) AS event_id FROM url_ledger GROUP BY 1")
def _(spark, d):
    from ledgerloom.operators import upserts

    return upserts.latest(load(spark, d, "url_ledger").select("url", "event_id", F.col("event_id").alias("v")), ["url"], "v").select("url", "event_id")


@query("src_19_append_log", with_tables("scan_log") + "SELECT unit_type, count(*) * 2 AS n FROM scan_log GROUP BY 1")
def _(spark, d):
    folder = scratch(spark, "log")
    s = load(spark, d, "scan_log")
    for _ in range(2):
        files.append_log(s, folder, by="unit_type")
    return spark.read.parquet(folder).groupBy("unit_type").agg(F.count("*").alias("n"))


@query("src_20_21_batch_tables", with_tables("event_documents", "segments") + "SELECT 'documents' AS t, count(*) AS n FROM event_documents UNION ALL SELECT 'segments', count(*) FROM segments")
def _(spark, d):
    folder = scratch(spark, "batches")
    for _ in range(2):  # delivered twice, written once
        files.write_tables({"documents": load(spark, d, "event_documents"), "segments": load(spark, d, "segments")}, folder, "b1")
    count = lambda n: files.whole_batches(spark, folder, n).agg(F.lit(n).alias("t"), F.count("*").alias("n"))
    return count("documents").unionByName(count("segments"))


@query("src_22_audit_trail", with_tables("scan_log") + "SELECT company_id % 3 AS run, count(*) AS n FROM scan_log GROUP BY 1")
def _(spark, d):
    folder = scratch(spark, "audit")
    s = load(spark, d, "scan_log").withColumn("run", F.col("company_id") % 3)
    s.select("run", "scan_id", "ts").write.partitionBy("run").json(folder)
    return spark.read.schema("scan_id long, run long").json(folder).groupBy("run").agg(F.count("*").alias("n"))


@query("src_23_event_report", EV + "SELECT rpad(coalesce(event_date, ''), greatest(10, length(coalesce(event_date, '')))::INT, ' ') || '  ' || rpad(event_type, 20, ' ') || '  ' || rpad(left(title, 40), 40, ' ') AS line FROM disc_events")
def _(spark, d):
    return files.event_report(load(spark, d, "disc_events"))


@query(
    "src_24_activity_feed",
    with_tables("companies", "disc_events")
    + f""", m AS (SELECT * FROM disc_events WHERE created_at > {NOW_SQL} - INTERVAL 1 DAY AND coalesce({SQL_PERIOD.format(t=NOW_SQL)}, false))
  SELECT m.event_id, c.ticker, m.title, m.event_date, m.event_type, list_filter(string_split(m.media, '|'), lambda u: starts_with(u, 'http'))[1] AS url, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS discovered, (SELECT count(*) FROM m) AS matched, (SELECT count(*) > 50 FROM m) AS truncated
  FROM m LEFT JOIN companies c USING (company_id) ORDER BY created_at DESC, event_id LIMIT 50""",
)
def _(spark, d):
    return aggregates.activity_feed(media(load(spark, d, "disc_events")), load(spark, d, "companies"), ts(EVENTS_NOW), "1 DAY", 50)


#: Fleets: a scan (minutes ago, calls, errors, failed pages, pages) or none, an event (minutes ago) or none, queue units
#: (status, minutes since the lease lapsed or the unit changed), and what is said of them. Each meets one condition first.
FLEETS = (
    (None, None, (), "down", "no scan for ever min"),
    ((10, 5, 2, 0, 9), None, (), "down", "no events from 5 calls in 30 min (2 errors, 1 scans)"),
    ((61, 9, 9, 0, 9), None, (), "down", "no scan for 61.0 min"),
    ((10, 5, 3, 0, 9), 5, (("running", 7),), "degraded", "3 extraction errors, events still arrive"),
    ((10, 5, 0, 0, 9), 5, (("running", 7), ("failed", 5)), "degraded", "1 leases are stuck"),
    ((10, 5, 0, 0, 9), 5, (("running", 5), ("failed", 5), ("failed", 500)), "degraded", "1 units newly failed of 2"),
    ((10, 4, 0, 30, 100), None, (("failed", 500),), "degraded", "30 of 100 pages fail to render"),
    ((10, 4, 0, 19, 20), 40, (), "ok", "0 events from 1 scans"),
    ((10, 5, 0, 20, 100), 29, (), "ok", "1 events from 1 scans"),
)


@query("txt_21_verdict_reason", " UNION ALL ".join(f"SELECT {k} AS fleet, '{v}' AS verdict, '{r}' AS reason" for k, (*_, v, r) in enumerate(FLEETS)))
def _(spark, d):
    ago = lambda anchor, m: f"TIMESTAMP_NTZ '{anchor}' - INTERVAL {m} MINUTES"
    table = lambda rows, empty: spark.sql(" UNION ALL ".join(rows or [f"SELECT * FROM ({empty}) WHERE false"]))
    scan = lambda m, *n: f"SELECT {ago(EVENTS_NOW, m)} AS ts, " + ", ".join(f"{x} AS {c}" for x, c in zip(n, ("vlm_calls", "extract_errors", "failed_render", "render_pages"), strict=True))
    event = lambda m: f"SELECT {ago(EVENTS_NOW, m)} AS created_at"
    unit = lambda status, m: f"SELECT '{status}' AS status, {ago(QUEUE_NOW, m)} AS lease_until, {ago(QUEUE_NOW, m)} AS updated_at"
    out = []
    for k, (s, e, q, *_) in enumerate(FLEETS):
        tables = table([scan(*s)] if s else [], scan(0, 0, 0, 0, 0)), table([event(e)] if e else [], event(0)), table([unit(*u) for u in q], unit("", 0))
        out.append(aggregates.fleet_health(*tables, ts(EVENTS_NOW), ts(QUEUE_NOW)).select(F.lit(k).alias("fleet"), "verdict", "reason"))
    return reduce(DataFrame.unionByName, out)


@query("jon_14_update_from", WQ + "SELECT id, CASE WHEN r.rk IS NULL THEN priority ELSE r.rk END AS priority FROM work_queue LEFT JOIN (SELECT id, row_number() OVER (ORDER BY due_at, id) AS rk FROM work_queue WHERE status = 'queued' AND type = 'full') r USING (id)")
def _(spark, d):
    from ledgerloom.operators import ordering

    q = load(spark, d, "work_queue")
    ranked = ordering.ranked(q.where("status = 'queued' and type = 'full'"), ["due_at", "id"], F.col("due_at").cast("date")).select("id", (F.col("rank") + 1).alias("rk"))
    return q.join(ranked, "id", "left").select("id", F.coalesce("rk", "priority").alias("priority"))


@query("srt_04_frontier_pop", UL + "SELECT event_id, url FROM (SELECT event_id, url, row_number() OVER (PARTITION BY event_id ORDER BY max(line) DESC, url) AS rk FROM url_ledger GROUP BY 1, 2) WHERE rk <= 2")
def _(spark, d):
    from ledgerloom.operators import ordering

    frontier = load(spark, d, "url_ledger").groupBy("event_id", "url").agg(F.max("line").alias("score"))
    return ordering.top_per_group(frontier, ["event_id"], [F.desc("score"), "url"], 2).select("event_id", "url")


@query("srt_12_worst_covered_first", with_tables("companies", "disc_events") + "SELECT company_id, coalesce(n, 0) AS n FROM companies LEFT JOIN (SELECT company_id, count(*) AS n FROM disc_events GROUP BY 1) USING (company_id)")
def _(spark, d):
    from ledgerloom.operators import joins

    return joins.left_counts(load(spark, d, "companies"), load(spark, d, "disc_events"), "company_id", "n").orderBy("n", "company_id").select("company_id", "n")


@query("ups_18_publish_singleton", "SELECT 1 AS id, 8400.0::DOUBLE AS t_star_s, 'vlm' AS binding")
def _(spark, d):
    folder = scratch(spark, "state")
    state = lambda t, b: spark.sql(f"SELECT 1 AS id, {t}D AS t_star_s, '{b}' AS binding")
    for t, b in ((9000.0, "render"), (8400.0, "vlm")):
        state(t, b).coalesce(1).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


# --- Text that needs Python ---


@query("txt_04_norm_evidence")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", text.norm_evidence(udfs.nfkc("text")).alias("v"))


@query(
    "txt_05_grounded",
    """WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS s FROM documents),
  e AS (SELECT doc_id, s, list_filter(CASE doc_id % 4 WHEN 0 THEN s[3:11] WHEN 1 THEN s[3:5] || ['changed'] || s[7:8] WHEN 2 THEN s[3:4] || ['x1'] || s[6:7] || ['x2'] || s[9:10] || ['x3'] ELSE s[3:4] END, lambda x: x IS NOT NULL) AS e FROM w),
  n AS (SELECT doc_id, s, e, least(6, len(e)) AS n FROM e),
  i AS (SELECT doc_id, s, e, n, unnest(range(1, greatest(len(e) - n, -1) + 2)) AS i FROM n WHERE len(e) >= 3),
  j AS (SELECT doc_id, s, e, n, i, unnest(range(1, greatest(len(s) - n, -1) + 2)) AS j FROM i),
  g AS (SELECT DISTINCT doc_id FROM j WHERE len(list_filter(range(0, n), lambda k: e[i + k] <> s[j + k])) <= 1)
  SELECT doc_id, doc_id IN (SELECT doc_id FROM g) AS g FROM documents""",
)
def _(spark, d):
    # Evidence as it stands, with one word changed, with words changed in every window, and of too few words.
    w = load(spark, d, "documents").select("doc_id", F.filter(F.split(text.norm_words(F.coalesce("text", F.lit(""))), " "), lambda x: x != "").alias("w"))
    part, words = lambda a, n: F.slice("w", a, n), lambda x: F.array(F.lit(x))
    k = F.col("doc_id") % 4
    broken = F.concat(part(3, 2), words("x1"), part(6, 2), words("x2"), part(9, 2), words("x3"))
    evidence = F.when(k == 0, part(3, 9)).when(k == 1, F.concat(part(3, 3), words("changed"), part(7, 2))).when(k == 2, broken).otherwise(part(3, 2))
    return w.select("doc_id", udfs.grounded_udf(F.array_join(evidence, " "), F.array_join("w", " ")).alias("g"))


@query(
    "txt_07_08_tagged_links",
    """WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '(a)b' ELSE url END AS url FROM pages)
  SELECT page_id, '[a](L1)' || tail || ' [b](L2) [c](L1)' || tail || ' [d](/e)' AS tagged, split_part(url, ')', 1) AS l1 FROM (SELECT *, CASE WHEN contains(url, ')') THEN substr(url, strpos(url, ')') + 1) || ')' ELSE '' END AS tail FROM u)""",
)
def _(spark, d):
    # An address that holds a bracket is cut there, as Markdown would; a relative one is no link.
    url = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("(a)b"))).otherwise(F.col("url"))
    p = load(spark, d, "pages").select("page_id", url.alias("url"))
    t = udfs.tag_links_udf(F.concat(F.lit("[a]("), "url", F.lit(") [b](https://z.example.com/) [c]("), "url", F.lit(") [d](/e)")))
    return p.select("page_id", t.alias("t")).select("page_id", F.col("t.text").alias("tagged"), F.col("t.refs")["L1"].alias("l1"))


@query("txt_09_line_chunks")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(udfs.split_text_udf("text", F.lit(2000), F.lit(100))).alias("block", "text"))


#: Titles with {} for a part's name, and what is left of them.
TITLE_FORMS = (
    ("Microsoft Word -  {} &amp;  co.docx", "{} & co"), ("MICROSOFT POWERPOINT - {}.pptx", "{}"), ("{}.PDF", "{}"), (" {}\t results ", "{} results"), ("{} - Microsoft Word", "{} - Microsoft Word"), ("{}.pdf.xlsx", "{}.pdf"),
    ("Microsoft Excel - {}", "{}"), ("{} &lt;b&gt;", "{} <b>"), (".docx", ""), ("{}.zip", "{}.zip"),
)


@query("txt_14_clean_title", f"SELECT p_partkey, replace({sql_picked([w for _, w in TITLE_FORMS], 'p_partkey')}, '{{}}', p_name) AS t FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", udfs.clean_title_udf(F.replace(picked([f for f, _ in TITLE_FORMS], "p_partkey"), F.lit("{}"), F.col("p_name"))).alias("t"))


@query("txt_17_decode", "SELECT doc_id, md5(text) AS h FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(udfs.decode_udf(F.col("text").cast("binary"), F.lit("utf-8"))).alias("h"))


# --- Windows that fold ---


@query("win_09_overlap_trim", "SELECT doc_id, sha256(doc_id || 'a') || sha256(doc_id || 'b') || sha256(doc_id || 'c') AS t FROM documents")
def _(spark, d):
    whole = F.concat(*[F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(x)), 256) for x in "abc"])
    pieces = F.array(F.substring(whole, 1, 100), F.substring(whole, 71, 80), F.substring(whole, 131, 100))
    return load(spark, d, "documents").select("doc_id", udfs.overlap_join_udf(pieces).alias("t"))


# --- Blocks ---


@query("blk_01_markdown_blocks", "SELECT c_custkey, b.ord, b.type FROM customer, (SELECT unnest([0, 1, 2]) AS ord, unnest(['md', 'table', 'list']) AS type) b")
def _(spark, d):
    md = F.concat(F.lit("# "), "c_name", F.lit("\n\n| a | b |\n|---|---|\n| 1 | "), F.col("c_custkey").cast("string"), F.lit(" |\n\n- one\n- two\n"))
    return load(spark, d, "customer").select("c_custkey", F.explode(blocks.markdown_blocks(md)).alias("b")).select("c_custkey", "b.ord", "b.type")


@query("blk_02_table_kind", "SELECT c_custkey, (['layout', 'data', 'layout', 'data', 'layout'])[(c_custkey % 5 + 1)::INT] AS kind FROM customer")
def _(spark, d):
    k = F.col("c_custkey") % 5
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    html = pick("<table>", "<table>", "<table>", "<table><th>", '<table role="presentation"><th>')
    return load(spark, d, "customer").select("c_custkey", table_kind(html, pick(3, 2, 3, 3, 9), pick(3, 6, 4, 4, 9)).alias("kind"))


@query("blk_03_collapse_spans", "SELECT c_custkey, c_name || ' / a|' || c_custkey || '|' AS cells FROM customer".replace("|'", ";'"))
def _(spark, d):
    k = F.col("c_custkey").cast("string")
    rows = F.array(F.array(F.col("c_name"), F.col("c_name"), F.col("c_name")), F.array(F.lit("a"), F.lit("a"), k))
    flat = F.array_join(F.transform(blocks.collapse_spans_udf(rows), lambda r: F.array_join(r, ";")), " / ")
    return load(spark, d, "customer").select("c_custkey", F.concat(flat, F.lit(";")).alias("cells"))


@query("blk_04_flatten_header", "SELECT p_partkey, p_brand || ' ' || p_type AS h FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", blocks.flatten_header(F.array(F.col("p_brand"), F.lit("nan"), F.col("p_brand"), F.lit(" "), F.col("p_type"))).alias("h"))


@query("blk_05_06_07_pair", "SELECT c_custkey, 'Intro' || chr(10) || chr(10) || '[TABLE 1]' || chr(10) || chr(10) || '[TABLE 2]' AS md, 'a|b' AS headers, false AS mismatch FROM customer")
def _(spark, d):
    md = F.concat(F.lit("Intro\n\n| a | b |\n|---|---|\n| 1 | "), F.col("c_custkey").cast("string"), F.lit(" |\n\n| c | d |\n| 3 | 4 |\n"))
    p = load(spark, d, "customer").select("c_custkey", blocks.pair(blocks.markdown_blocks(md)).alias("p"))
    return p.select("c_custkey", F.col("p.md").alias("md"), F.array_join(F.col("p.tables")[0]["headers"], "|").alias("headers"), blocks.placeholder_mismatch(F.col("p.md"), F.col("p.tables")).alias("mismatch"))


@query("blk_08_table_runs", "SELECT p_partkey, run, first_line, n_lines FROM part, (SELECT unnest([1, 2]) AS run, unnest([1, 5]) AS first_line, unnest([3, 2]) AS n_lines)")
def _(spark, d):
    body = F.lit("text\n| a |\n|---|\n| 1 |\n| lonely? no\n| b |\n| c |\n")
    lines = load(spark, d, "part").select("p_partkey", F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    return blocks.table_runs(lines, "p_partkey", "pos", "line").select("p_partkey", "run", "first_line", "n_lines")


@query(
    "blk_09_build_documents",
    with_tables("event_documents")
    + """SELECT event_id, url, 'html' AS kind, sum(length(md))::BIGINT + 2 * (count(*) - 1) AS n_chars, count(*) AS n_blocks FROM event_documents WHERE kind = 'html' GROUP BY 1, 2
  UNION ALL SELECT event_id, url, kind, length(md)::BIGINT, 1 FROM event_documents WHERE kind <> 'html' AND trim(md) <> ''""",
)
def _(spark, d):
    x = load(spark, d, "event_documents").withColumn("ord", F.col("doc_id"))
    out = blocks.build_documents(x.where("kind = 'html'"), x.where("kind <> 'html'"))
    return out.select("event_id", "url", "kind", F.col("n_chars").cast("long").alias("n_chars"), "n_blocks")


@query("blk_10_append_transcript", with_tables("segments") + "SELECT event_id, coalesce(nullif(speaker, ''), 'Speaker') AS speaker, start_s, md5(text) AS h, min(ord) AS ord FROM segments GROUP BY event_id, 2, start_s, text, CASE WHEN start_s IS NULL THEN ord END")
def _(spark, d):
    s = load(spark, d, "segments")
    return blocks.append_transcript(s.unionByName(s.where("start_s is not null"))).select("event_id", "speaker", "start_s", F.md5("text").alias("h"), "ord")


@query("blk_11_adopt_documents", UL + "SELECT event_id, url, rk FROM (SELECT event_id, url, row_number() OVER (PARTITION BY event_id ORDER BY min(line), url) AS rk FROM url_ledger WHERE regexp_matches(url, '\\.(pdf|xlsx)$') GROUP BY 1, 2) WHERE rk <= 2")
def _(spark, d):
    u = load(spark, d, "url_ledger")
    is_document = urls.classify(F.col("url")).isin("pdf", "xlsx") & (urls.extension(F.col("url")) != "")
    return blocks.adopt_documents(u.withColumn("ord", F.col("line")), u, is_document, 2).select("event_id", "url", "rk")


# --- Pipelines ---


@query(
    "nrm_01_03_normalise_events",
    EV
    + f""", u AS (SELECT event_id, event_date, title, lower(trim(event_type)) AS kind, list_filter(list_transform(string_split(media, '|'), lambda x: {SQL_UNWRAP.format('x')}),
    lambda x: starts_with(x, 'http') AND NOT regexp_matches(x, '{urls.NON_EVENT}') AND NOT regexp_matches(x, '{urls.TRACKER}')) AS urls FROM disc_events),
  d AS (SELECT *, CASE WHEN event_id % 12 IN (5, 6) THEN '2024' WHEN event_id % 12 = 11 THEN left(event_date, 10) ELSE coalesce(event_date, '') END AS read FROM u)
  SELECT event_id, read AS event_date, CASE WHEN kind IN ('earnings', 'press_release', 'webcast') THEN kind ELSE 'other' END AS event_type,
  CASE WHEN len(urls) = 0 AND (trim(coalesce(event_date, '')) = '' OR trim(title) = '') THEN 'no_identity' WHEN read <> '' AND NOT left(read, 4)::INT BETWEEN 1993 AND 2025 THEN 'implausible_date' END AS drop_reason, array_to_string(urls, ' ') AS urls FROM d""",
)
def _(spark, d):
    return normalise.normalise_events(media(load(spark, d, "disc_events")), now_year=2020).select("event_id", "event_date", "event_type", "drop_reason", F.array_join("urls", " ").alias("urls"))


@query(
    "nrm_02_normalise_routes",
    """WITH b AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) AS site, url FROM pages),
  r AS (SELECT page_id, site || '/up/x?y=1' AS url, 0.5::DOUBLE AS score FROM b UNION ALL SELECT page_id, site || '/Events/q1', 0.95 FROM b UNION ALL SELECT page_id, site || '/list', 0.4 FROM b WHERE page_id % 2 = 0
    UNION ALL SELECT page_id, 'https://tag.example.com/' || page_id, 1.0 FROM b WHERE page_id % 3 = 0) SELECT * FROM r""",
)
def _(spark, d):
    p = load(spark, d, "pages").withColumn("site", F.regexp_extract("url", "^(https?://[^/]*)", 1))
    r = lambda ref, score, when=F.lit(True): F.struct(F.lit(ref).alias("ref"), F.when(when, F.lit(score)).alias("s"), when.alias("there"))
    id_ = F.col("page_id")
    # Relative ones, an unreadable score, a repeat with another score, a low score, an asset, a document, a noise page, tags known and not.
    refs = [r("../up/./x?y=1", "unsure"), r("/Events/q1", "0.4"), r("/list", "0.4", id_ % 2 == 0), r("/list", "0.9", id_ % 2 == 0), r("/low", "-3"), r("/feed.xml", "1"), r("/q1.pdf", "1"), r("/careers", "1"), r("L1", "7", id_ % 3 == 0), r("L9", "1")]
    base = F.concat("site", F.lit("/dir/page.html"))
    routes = p.select("page_id", base.alias("base"), F.posexplode(F.array(*refs)).alias("pos", "r")).where("r.there").select("page_id", "base", "pos", "r.ref", "r.s")
    tags = p.select("page_id", F.lit("L1").alias("ref"), F.concat(F.lit("https://tag.example.com/"), id_.cast("string")).alias("url"))
    return normalise.normalise_routes(routes, tags, F.col("s"))


@query("nrm_04_chunk_merge", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n_events, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'partial' END END AS flag FROM documents")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id")
    failures = docs.select("doc_id", F.explode(F.array(F.col("doc_id") % 2 == 0, F.lit(False))).alias("failed"))
    found = docs.where("doc_id % 3 <> 0").select("doc_id", F.explode(F.array(F.lit("Q1 Call"), F.lit("q1 call!"))).alias("title"), F.lit("2024").alias("event_date"), F.array().cast("array<string>").alias("urls"))
    return normalise.merge_chunks(found, failures, "doc_id").select("doc_id", "n_events", "flag")


@query(
    "nrm_05_combine",
    """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 2 = 0 THEN 2 ELSE 0 END::INT AS n_events, CASE WHEN page_id % 7 = 0 THEN 0 WHEN page_id % 2 = 0 THEN 1 ELSE 2 END::INT AS n_routes,
  CASE WHEN page_id % 11 = 0 THEN 'error' WHEN page_id % 5 = 0 THEN 'partial' WHEN page_id % 7 = 0 THEN 'route_error' ELSE '' END AS flag,
  CASE WHEN page_id % 7 > 0 THEN url || '/b' END AS last_route FROM pages""",
)
def _(spark, d):
    p = load(spark, d, "pages")
    failed = lambda n, name: F.when(F.col("page_id") % n == 0, "failed").alias(name)
    state = p.select("page_id", failed(11, "error"), failed(7, "route_error"), failed(5, "partial"))
    a, b = F.concat("url", F.lit("/a")), F.concat("url", F.lit("/b"))
    titles = F.explode(F.array(F.lit("Q1"), F.lit("Q2"))).alias("title")
    events = p.where("page_id % 2 = 0").select("page_id", titles, F.array(a, F.lit("https://x.example.com/")).alias("urls"))
    # An event of the page before holds this page's second route, which stays: only the page's own events count.
    other = p.where("page_id % 2 = 0").select((F.col("page_id") + 100000000).alias("page_id"), F.lit("Q3").alias("title"), F.array(b).alias("urls"))
    routes = p.select("page_id", F.explode(F.array(a, b)).alias("url"), F.lit(0.5).alias("score"))
    out = normalise.combine_pages(state, events.unionByName(other), routes)
    return out.select("page_id", F.size("events").alias("n_events"), F.size("routes").alias("n_routes"), "flag", F.try_element_at(F.col("routes.url"), F.lit(-1)).alias("last_route"))


@query("nrm_06_07_fill_and_overwrite", EV + "SELECT event_id, coalesce(nullif(source_url, ''), nullif(media, '')) AS filled, coalesce(nullif(media, ''), nullif(source_url, '')) AS overwritten FROM disc_events")
def _(spark, d):
    a, b = F.col("source_url"), F.col("media")
    return load(spark, d, "disc_events").select("event_id", normalise.first_filled(a, b).alias("filled"), normalise.first_filled(b, a).alias("overwritten"))


@query(
    "nrm_08_site_crawl",
    """WITH s AS (SELECT c_custkey AS site, 'https://s' || c_custkey || '.com/' AS home FROM customer)
  SELECT site, home || p AS url, r::INT AS round FROM s, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS p, unnest([0, 1, 1, 2, 2, 2, 2]) AS r)
  WHERE site % 3 < 2 OR r < 2""",
)
def _(spark, d):
    # A walk per customer over a tree of seven pages; some links lead off the site or score too low, and the pages of
    # every third site take so long that its time is up after the second round.
    seeds = load(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.concat(F.lit("https://s"), F.col("c_custkey").cast("string"), F.lit(".com/0")).alias("url"))
    page = lambda k: F.concat(F.substring_index("url", "/", 3), F.lit("/"), k.cast("string"))
    tree = seeds.select("site", "url", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("p"))
    way = lambda target, score: F.struct(target.alias("target"), F.lit(score).alias("score"))
    ways = F.array(way(page(F.col("p") * 2 + 1), 0.9), way(page(F.col("p") * 2 + 2), 0.5), way(page(F.col("p") + 100), 0.1), way(F.lit("https://else.example.org/"), 1.0))
    links = tree.select(page(F.col("p")).alias("url"), F.explode(ways).alias("w"), F.when(F.col("site") % 3 == 2, 301.0).otherwise(1.0).alias("takes")).select("url", "w.target", "w.score", "takes")
    return normalise.crawl(seeds, links, scratch(spark, "crawl"), same_site=True, page_s="takes")


@query("nrm_09_hash_gate", "SELECT doc_id, doc_id % 2 = 1 OR doc_id % 10 = 0 AS changed FROM documents")
def _(spark, d):
    now = load(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    before = now.where("doc_id % 10 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 2 == 1, F.concat("content", F.lit("."))).otherwise(F.col("content")), 256).alias("content_hash"))
    return normalise.hash_gate(now, before, ["doc_id"]).select("doc_id", "changed")


@query("nrm_10_seeds", with_tables("companies") + "SELECT company_id, ir_url AS url FROM companies UNION ALL SELECT company_id, ir_url || 'events' FROM companies")
def _(spark, d):
    c = load(spark, d, "companies")
    hubs = c.select("company_id", F.posexplode(F.array(F.regexp_replace("ir_url", "/$", ""), F.concat("ir_url", F.lit("events")), F.concat("ir_url", F.lit("events/")))).alias("ord", "url")).withColumn("ord", F.col("ord") + 1)
    return normalise.seeds(c, hubs).select("company_id", "url")


# --- Streams ---


def stream_name() -> str:
    return f"s_{uuid.uuid4().hex}"


@query("str_01_recent_windows", EV + f"SELECT count(*) FILTER (WHERE created_at > {NOW_SQL} - INTERVAL 1 HOUR) AS hour, count(*) AS day FROM disc_events WHERE created_at > {NOW_SQL} - INTERVAL 1 DAY")
def _(spark, d):
    e = load(spark, d, "disc_events").where(F.col("created_at") > ts(EVENTS_NOW) - F.expr("INTERVAL 1 DAY"))
    return e.agg(F.count_if(F.col("created_at") > ts(EVENTS_NOW) - F.expr("INTERVAL 1 HOUR")).alias("hour"), F.count("*").alias("day"))


@query("str_02_hourly_usage_stream", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, sum(event_id % 7)::BIGINT AS pages, sum(event_id % 4)::BIGINT AS calls FROM events GROUP BY 1")
def _(spark, d):
    s = jobs.read_files(spark, f"{d}/events.parquet").selectExpr("ts", "event_id % 7 AS render_pages", "event_id % 4 AS vlm_calls")
    out = jobs.run_available(jobs.tumbling_usage(s), stream_name(), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "pages", "calls")


@query(
    "str_03_sliding_windows_stream",
    "WITH w AS (SELECT event_type, unnest([date_trunc('hour', ts) - to_hours(0), date_trunc('hour', ts) - to_hours(1), date_trunc('hour', ts) - to_hours(2), date_trunc('hour', ts) - to_hours(3), date_trunc('hour', ts) - to_hours(4), date_trunc('hour', ts) - to_hours(5)]) AS start FROM events) SELECT strftime(start, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2",
)
def _(spark, d):
    s = jobs.sliding_counts(jobs.read_files(spark, f"{d}/events.parquet"), "ts", "6 hours", "1 hour")
    return jobs.run_available(s, stream_name(), "complete").select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("str_04_change_detection_stream", "SELECT user_id::VARCHAR AS key, count(*) FILTER (WHERE before IS DISTINCT FROM event_type) AS changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY 1")
def _(spark, d):
    s = jobs.read_files(spark, f"{d}/events.parquet", 1000).selectExpr("cast(user_id as string) AS key", "event_type AS content_hash", "event_id AS ord")
    out = jobs.run_available(jobs.changes(s), stream_name())
    return out.groupBy("key").agg(F.count_if("changed").alias("changes"))


@query("str_05_06_upsert_stream", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    from ledgerloom.operators import upserts

    folder = scratch(spark, "snapshot")
    merge = lambda old, new: upserts.latest(old.unionByName(new), ["user_id"], "v")
    s = jobs.read_files(spark, f"{d}/events.parquet", 2).selectExpr("user_id", "event_id", "event_id AS v")
    q = s.writeStream.foreachBatch(jobs.upsert_sink(folder, merge)).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return jobs.read_snapshot(spark, folder).select("user_id", "event_id")


@query("str_07_lease_deliveries", "SELECT o_orderkey AS key, k::INT AS attempt, o_orderkey % 1000 + k * 60 AS at_s FROM orders, (SELECT unnest([0, 1, 2]) AS k) WHERE k <= (greatest(o_orderkey % 150 - 1, 0)) // 60")
def _(spark, d):
    return jobs.lease_deliveries(load(spark, d, "orders").selectExpr("o_orderkey AS key", "o_orderkey % 1000 AS at_s", "o_orderkey % 150 AS held_s", "60L AS lease_s"))


@query("str_08_debounced_alerts", "SELECT fleet, at_s FROM (SELECT unnest([0, 1]) AS fleet), (SELECT unnest([180, 2040]) AS at_s)")
def _(spark, d):
    # Down from minute 1 to minute 40 and for two minutes later on, in two fleets.
    v = spark.range(2).selectExpr("cast(id as int) AS fleet").crossJoin(spark.range(60).selectExpr("cast(id as int) AS m"))
    verdicts = v.select("fleet", (F.col("m") * 60).alias("at_s"), F.when(F.col("m").between(1, 40) | F.col("m").between(50, 51), "down").otherwise("ok").alias("verdict"))
    return jobs.debounced_alerts(verdicts, "at_s", quiet_s=1860).select("fleet", "at_s")


@query(
    "str_09_heartbeats",
    WQ
    + f""", h AS (SELECT id, CASE WHEN id % 3 = 1 THEN 'stale' ELSE claim_token END AS claim_token FROM work_queue WHERE id % 3 < 2)
  SELECT id, strftime(CASE WHEN id % 3 = 0 AND status = 'running' THEN greatest(lease_until, TIMESTAMP '{QUEUE_NOW}' + INTERVAL 360 SECOND) ELSE lease_until END, '%Y-%m-%d %H:%M:%S') AS lease_until,
  EXISTS (SELECT 1 FROM h WHERE h.id = q.id AND NOT (h.claim_token = q.claim_token AND q.status = 'running')) AS lost FROM work_queue q""",
)
def _(spark, d):
    from ledgerloom.operators import upserts

    # Beats of two units in three, half of them with a token that is no longer theirs, each delivered twice.
    q = load(spark, d, "work_queue")
    beats = q.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 1, "stale").otherwise(F.col("claim_token")).alias("claim_token"), ts(QUEUE_NOW).alias("at"))
    out, lost = upserts.renew(q, beats.unionByName(beats), "id", "claim_token", "at", 360, "running")
    return out.join(lost.select("id", F.lit(True).alias("lost")), "id", "left").select("id", F.date_format("lease_until", "yyyy-MM-dd HH:mm:ss").alias("lease_until"), F.coalesce("lost", F.lit(False)).alias("lost"))


@query("str_10_recurring_queue", WQ + "SELECT type, count(*) AS queued FROM work_queue GROUP BY 1")
def _(spark, d):
    from ledgerloom.operators import upserts

    return upserts.rearm(load(spark, d, "work_queue"), 8400).where("status = 'queued'").groupBy("type").agg(F.count("*").alias("queued"))


# --- Control plane ---


@query(
    "ctl_01_period_solver",
    """SELECT 1 AS case_id, false AS infeasible, 168 * 1000.0 / (1728 * 168 - 6000) AS t_render_h, 168 * 500.0 / (250 * 168 - 6000) AS t_vlm_h, 'vlm' AS binding, 8400.0 AS t_star_s
  UNION ALL SELECT 2, true, 1000.0 / (1728 * 0.5), 4.0, 'vlm', 14400.0""",
)
def _(spark, d):
    row = "cast({0} as int) AS case_id, 1728d AS render_pph, 250d AS vlm_cph, 0d AS slots, 1800d AS floor_s, 1000d AS n_hub, 1d AS inc_pages, 1d AS inc_calls, 0d AS inc_secs, 0.5d AS hit_rate, {1}d AS n_full, 6d AS full_pages, 6d AS full_calls, 0d AS full_secs"
    demand = spark.sql(f"SELECT {row.format(1, 1000)} UNION ALL SELECT {row.format(2, 8000)}")
    return control.solve(demand).select("case_id", "infeasible", "t_render_h", "t_vlm_h", "binding", "t_star_s")


@query(
    "ctl_02_03_solve_cycle",
    with_tables("work_queue", "scan_log")
    + f""", m AS (SELECT CASE WHEN sum(vlm_calls + vlm_skipped) > 0 THEN sum(vlm_calls) / sum(vlm_calls + vlm_skipped)::DOUBLE ELSE 1.0 END AS hit, sum(vlm_calls) / 6.0::DOUBLE AS c_v FROM scan_log WHERE ts > {NOW_SQL} - INTERVAL 6 HOUR),
  u AS (SELECT count(*) FILTER (WHERE type = 'incremental')::DOUBLE AS n_hub, count(*) FILTER (WHERE type = 'full')::DOUBLE AS n_full, avg(last_vlm_calls) FILTER (WHERE type = 'full') AS fc FROM work_queue WHERE last_scanned_at IS NOT NULL)
  SELECT n_hub, n_full, n_full * fc / (c_v * 0.5) AS eta_h FROM m, u""",
)
def _(spark, d):
    m = aggregates.throughput(load(spark, d, "scan_log"), ts(EVENTS_NOW), 6)
    full, inc = F.col("type") == "full", F.col("type") == "incremental"
    u = load(spark, d, "work_queue").where("last_scanned_at is not null").agg(F.count_if(inc).cast("double").alias("n_hub"), F.count_if(full).cast("double").alias("n_full"), F.avg(F.when(full, F.col("last_vlm_calls"))).alias("fc"))
    return m.crossJoin(u).select("n_hub", "n_full", control.backlog_eta(F.col("n_full") * F.col("fc"), F.col("c_v")).alias("eta_h"))


@query("ctl_04_profiles", "SELECT unnest(['small', 'medium', 'large']) AS profile, unnest([1728.0, 6500.0, 14000.0])::DOUBLE AS render_pph, unnest([200.0, 250.0, 250.0])::DOUBLE AS vlm_cph, unnest([1800.0, 1800.0, 900.0])::DOUBLE AS floor_s")
def _(spark, d):
    # An override that counts, one that a probe's ceiling is below, a ceiling above what is configured, an unknown profile.
    table = lambda *rows: spark.createDataFrame(list(rows), "profile string, render_pph double, vlm_cph double, floor_s double")
    return control.profiles(table(("large", None, None, 900.0), ("medium", 9000.0, None, None), ("other", 1.0, 1.0, 1.0)), table(("medium", 6500.0, None, None), ("small", 99999.0, 200.0, None)))


@query("ctl_05_06_fair_admission", "SELECT n_nationkey AS tenant, greatest(floor(64 * (n_nationkey % 4 + 1) / sum(n_nationkey % 4 + 1) OVER ()), 1)::BIGINT AS cap, n_nationkey * 100 > 1000 OR n_nationkey * 100 / (2.0 * 0.5) > 120 AS sheds FROM nation")
def _(spark, d):
    t = load(spark, d, "nation").selectExpr("n_nationkey AS tenant", "n_nationkey % 4 + 1 AS weight", "n_nationkey * 100 AS queue")
    return control.fair_caps(t, 64).select("tenant", "cap", control.sheds(F.col("queue"), F.lit(2.0), F.lit(0.5)).alias("sheds"))


@query(
    "ctl_07_hill_climb",
    """WITH RECURSIVE r AS (SELECT user_id AS company_id, (event_id % 7 + 1)::DOUBLE AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  s AS (SELECT DISTINCT company_id, 0::BIGINT AS i, NULL::DOUBLE AS ewma, 0::DOUBLE AS best, 18 AS lim, 2 AS step, 0 AS bad FROM r UNION ALL
    SELECT company_id, i, e, greatest(best * 0.98::DOUBLE, e), CASE WHEN e > best * 1.05::DOUBLE OR turn THEN greatest(least(lim + st, 64), 4) ELSE lim END, st, CASE WHEN turn THEN 0 ELSE b END
    FROM (SELECT *, CASE WHEN turn THEN -step ELSE step END AS st FROM (SELECT *, b >= 4 AS turn FROM (SELECT *, CASE WHEN e < best * 0.95::DOUBLE THEN bad + 1 ELSE 0 END AS b
      FROM (SELECT s.company_id, r.i, CASE WHEN s.ewma IS NULL THEN r.x ELSE 0.3::DOUBLE * r.x + 0.7::DOUBLE * s.ewma END AS e, s.best, s.lim, s.step, s.bad FROM s JOIN r ON r.company_id = s.company_id AND r.i = s.i + 1)))))
  SELECT company_id, arg_max(lim, i) AS "limit" FROM s GROUP BY 1""",
)
def _(spark, d):
    samples = load(spark, d, "scan_log").select("company_id", "scan_id", (F.col("render_pages") + 1).alias("rate"))
    return control.climb(samples, "company_id", "scan_id", "rate")


@query(
    "ctl_08_host_pacing",
    WQ
    + """, r AS (SELECT id, company_id % 97 AS host, (id % 500)::DOUBLE AS at_s, row_number() OVER (PARTITION BY company_id % 97 ORDER BY id % 500, id) - 1 AS i FROM work_queue)
  SELECT id, max(at_s - i * 1.5::DOUBLE) OVER (PARTITION BY host ORDER BY at_s, id ROWS UNBOUNDED PRECEDING) + i * 1.5::DOUBLE AS start_s FROM r""",
)
def _(spark, d):
    r = load(spark, d, "work_queue").selectExpr("id", "company_id % 97 AS host", "cast(id % 500 as double) AS at_s")
    return control.paced_starts(r, "host", "at_s", 1.5).select("id", "start_s")


HOSTS = (
    ("ir.example.com", True), ("127.0.0.1:80", False), ("172.20.1.1", False), ("LOCALHOST", False), ("172.32.0.1", True), ("10.0.0.1", False), ("100.0.0.1", True), ("169.254.169.254", False), ("192.168.1.1:8080", False), ("192.169.1.1", True), ("printer.local", False),
    ("db.internal", False), ("internal.example.com", True), ("[::1]", False), ("[fe80::1]", False), ("[fd00::1]", False), ("0.0.0.0", False), ("", False), (None, False), ("8.8.8.8", True),
)


@query("ctl_09_public_hosts", f"SELECT c_custkey, {sql_picked([ok for _, ok in HOSTS], 'c_custkey')} AS public FROM customer")
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", urls.is_public_host(picked([h for h, _ in HOSTS], "c_custkey")).alias("public"))


@query(
    "ctl_11_response_cache",
    """WITH RECURSIVE r AS (SELECT event_id AS id, user_id % 10 AS k, event_id::DOUBLE AS t, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS i FROM events),
  s AS (SELECT DISTINCT k, 0::BIGINT AS i, NULL::BIGINT AS id, false AS hit, NULL::DOUBLE AS made FROM r UNION ALL
    SELECT k, i, id, fresh, CASE WHEN fresh THEN made ELSE t END FROM (SELECT s.k, r.i, r.id, r.t, s.made, coalesce(r.t - s.made < 25, false) AS fresh FROM s JOIN r ON r.k = s.k AND r.i = s.i + 1))
  SELECT id, hit FROM s WHERE i > 0""",
)
def _(spark, d):
    r = load(spark, d, "events").selectExpr("event_id AS id", "user_id % 10 AS k", "cast(event_id as double) AS at_s")
    return control.cache_hits(r, "k", "at_s", 25.0).select("id", "hit")


@query("ctl_12_capacity_gate", "SELECT event_id, event_id % 100 <= 85 AND value <= 200 AS ok FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", control.has_room({"mem_pct": (F.col("event_id") % 100, 85), "wait": (F.col("value"), 200)}).alias("ok"))


@query("ctl_10_sliding_window_rate", "SELECT event_id AS id, count(*) OVER (PARTITION BY user_id % 10 ORDER BY event_id RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM events")
def _(spark, d):
    r = load(spark, d, "events").selectExpr("event_id AS id", "user_id % 10 AS ip", "event_id AS at_s")
    return control.window_rate(r, "ip", "at_s", 60).select("id", "n")


@query(
    "ctl_10_accepted_requests",
    """WITH RECURSIVE r AS (SELECT event_id AS id, user_id % 10 AS ip, event_id::DOUBLE AS t, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS i FROM events),
  s AS (SELECT DISTINCT ip, 0::BIGINT AS i, NULL::BIGINT AS id, true AS ok, []::DOUBLE[] AS kept FROM r UNION ALL
    SELECT ip, i, id, len(k) < 5, CASE WHEN len(k) < 5 THEN list_append(k, t) ELSE k END FROM (SELECT s.ip, r.i, r.id, r.t, list_filter(s.kept, lambda x: x > r.t - 60) AS k FROM s JOIN r ON r.ip = s.ip AND r.i = s.i + 1))
  SELECT id, ok FROM s WHERE i > 0""",
)
def _(spark, d):
    r = load(spark, d, "events").selectExpr("event_id AS id", "user_id % 10 AS ip", "cast(event_id as double) AS at_s")
    return control.accepted(r, "ip", "at_s", 5, 60.0).select("id", "ok")


@query(
    "ctl_13_14_queue_boost",
    with_tables("work_queue", "disc_events")
    + f"""SELECT id, n_events, 5 AS priority, strftime(CASE WHEN last_scanned_at IS NULL OR last_scanned_at < TIMESTAMP '{QUEUE_NOW}' - INTERVAL 7 DAY THEN TIMESTAMP '{QUEUE_NOW}' ELSE due_at END, '%Y-%m-%d') AS due
  FROM (SELECT w.*, coalesce(n, 0) AS n_events FROM work_queue w LEFT JOIN (SELECT company_id, count(*) AS n FROM disc_events GROUP BY 1) USING (company_id) WHERE type = 'full' AND status = 'queued') WHERE n_events <= 60 ORDER BY n_events, id LIMIT 40""",
)
def _(spark, d):
    b = control.boost(load(spark, d, "work_queue"), load(spark, d, "disc_events"), ts(QUEUE_NOW), 60, 40)
    return b.select("id", "n_events", "priority", F.date_format("due_at", "yyyy-MM-dd").alias("due"))


# --- Graph evaluation ---


@query(
    "grf_01_stratified_sample",
    """WITH a AS (SELECT doc_id, 'long' AS stratum FROM documents WHERE n_chars > 4000 ORDER BY md5(doc_id::VARCHAR) LIMIT 10), b AS (SELECT doc_id, 'english' AS stratum FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY md5(doc_id::VARCHAR) LIMIT 10),
  c AS (SELECT doc_id, 'any' AS stratum FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a UNION SELECT doc_id FROM b) ORDER BY md5(doc_id::VARCHAR) LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
)
def _(spark, d):
    return graph.stratified_sample(load(spark, d, "documents"), "doc_id", [("long", F.col("n_chars") > 4000), ("english", F.col("lang") == "en"), ("any", F.lit(True))], 10)


@query("grf_02_edge_validation", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 1 THEN 'evidence_not_in_body' WHEN 2 THEN 'self_loop' WHEN 3 THEN 'unknown_entity' END AS drop_reason FROM customer")
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", (F.col("c_custkey") % 4).alias("k"))
    body = c.select("id", F.concat(F.lit("On Monday **"), "c_name", F.lit("** said it will buy [Beta](https://b.example.com).")).alias("body"))
    mentions = c.select("id", F.explode(F.array("c_name", F.lit("Beta"))).alias("name"))
    edges = c.select(
        "id", F.col("c_name").alias("subject"), F.when(F.col("k") == 2, F.upper("c_name")).when(F.col("k") == 3, "Gamma").otherwise("BETA").alias("object"), F.when(F.col("k") == 1, "it sold everything").otherwise("said it will buy Beta").alias("evidence")
    )
    return graph.validate_edges(edges, mentions, body, "id").select("id", "drop_reason")


@query("grf_03_retry_list", UL + "SELECT event_id, string_agg(url, chr(10) ORDER BY url) AS lines FROM (SELECT event_id, url, row_number() OVER (PARTITION BY event_id ORDER BY url) AS rk FROM (SELECT DISTINCT event_id, url FROM url_ledger WHERE raw_status LIKE 'failed%')) WHERE rk <= 2 GROUP BY 1")
def _(spark, d):
    failed = load(spark, d, "url_ledger").where("raw_status like 'failed%'").select("event_id", "url").distinct()
    return graph.retry_list(failed, "event_id", "url", 2)


@query("grf_04_recall_blocks", "SELECT p_brand, p_partkey, block, n > 40 AS ambiguous FROM (SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) - 1) // 10 AS block, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE block < 4")
def _(spark, d):
    return graph.recall_blocks(load(spark, d, "part"), "p_brand", ["p_name", "p_partkey"], 10, 4).select("p_brand", "p_partkey", "block", "ambiguous")


@query("grf_05_verdict_merge", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'fix' WHEN 2 THEN 'drop' ELSE 'no_verdict' END AS verdict, CASE WHEN c_custkey % 4 = 1 THEN 'Fixed' ELSE c_name END AS subject, CASE WHEN c_custkey % 4 = 1 THEN c_name || ' -> B' END AS original FROM customer")
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("subject"), F.lit("B").alias("object"))
    k = F.col("id") % 4
    v = c.where(k < 3).select("id", F.element_at(F.array(*map(F.lit, ("keep", "fix", "drop"))), (k + 1).cast("int")).alias("verdict"), F.lit("Fixed").alias("subject"), F.lit(None).cast("string").alias("object"))
    return graph.merge_verdicts(c, v, ["id"]).select("id", "verdict", "subject", "original")


@query("grf_06_capture_rates", "SELECT count(*) AS n, (100 * count(*) FILTER (WHERE c_custkey % 3 < 2)) // count(*) AS captured_pct, (100 * count(*) FILTER (WHERE c_custkey % 3 = 0)) // count(*) AS exact_pct FROM customer WHERE c_custkey % 5 > 0")
def _(spark, d):
    k = F.col("c_custkey")
    expected = F.when(k % 5 > 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    found = F.when(k % 3 == 0, F.array(F.lit("B"), F.lit("A"))).when(k % 3 == 1, F.array(F.lit("A"))).otherwise(F.array(F.lit("Z")))
    return graph.capture_rates(load(spark, d, "customer").select(expected.alias("e"), found.alias("f")), "e", "f")


@query(
    "grf_07_scoreboard",
    """WITH d AS (SELECT c_custkey AS id, c_mktsegment AS stratum, c_custkey % 4 AS k FROM customer),
  e AS (SELECT id, stratum, j, CASE WHEN j = 3 THEN NULL ELSE j END AS level, CASE j WHEN 1 THEN 'buys' WHEN 2 THEN 'owns 5%' ELSE '?' END AS predicate FROM (SELECT id, stratum, unnest(range(1, k + 1)) AS j FROM d)),
  t AS (SELECT count(*) FILTER (WHERE k < 3) AS have, count(*) FILTER (WHERE k IN (0, 1)) AS caught, count(*) FILTER (WHERE k = 0) AS exact FROM d),
  s AS (SELECT stratum, count(*) AS docs, sum(k) AS edges, count(*) FILTER (WHERE k = 0) AS none FROM d GROUP BY 1),
  p AS (SELECT predicate, count(*) AS n FROM e GROUP BY 1)
  SELECT 'tags' AS section, 'have' AS key, have::DOUBLE AS value FROM t UNION ALL SELECT 'tags', 'caught', caught FROM t UNION ALL SELECT 'tags', 'exact', exact FROM t
  UNION ALL SELECT 'tags', 'caught_pct', 100 * caught // have FROM t UNION ALL SELECT 'tags', 'exact_pct', 100 * exact // have FROM t
  UNION ALL SELECT 'levels', coalesce(level, -1)::VARCHAR, count(*) FROM e GROUP BY 2
  UNION ALL SELECT 'predicates', 'kinds', count(*) FROM p UNION ALL SELECT 'predicates', 'with_digits', count(*) FILTER (WHERE regexp_matches(predicate, '[0-9]')) FROM p UNION ALL SELECT 'predicates', 'edges', sum(n) FROM p
  UNION ALL SELECT 'common', predicate, n FROM p
  UNION ALL SELECT 'strata', stratum || ': docs', docs FROM s UNION ALL SELECT 'strata', stratum || ': edges', edges FROM s UNION ALL SELECT 'strata', stratum || ': mean', edges / docs FROM s UNION ALL SELECT 'strata', stratum || ': zero_pct', 100 * none // docs FROM s
  UNION ALL SELECT 'drops', CASE WHEN id % 2 = 0 THEN 'edge: self_loop' ELSE 'mention: unknown' END, count(*) FROM d GROUP BY 2""",
)
def _(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum"), (F.col("c_custkey") % 4).cast("int").alias("k"))
    tag = F.concat(F.lit("(NYSE: A"), F.col("id").cast("string"), F.lit(")"))
    docs = c.select("id", "stratum", F.when(F.col("k") < 3, F.array(tag)).otherwise(F.array().cast("array<string>")).alias("tags"))
    noted = c.where("k <> 2").select("id", F.when(F.col("k") == 0, tag).when(F.col("k") == 1, "(NYSE: OTHER)").alias("exchange_tag"))
    j = F.col("j")
    edges = c.where("k > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("j"))
    edges = edges.select("id", F.when(j < 3, j).alias("level"), F.when(j == 1, " Buys").when(j == 2, "owns 5%").alias("predicate"))
    even = F.col("id") % 2 == 0
    return graph.scoreboard(docs, noted, edges, c.select(F.when(even, "edge").otherwise("mention").alias("kind"), F.when(even, "self_loop").otherwise("unknown").alias("reason")))


@query(
    "grf_08_media_coverage",
    EACH_URL
    + """, truth AS (SELECT DISTINCT event_id, url FROM urls), got AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://cdn.example.net/copy/' || split_part(url, '://', -1) ELSE 'https://elsewhere.example.net/' || pos END AS got FROM urls WHERE event_id % 4 < 3),
  hits AS (SELECT event_id, url, bool_or(coalesce(got = url OR contains(got, split_part(url, '://', -1)) OR contains(url, split_part(got, '://', -1)), false)) AS hit FROM truth LEFT JOIN got USING (event_id) GROUP BY 1, 2)
  SELECT event_id, count(*) AS total, count(*) FILTER (WHERE hit) AS found, coalesce(string_agg(url, ' ' ORDER BY url) FILTER (WHERE NOT hit), '') AS missing FROM hits GROUP BY 1""",
)
def _(spark, d):
    # Found as they are, as copies on another host, others instead, and none.
    u, k = each_url(spark, d), F.col("event_id") % 4
    copy = F.concat(F.lit("https://cdn.example.net/copy/"), F.substring_index("url", "://", -1))
    other = F.concat(F.lit("https://elsewhere.example.net/"), F.col("pos").cast("string"))
    got = u.where(k < 3).select("event_id", F.when(k == 0, F.col("url")).when(k == 1, copy).otherwise(other).alias("url"))
    out = graph.media_coverage(u, got, "event_id")
    return out.withColumn("missing", F.array_join("missing", " "))


@query("grf_09_table_acceptance", "SELECT count(*) FILTER (WHERE c_custkey % 20 = 0) AS suspicious, count(*) FILTER (WHERE c_custkey % 2 = 0) AS uniform FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    headers = F.when(k % 20 == 0, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("Year"), F.lit("Sales")))
    rows = F.array(F.when(k % 2 == 0, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("2024"), F.lit("x"))))
    t = graph.suspicious_tables(load(spark, d, "customer").select(headers.alias("headers"), rows.alias("rows")))
    return t.agg(F.count_if("suspicious").alias("suspicious"), F.count_if("uniform").alias("uniform"))
