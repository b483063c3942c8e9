"""Queries over joins, aggregates, windows, ordering and upserts, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, text, udfs, urls
from ledgerloom.operators import aggregates, joins, ordering, upserts
from ledgerloom.plans.catalog_scalar import EACH_URL, ONE_URL, SQL_PERIOD, each_url, media, sql_canon, sql_norm_date, sql_norm_title
from ledgerloom.plans.domain import EVENTS_NOW, QUEUE_NOW, load, ts, with_tables
from ledgerloom.registry import query

EV = with_tables("disc_events")
WQ = with_tables("work_queue")
UL = with_tables("url_ledger")
CE = with_tables("companies", "disc_events")


# --- Joins ---


@query("jon_01_companies_with_events", CE + "SELECT c.company_id, c.ticker, count(e.event_id) AS n_events FROM companies c JOIN disc_events e USING (company_id) GROUP BY 1, 2")
def _(spark, d):
    # Counting first leaves one row per company for the join.
    n = load(spark, d, "disc_events").groupBy("company_id").agg(F.count("event_id").alias("n_events"))
    return load(spark, d, "companies").join(n, "company_id").select("company_id", "ticker", "n_events")


QE = with_tables("work_queue", "disc_events")


@query("jon_02_queue_with_event_counts", QE + "SELECT w.id, coalesce(n, 0) AS n FROM work_queue w LEFT JOIN (SELECT company_id, count(*) AS n FROM disc_events GROUP BY 1) USING (company_id)")
def _(spark, d):
    return joins.left_counts(load(spark, d, "work_queue"), load(spark, d, "disc_events"), "company_id", "n").select("id", "n")


@query("jon_03_zero_event_companies_first", CE + "SELECT c.company_id, count(e.event_id) AS n FROM companies c LEFT JOIN disc_events e USING (company_id) GROUP BY 1")
def _(spark, d):
    return joins.left_counts(load(spark, d, "companies"), load(spark, d, "disc_events"), "company_id", "n").orderBy("n", "company_id").select("company_id", "n")


@query("jon_04_feed_lookup", CE + f"SELECT e.event_id, c.ticker FROM disc_events e LEFT JOIN companies c ON c.company_id = e.company_id * 20 WHERE e.created_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 1 DAY")
def _(spark, d):
    recent = load(spark, d, "disc_events").where(F.col("created_at") > ts(EVENTS_NOW) - F.expr("INTERVAL 1 DAY"))
    c = load(spark, d, "companies").select(F.col("company_id").alias("cid"), "ticker")
    return recent.join(c, F.col("company_id") * 20 == F.col("cid"), "left").select("event_id", "ticker")


@query(
    "jon_05_events_documents_companies",
    with_tables("companies", "disc_events", "event_documents") + "SELECT e.event_id, x.doc_id, c.ticker FROM disc_events e JOIN event_documents x USING (event_id) JOIN companies c USING (company_id) WHERE x.n_chars BETWEEN 800 AND 60000",
)
def _(spark, d):
    x = load(spark, d, "event_documents").where(F.col("n_chars").between(800, 60000)).select("event_id", "doc_id")
    return load(spark, d, "disc_events").join(x, "event_id").join(load(spark, d, "companies"), "company_id").select("event_id", "doc_id", "ticker")


ARTIFACTS = (
    with_tables("event_documents", "segments", "audio", "url_ledger")
    + """, docs AS (SELECT event_id, count(*) FILTER (WHERE kind = 'html') AS blocks, count(*) FILTER (WHERE kind <> 'html') AS files FROM event_documents GROUP BY 1),
  kinds AS (SELECT event_id, string_agg(kind || ':' || n, ',' ORDER BY kind) AS file_kinds FROM (SELECT event_id, kind, count(*) AS n FROM event_documents WHERE kind <> 'html' GROUP BY 1, 2) GROUP BY 1),
  segs AS (SELECT event_id, count(*) AS n FROM segments GROUP BY 1), aud AS (SELECT event_id, count(*) AS n FROM audio GROUP BY 1),
  u AS (SELECT event_id, count(*) AS n, count(*) FILTER (WHERE raw_status LIKE 'done%') AS n_done, count(*) FILTER (WHERE raw_status LIKE 'failed%') AS n_failed, count(*) FILTER (WHERE raw_status LIKE 'skipped%') AS n_skipped FROM url_ledger GROUP BY 1)
  SELECT event_id, coalesce(blocks, 0) AS blocks, coalesce(files, 0) AS files, file_kinds, coalesce(segs.n, 0) AS segments, coalesce(aud.n, 0) AS audio, coalesce(u.n, 0) AS urls, coalesce(n_done, 0) AS urls_done, coalesce(n_failed, 0) AS urls_failed, coalesce(n_skipped, 0) AS urls_skipped
  FROM docs FULL JOIN segs USING (event_id) FULL JOIN aud USING (event_id) FULL JOIN u USING (event_id) LEFT JOIN kinds USING (event_id)"""
)


@query("jon_06_event_artifact_counts", ARTIFACTS)
def _(spark, d):
    return joins.artifact_counts(*(load(spark, d, t) for t in ("event_documents", "segments", "audio", "url_ledger")))


@query("jon_07_anchor_row", EV + "SELECT event_id, date_diff('day', CAST(created_at AS DATE), a.today) AS age_days FROM disc_events CROSS JOIN (SELECT DATE '2024-01-31' AS today) a")
def _(spark, d):
    return load(spark, d, "disc_events").select("event_id", F.datediff(F.lit("2024-01-31").cast("date"), F.col("created_at").cast("date")).cast("long").alias("age_days"))


@query("jon_08_correlated_count", QE + "SELECT w.id, (SELECT count(*) FROM disc_events e WHERE e.company_id = w.company_id) AS n FROM work_queue w WHERE w.priority = 2")
def _(spark, d):
    return spark.sql("SELECT w.id, (SELECT count(*) FROM {e} e WHERE e.company_id = w.company_id) AS n FROM {w} w WHERE w.priority = 2", e=load(spark, d, "disc_events"), w=load(spark, d, "work_queue"))


@query("jon_09_first_http_element", EV + "SELECT event_id, list_filter(string_split(media, '|'), lambda u: starts_with(u, 'http'))[1] AS url FROM disc_events")
def _(spark, d):
    return media(load(spark, d, "disc_events")).select("event_id", F.get(F.filter("urls", lambda u: u.startswith("http")), F.lit(0)).alias("url"))


@query("jon_10_semi_join", with_tables("companies", "work_queue") + "SELECT id FROM work_queue WHERE company_id IN (SELECT company_id FROM companies WHERE ticker IN ('T1', 'T5', 'T9'))")
def _(spark, d):
    return load(spark, d, "work_queue").join(load(spark, d, "companies").where(F.col("ticker").isin("T1", "T5", "T9")), "company_id", "left_semi").select("id")


@query("jon_11_exists", CE + "SELECT c.company_id FROM companies c WHERE EXISTS (SELECT 1 FROM disc_events e WHERE e.company_id = c.company_id AND e.status = 'failed')")
def _(spark, d):
    return load(spark, d, "companies").join(load(spark, d, "disc_events").where("status = 'failed'"), "company_id", "left_semi").select("company_id")


OVERLAP = (
    EACH_URL
    + f""", k AS (SELECT DISTINCT e.event_id, e.company_id, {sql_norm_date('e.event_date')} AS day, {sql_canon('u.url')} AS canon FROM urls u JOIN disc_events e USING (event_id) WHERE starts_with(lower(u.url), 'http') AND e.event_date IS NOT NULL)
  SELECT b.event_id, min(a.event_id) AS reuses FROM k b JOIN k a ON a.company_id = b.company_id AND a.day = b.day AND a.canon = b.canon AND a.event_id % 24 < 12 WHERE b.event_id % 24 >= 12 GROUP BY 1"""
)


@query("jon_12_url_overlap", OVERLAP)
def _(spark, d):
    e = media(load(spark, d, "disc_events")).where("event_date is not null").withColumn("day", dates.norm_date(F.col("event_date")))
    return joins.url_overlap(e.where("event_id % 24 >= 12"), e.where("event_id % 24 < 12"), ["company_id", "day"]).select("event_id", F.col("hit").alias("reuses"))


@query("jon_13_tuple_in", WQ + "SELECT id, claim_token FROM work_queue WHERE (id, claim_token) IN (SELECT o_orderkey, 'tok' || o_orderkey % 5 FROM orders)")
def _(spark, d):
    held = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("tok"), (F.col("o_orderkey") % 5).cast("string")).alias("claim_token"))
    return load(spark, d, "work_queue").join(held, ["id", "claim_token"], "left_semi").select("id", "claim_token")


@query("jon_15_anti_join", CE + "SELECT company_id FROM companies WHERE company_id NOT IN (SELECT company_id FROM disc_events)")
def _(spark, d):
    return load(spark, d, "companies").join(load(spark, d, "disc_events"), "company_id", "left_anti").select("company_id")


@query(
    "jon_16_routes_not_events",
    """WITH e AS (SELECT CASE WHEN page_id % 5 = 1 THEN page_id + 1 ELSE page_id END AS page_id, split_part(url, '?', 1) AS url FROM pages WHERE page_id % 5 < 3)
  SELECT page_id, url FROM (SELECT page_id, split_part(url, '?', 1) AS url FROM pages UNION ALL SELECT page_id, url || '/next' FROM pages) r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page_id = r.page_id AND e.url = r.url)""",
)
def _(spark, d):
    p = load(spark, d, "pages")
    bare = F.substring_index("url", "?", 1)
    # Events of three pages in five; one of the three holds the address of the page before it, which must not count.
    events = p.where("page_id % 5 < 3").select(F.when(F.col("page_id") % 5 == 1, F.col("page_id") + 1).otherwise(F.col("page_id")).alias("page_id"), bare.alias("url"))
    routes = p.select("page_id", bare.alias("url")).unionByName(p.select("page_id", F.concat("url", F.lit("/next")).alias("url")))
    return joins.routes_not_events(routes, events)


@query("jon_17_lookup_label", CE + "SELECT e.event_id, coalesce(c.ticker, 'unknown') AS label FROM disc_events e LEFT JOIN companies c USING (company_id)")
def _(spark, d):
    return load(spark, d, "disc_events").join(load(spark, d, "companies"), "company_id", "left").select("event_id", F.coalesce("ticker", F.lit("unknown")).alias("label"))


@query(
    "jon_18_companies_with_hubs",
    CE
    + """, h AS (SELECT company_id, source_url, count(*) AS n FROM disc_events WHERE source_url <> '' GROUP BY 1, 2), g AS (SELECT company_id, string_agg(source_url || '=' || n, ' ' ORDER BY n DESC, source_url) AS hubs FROM h GROUP BY 1)
  SELECT c.company_id, coalesce(g.hubs, '') AS hubs FROM companies c LEFT JOIN g USING (company_id)""",
)
def _(spark, d):
    h = load(spark, d, "disc_events").where("source_url <> ''").groupBy("company_id", "source_url").agg(F.count("*").alias("n"))
    line = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "source_url"))), lambda x: F.concat(x["source_url"], F.lit("="), (-x["k"]).cast("string")))
    g = h.groupBy("company_id").agg(F.array_join(line, " ").alias("hubs"))
    return load(spark, d, "companies").join(g, "company_id", "left").select("company_id", F.coalesce("hubs", F.lit("")).alias("hubs"))


@query("jon_19_evidence_in_body")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", udfs.nfkc(F.coalesce("text", F.lit(""))).alias("body"), udfs.nfkc(F.coalesce(F.substring("text", 40, 60), F.lit(""))).alias("evidence"))
    return docs.select("doc_id", F.contains(text.norm_evidence(F.col("body")), text.norm_evidence(F.col("evidence"))).alias("grounded"))


@query("jon_20_fuzzy_url_match", EACH_URL + " SELECT a.event_id, count(DISTINCT b.url) AS found FROM urls a JOIN urls b ON a.event_id = b.event_id AND a.pos <> b.pos AND (contains(regexp_replace(lower(a.url), '^https?://', ''), regexp_replace(lower(b.url), '^https?://', '')) OR contains(regexp_replace(lower(b.url), '^https?://', ''), regexp_replace(lower(a.url), '^https?://', ''))) GROUP BY 1")
def _(spark, d):
    u = each_url(spark, d).withColumn("bare", F.regexp_replace(F.lower("url"), "^https?://", ""))
    b = u.select("event_id", F.col("pos").alias("p2"), F.col("bare").alias("b2"), F.col("url").alias("u2"))
    return u.join(b, "event_id").where("pos <> p2 and (contains(bare, b2) or contains(b2, bare))").groupBy("event_id").agg(F.count_distinct("u2").alias("found"))


@query(
    "jon_21_narrowest_fallback",
    """WITH k AS (SELECT p_brand, min(p_name) AS a, 'zz' AS b FROM part GROUP BY 1), m AS (SELECT k.p_brand, count(*) FILTER (WHERE contains(p.p_name, k.a) AND contains(p.p_name, k.b)) AS both_n, count(*) FILTER (WHERE contains(p.p_name, k.a)) AS a_n FROM k JOIN part p USING (p_brand) GROUP BY 1)
  SELECT p_brand, CASE WHEN both_n > 0 THEN 'and' ELSE 'a' END AS used, CASE WHEN both_n > 0 THEN both_n ELSE a_n END AS n FROM m""",
)
def _(spark, d):
    p = load(spark, d, "part")
    k = p.groupBy("p_brand").agg(F.min("p_name").alias("a")).withColumn("b", F.lit("zz"))
    has = lambda c: F.contains("p_name", c)
    m = p.join(k, "p_brand").groupBy("p_brand").agg(F.count_if(has("a") & has("b")).alias("both_n"), F.count_if(has("a")).alias("a_n"), F.count_if(has("b")).alias("b_n"))
    return m.select("p_brand", *joins.narrowest("both_n", {"a": "a_n", "b": "b_n"}))


@query("jon_22_reference_ids", "SELECT o_orderkey, 'https://x.example.com/' || (o_orderkey % 5 + 1) || ' https://x.example.com/' || (o_orderkey % 3 + 1) AS urls FROM orders")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.array(*[F.concat(F.lit("L"), x.cast("string")) for x in (F.col("o_orderkey") % 5 + 1, F.col("o_orderkey") % 3 + 1, F.lit(99))]).alias("refs"))
    table = spark.sql("SELECT concat('L', id) AS ref, concat('https://x.example.com/', id) AS url FROM range(1, 8)")
    return joins.resolve_references(o, table, "o_orderkey", "refs").select("o_orderkey", F.array_join("urls", " ").alias("urls"))


# --- Aggregates ---

PULSE = EV + f", f AS (SELECT created_at, coalesce({SQL_PERIOD.format(t=chr(84) + 'IMESTAMP ' + chr(39) + EVENTS_NOW + chr(39))}, false) AS p FROM disc_events WHERE created_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 1 DAY) SELECT " + ", ".join(
    [f"count(*) FILTER (WHERE p AND created_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL {i}) AS bucket_{n}, count(*) FILTER (WHERE created_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL {i}) AS fetched_{n}" for n, i in (("minute", "1 MINUTE"), ("hour", "1 HOUR"), ("day", "1 DAY"))]
) + ", count(*) FILTER (WHERE p) AS period_matched FROM f"


@query("agg_01_activity_pulse", PULSE)
def _(spark, d):
    return aggregates.activity_pulse(load(spark, d, "disc_events"), ts(EVENTS_NOW))


@query("agg_02_03_feed_payload", EV + "SELECT company_id, string_agg(event_id::VARCHAR, ',' ORDER BY created_at DESC, event_id DESC) AS ids, count(*) AS n FROM disc_events GROUP BY 1")
def _(spark, d):
    newest = F.sort_array(F.collect_list(F.struct("created_at", "event_id")), asc=False)
    g = load(spark, d, "disc_events").groupBy("company_id").agg(newest.alias("items"), F.count("*").alias("n"))
    payload = F.to_json(F.struct(F.col("n"), F.transform("items", lambda x: x["event_id"]).alias("events")))
    return g.withColumn("payload", payload).select("company_id", F.regexp_extract("payload", r'"events":\[([0-9,]*)\]', 1).alias("ids"), "n")


@query("agg_04_distinct_union", EACH_URL + " SELECT company_id, string_agg(DISTINCT url, ' ' ORDER BY url) AS urls FROM urls JOIN disc_events USING (event_id) GROUP BY 1")
def _(spark, d):
    u = media(load(spark, d, "disc_events")).select("company_id", F.explode("urls").alias("url"))
    return u.groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_set("url")), " ").alias("urls"))


@query("agg_05_key_counts", with_tables("event_documents") + "SELECT event_id, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds FROM (SELECT event_id, kind, count(*) AS n FROM event_documents GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    m = aggregates.key_counts(load(spark, d, "event_documents"), ["event_id"], "kind", "kinds")
    return m.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("kinds"))


@query("agg_06_url_outcomes", UL + "SELECT event_id, count(*) FILTER (WHERE raw_status LIKE 'done%') AS done, count(*) FILTER (WHERE raw_status LIKE 'failed%') AS failed, count(*) FILTER (WHERE raw_status LIKE 'skipped%') AS skipped FROM url_ledger GROUP BY 1")
def _(spark, d):
    s = text.coarse_status(F.col("raw_status"))
    return load(spark, d, "url_ledger").groupBy("event_id").agg(*[F.count_if(s == k).alias(k) for k in ("done", "failed", "skipped")])


HEALTH_AT = "2024-01-15 12:00:00"
HEALTH = (
    with_tables("scan_log", "disc_events", "work_queue")
    + f""", s AS (SELECT count(*) AS scans_w, coalesce(sum(vlm_calls), 0)::BIGINT AS vlm_calls_w, coalesce(sum(extract_errors), 0)::BIGINT AS extract_errors_w, coalesce(sum(failed_render), 0)::BIGINT AS failed_render_w, coalesce(sum(render_pages), 0)::BIGINT AS render_pages_w FROM scan_log WHERE ts <= TIMESTAMP '{HEALTH_AT}' AND ts > TIMESTAMP '{HEALTH_AT}' - INTERVAL 30 MINUTE),
  e AS (SELECT count(*) AS events_w FROM disc_events WHERE created_at <= TIMESTAMP '{HEALTH_AT}' AND created_at > TIMESTAMP '{HEALTH_AT}' - INTERVAL 30 MINUTE),
  a AS (SELECT round(epoch(TIMESTAMP '{HEALTH_AT}' - max(ts)) / 60, 1)::DOUBLE AS scan_age_min FROM scan_log WHERE ts <= TIMESTAMP '{HEALTH_AT}'),
  q AS (SELECT count(*) FILTER (WHERE status = 'running' AND lease_until < TIMESTAMP '{QUEUE_NOW}' - INTERVAL 6 MINUTE) AS orphan_leases, count(*) FILTER (WHERE status = 'failed') AS units_failed FROM work_queue)
  SELECT CASE WHEN vlm_calls_w >= 5 AND events_w = 0 THEN 'down' WHEN scan_age_min IS NULL OR scan_age_min > 60 THEN 'down' WHEN extract_errors_w > 0 THEN 'degraded' WHEN orphan_leases > 0 THEN 'degraded'
    WHEN failed_render_w >= 20 AND render_pages_w > 0 AND failed_render_w / render_pages_w > 0.25 THEN 'degraded' ELSE 'ok' END AS verdict, scan_age_min, scans_w, events_w, extract_errors_w, vlm_calls_w, orphan_leases, units_failed, failed_render_w, render_pages_w FROM s, e, a, q"""
)


@query("agg_07_to_10_fleet_health", HEALTH)
def _(spark, d):
    h = aggregates.fleet_health(load(spark, d, "scan_log"), load(spark, d, "disc_events"), load(spark, d, "work_queue"), ts(HEALTH_AT), ts(QUEUE_NOW))
    return h.drop("reason", "event_age_min", "units_failed_w")


@query(
    "agg_11_throughput",
    with_tables("scan_log") + f"SELECT sum(render_pages) / 6.0::DOUBLE AS c_r, sum(vlm_calls) / 6.0::DOUBLE AS c_v, CASE WHEN sum(vlm_calls + vlm_skipped) > 0 THEN sum(vlm_calls) / sum(vlm_calls + vlm_skipped)::DOUBLE ELSE 1.0 END AS hit_rate FROM scan_log WHERE ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 6 HOUR",
)
def _(spark, d):
    return aggregates.throughput(load(spark, d, "scan_log"), ts(EVENTS_NOW), 6)


@query("agg_12_unit_cost", WQ + "SELECT type, count(*) AS n, avg(duration_s) AS secs, avg(last_render_pages) AS pages, avg(last_vlm_calls) AS calls, avg(last_event_count) AS events FROM work_queue WHERE last_scanned_at IS NOT NULL GROUP BY 1")
def _(spark, d):
    return aggregates.unit_cost(load(spark, d, "work_queue"))


@query("agg_13_queue_depth", WQ + "SELECT type, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'failed') AS failed FROM work_queue GROUP BY 1")
def _(spark, d):
    return load(spark, d, "work_queue").groupBy("type").pivot("status", ["queued", "running", "failed"]).count().na.fill(0)


@query("agg_14_full_late", WQ + f"SELECT count(*) FILTER (WHERE type = 'full' AND status = 'queued' AND due_at <= TIMESTAMP '{QUEUE_NOW}') AS late FROM work_queue")
def _(spark, d):
    return load(spark, d, "work_queue").agg(F.count_if((F.col("type") == "full") & (F.col("status") == "queued") & (F.col("due_at") <= ts(QUEUE_NOW))).alias("late"))


@query(
    "agg_15_queue_summary",
    WQ
    + f"""SELECT type, count(*) AS total, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'queued' AND due_at <= TIMESTAMP '{QUEUE_NOW}') AS due_now, sum(last_event_count)::BIGINT AS events,
  count(*) FILTER (WHERE last_scanned_at IS NULL OR last_scanned_at < TIMESTAMP '{QUEUE_NOW}' - INTERVAL 1 DAY) AS remaining, floor(100.0 * count(*) FILTER (WHERE NOT (last_scanned_at IS NULL OR last_scanned_at < TIMESTAMP '{QUEUE_NOW}' - INTERVAL 1 DAY)) / count(*) + 0.5)::BIGINT AS coverage_pct FROM work_queue GROUP BY 1""",
)
def _(spark, d):
    return aggregates.queue_summary(load(spark, d, "work_queue"), ts(QUEUE_NOW), "1 DAY")


@query("agg_16_hourly_usage", with_tables("scan_log") + "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, sum(render_pages)::BIGINT AS pages, sum(vlm_calls)::BIGINT AS calls FROM scan_log GROUP BY 1")
def _(spark, d):
    return load(spark, d, "scan_log").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour")).agg(F.sum("render_pages").alias("pages"), F.sum("vlm_calls").alias("calls"))


@query(
    "agg_17_status_board",
    EV + "SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ("discovered", "partial", "rendering", "failed", "enriched", "dead_letter", "deferred")) + ", count(*) FILTER (WHERE media = '') AS no_url FROM disc_events",
)
def _(spark, d):
    states = ("discovered", "partial", "rendering", "failed", "enriched", "dead_letter", "deferred")
    return load(spark, d, "disc_events").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in states], F.count_if(F.col("media") == "").alias("no_url"))


@query("agg_18_json_key_presence", "SELECT event_type, count(*) FILTER (WHERE (props::JSON->>'k') IS NOT NULL) AS with_k FROM events GROUP BY 1")
def _(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count_if(F.get_json_object("props", "$.k").isNotNull()).alias("with_k"))


@query("agg_19_repeat_rate", EV + f"SELECT company_id, count(*) AS found, count(DISTINCT {sql_norm_title('title')} || '|' || {sql_norm_date('event_date')}) AS stored, (100 * (count(*) - count(DISTINCT {sql_norm_title('title')} || '|' || {sql_norm_date('event_date')}))) // count(*) AS repeat_pct FROM disc_events GROUP BY 1")
def _(spark, d):
    key = F.concat(text.norm_title(F.col("title")), F.lit("|"), dates.norm_date(F.col("event_date")))
    g = load(spark, d, "disc_events").groupBy("company_id").agg(F.count("*").alias("found"), F.count_distinct(key).alias("stored"))
    return g.withColumn("repeat_pct", F.floor(100 * (F.col("found") - F.col("stored")) / F.col("found")))


@query("agg_20_most_common", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, d):
    return aggregates.most_common(load(spark, d, "part"), "p_type", 5)


@query("agg_21_singleton_share", "SELECT avg((n = 1)::INT) AS share FROM (SELECT p_name, p_size, count(*) AS n FROM part GROUP BY 1, 2)")
def _(spark, d):
    return load(spark, d, "part").groupBy("p_name", "p_size").count().agg(F.avg((F.col("count") == 1).cast("int")).alias("share"))


@query("agg_22_stratum_rates", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS total, avg(n_chars) AS mean, (100 * count(*) FILTER (WHERE n_chars < 500)) // count(*) AS short_pct FROM documents GROUP BY 1")
def _(spark, d):
    return load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.avg("n_chars").alias("mean"), F.floor(100 * F.count_if(F.col("n_chars") < 500) / F.count("*")).alias("short_pct"))


@query("agg_23_histogram_with_missing", EV + "SELECT coalesce(CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 4 END, -1)::BIGINT AS iter, count(*) AS n FROM disc_events GROUP BY 1")
def _(spark, d):
    return load(spark, d, "disc_events").groupBy(F.coalesce(F.when(F.col("event_id") % 4 != 3, F.col("event_id") % 4), F.lit(-1)).alias("iter")).agg(F.count("*").alias("n"))


@query("agg_24_drop_reasons", EACH_URL + " SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'not_http' WHEN contains(url, '/Tracker?') THEN 'tracker' WHEN contains(url, '/rss/') THEN 'asset' ELSE 'kept' END AS reason FROM urls) GROUP BY 1")
def _(spark, d):
    u = F.col("url")
    reason = F.when(~u.rlike("^https?://"), "not_http").when(u.rlike(urls.TRACKER), "tracker").when(u.rlike(urls.NON_EVENT), "asset").otherwise("kept")
    return each_url(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "agg_25_size_histogram",
    "SELECT lang, count(*) FILTER (WHERE n_chars < 200) AS b0, count(*) FILTER (WHERE n_chars >= 200 AND n_chars < 1000) AS b200, count(*) FILTER (WHERE n_chars >= 1000 AND n_chars < 5000) AS b1000, count(*) FILTER (WHERE n_chars >= 5000) AS b5000, min(n_chars) AS least, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS p50, max(n_chars) AS most FROM documents GROUP BY 1",
)
def _(spark, d):
    return aggregates.size_histogram(load(spark, d, "documents"), "lang", "n_chars", (200, 1000, 5000))


@query("agg_26_numeric_density", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE NULL END::DOUBLE AS density FROM customer")
def _(spark, d):
    from ledgerloom.functions.nested import numeric_density

    n = F.col("c_custkey").cast("string")
    rows = F.when(F.col("c_custkey") % 3 == 0, F.array(F.array(n, F.lit("name")), F.array(F.lit(""), F.lit("")))).when(F.col("c_custkey") % 3 == 1, F.array(F.array(n, F.lit("(1,234.5)")))).otherwise(F.array(F.array(F.lit(""))))
    return load(spark, d, "customer").select("c_custkey", numeric_density(rows).alias("density"))


@query("agg_27_best_score", UL + "SELECT url, max(line * 0.1::DOUBLE) AS score FROM url_ledger GROUP BY 1")
def _(spark, d):
    return load(spark, d, "url_ledger").groupBy("url").agg(F.max(F.col("line") * 0.1).alias("score"))


@query("agg_28_weakest_link", "SELECT o_orderkey, greatest(coalesce(o_orderkey % 3, 2), coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 END, 2), 0)::BIGINT AS iter FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", aggregates.weakest_link(k % 3, F.when(k % 5 != 0, k % 2), F.lit(0)).cast("long").alias("iter"))


@query("agg_29_first_verdict", UL + "SELECT event_id, arg_min(raw_status, (line * 100000 + canon_key[2:]::BIGINT) * 1000 + ascii(raw_status)) FILTER (WHERE raw_status NOT LIKE 'done%') AS verdict FROM url_ledger GROUP BY 1")
def _(spark, d):
    order = F.col("line") * 100000 + F.substring("canon_key", 2, 20).cast("long")
    order = order * 1000 + F.ascii("raw_status")
    return load(spark, d, "url_ledger").groupBy("event_id").agg(F.min_by("raw_status", F.when(~F.col("raw_status").startswith("done"), order)).alias("verdict"))


# --- Windows ---

RECENT = "202[4-9]|20[3-9][0-9]"


@query(
    "win_01_hub_ranking",
    EV
    + f"""SELECT company_id, source_url, ev, recent_ev, rk FROM (SELECT company_id, source_url, count(*) AS ev, count(*) FILTER (WHERE regexp_matches(event_date, '{RECENT}')) AS recent_ev,
  row_number() OVER (PARTITION BY company_id ORDER BY count(*) FILTER (WHERE regexp_matches(event_date, '{RECENT}')) DESC, count(*), source_url) AS rk FROM disc_events WHERE source_url <> '' AND NOT regexp_matches(source_url, '{urls.FILINGS}') GROUP BY 1, 2) WHERE ev BETWEEN 2 AND 40 AND recent_ev >= 1 AND rk <= 2""",
)
def _(spark, d):
    return ordering.hub_ranking(load(spark, d, "disc_events"), top_k=2, recent=RECENT)


@query(
    "win_02_hubs_of_one_company",
    EV + "SELECT source_url, count(*) AS ev, row_number() OVER (ORDER BY count(*) DESC, source_url) AS rk FROM disc_events WHERE company_id = 8 AND source_url <> '' GROUP BY 1",
)
def _(spark, d):
    g = load(spark, d, "disc_events").where("company_id = 8 and source_url <> ''").groupBy("source_url").agg(F.count("*").alias("ev"))
    return g.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("ev"), "source_url")))


RESPACE = (
    EV
    + f""", pool AS (SELECT event_id, coalesce(regexp_extract(source_url, '://([^/]+)', 1), '') AS host, status = 'partial' AS bf, created_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR AS is_new, created_at FROM disc_events WHERE status IN ('discovered', 'failed', 'partial')),
  dealt AS (SELECT *, row_number() OVER (PARTITION BY host, is_new, bf ORDER BY created_at, event_id) AS seq, count(*) OVER (PARTITION BY host, is_new, bf) AS n_pop, count(*) OVER (PARTITION BY host) AS n_host FROM pool)
  SELECT event_id, CASE WHEN is_new THEN 0 ELSE 10000 END + (seq - 0.5::DOUBLE) * n_host / greatest(n_pop, 1) + ('0x' || substr(md5(host), 1, 8))::BIGINT % 1024 / 1024.0::DOUBLE AS queue_pos FROM dealt"""
)


@query("win_03_04_host_fair_dealing", RESPACE)
def _(spark, d):
    return ordering.host_fair_positions(load(spark, d, "disc_events"), ts(EVENTS_NOW))


@query("win_05_even_spacing", WQ + "SELECT id, (row_number() OVER (ORDER BY due_at, id) - 1) / count(*) OVER ()::DOUBLE * 8400 AS offset_s FROM work_queue WHERE type = 'incremental' AND status = 'queued'")
def _(spark, d):
    q = load(spark, d, "work_queue").where("type = 'incremental' and status = 'queued'")
    return ordering.even_spacing(q, ["due_at", "id"], F.col("due_at").cast("date"), 8400.0).select("id", "offset_s")


@query(
    "win_06_monotone_spacing",
    WQ + f"SELECT id, strftime(least(due_at, TIMESTAMP '{QUEUE_NOW}' + to_seconds(((row_number() OVER (ORDER BY last_scanned_at NULLS FIRST, id) - 1) * 604800 // count(*) OVER ())::BIGINT)), '%Y-%m-%d %H:%M:%S') AS due FROM work_queue WHERE type = 'full' AND status = 'queued'",
)
def _(spark, d):
    q = load(spark, d, "work_queue").where("type = 'full' and status = 'queued'")
    spaced = ordering.even_spacing(q, [F.col("last_scanned_at").asc_nulls_first(), "id"], F.col("last_scanned_at").cast("date"), 604800.0, whole=True)
    return spaced.select("id", F.date_format(F.least("due_at", ts(QUEUE_NOW) + F.make_dt_interval(secs=F.col("offset_s"))), "yyyy-MM-dd HH:mm:ss").alias("due"))


@query("win_07_spread_by_ordinal", with_tables("companies") + "SELECT company_id, ((row_number() OVER (ORDER BY company_id) - 1) * 604800 // count(*) OVER ())::BIGINT AS offset_s FROM companies")
def _(spark, d):
    return ordering.even_spacing(load(spark, d, "companies"), ["company_id"], F.floor(F.col("company_id") / 1024), 604800.0, whole=True).select("company_id", F.col("offset_s").cast("long").alias("offset_s"))


@query("win_08_sequence_numbers", EACH_URL + " SELECT event_id, pos AS ord, url FROM urls")
def _(spark, d):
    return each_url(spark, d).select("event_id", F.col("pos").cast("long").alias("ord"), "url")


@query(
    "win_10_column_islands",
    "WITH g AS (SELECT l_suppkey, l_quantity * 3 + l_linenumber AS x FROM lineitem), f AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY l_suppkey ORDER BY x) > 4.0 THEN 1 ELSE 0 END AS new FROM g), i AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY x ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT l_suppkey, island::BIGINT AS island, count(*) AS n, max(x) AS right_edge FROM i GROUP BY 1, 2",
)
def _(spark, d):
    words = load(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") * 3 + F.col("l_linenumber")).alias("x"))
    return ordering.islands(words, ["l_suppkey"], "x", 4.0).groupBy("l_suppkey", "island").agg(F.count("*").alias("n"), F.max("x").alias("right_edge"))


@query("win_11_median_pitch", "SELECT l_suppkey, median(gap) AS pitch FROM (SELECT l_suppkey, lead(x) OVER (PARTITION BY l_suppkey ORDER BY x) - x AS gap FROM (SELECT DISTINCT l_suppkey, l_extendedprice AS x FROM lineitem)) WHERE gap IS NOT NULL GROUP BY 1")
def _(spark, d):
    x = load(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("x")).distinct()
    gap = F.lead("x").over(Window.partitionBy("l_suppkey").orderBy("x")) - F.col("x")
    return x.withColumn("gap", gap).where("gap is not null").groupBy("l_suppkey").agg(F.percentile("gap", 0.5).alias("pitch"))


@query("win_12_first_seen_numbers", EACH_URL + ", f AS (SELECT company_id, url, min(event_id * 10 + pos) AS first FROM urls JOIN disc_events USING (event_id) GROUP BY 1, 2) SELECT company_id, url, 'L' || row_number() OVER (PARTITION BY company_id ORDER BY first) AS ref FROM f")
def _(spark, d):
    u = media(load(spark, d, "disc_events")).select("company_id", "event_id", F.posexplode("urls").alias("pos", "url"))
    first = u.groupBy("company_id", "url").agg(F.min(F.col("event_id") * 10 + F.col("pos")).alias("first"))
    return first.select("company_id", "url", F.concat(F.lit("L"), F.row_number().over(Window.partitionBy("company_id").orderBy("first")).cast("string")).alias("ref"))


# --- Ordering ---

PERIOD = "CASE WHEN last_scanned_at IS NULL THEN 1e9 ELSE epoch(TIMESTAMP '{0}' - last_scanned_at) / CASE WHEN type = 'full' THEN 604800.0 ELSE 8400.0 END END::DOUBLE"


@query("srt_01_deadline_fraction", WQ + f"SELECT id, {PERIOD.format(QUEUE_NOW)} AS urgency FROM work_queue WHERE status = 'queued' ORDER BY 2 DESC, due_at, id LIMIT 50")
def _(spark, d):
    return ordering.by_urgency(load(spark, d, "work_queue").where("status = 'queued'"), ts(QUEUE_NOW), t_star_s=8400.0).select("id", "urgency").limit(50)


@query("srt_02_claim_order", EV + "SELECT event_id FROM disc_events WHERE status = 'discovered' ORDER BY enrich_priority DESC, next_retry_at IS NOT NULL, queue_pos NULLS LAST, event_id LIMIT 32")
def _(spark, d):
    return ordering.claim_order(load(spark, d, "disc_events").where("status = 'discovered'")).select("event_id").limit(32)


@query("srt_03_capped_with_flag", EV + "SELECT event_id, true AS truncated FROM disc_events ORDER BY created_at DESC, event_id LIMIT 100")
def _(spark, d):
    return ordering.capped(load(spark, d, "disc_events"), [F.desc("created_at"), F.col("event_id")], 100).select("event_id", "truncated")


@query("srt_05_boosted_routes", f"SELECT page_id, CASE WHEN regexp_matches(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '{urls.EVENTS_HUB}') THEN 0.95 ELSE 0.5 END::DOUBLE AS score FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", urls.boosted_score(F.col("url"), F.lit(0.5)).alias("score"))


RANK = "CASE WHEN regexp_matches(u, '(?i)\\.pdf') THEN 1 WHEN regexp_matches(u, '(?i)\\.mp[34]') THEN 2 ELSE 0 END"


@query("srt_06_stable_kind_order", EACH_URL + f", r AS (SELECT event_id, url AS u, pos, {RANK.replace('u,', 'url,')} AS rank FROM urls) SELECT event_id, string_agg(u, ' ' ORDER BY rank, pos) AS ordered FROM r GROUP BY 1")
def _(spark, d):
    return media(load(spark, d, "disc_events")).where(F.size("urls") > 0).select("event_id", F.array_join(ordering.by_rank(F.col("urls"), ordering.kind_rank), " ").alias("ordered"))


@query("srt_07_stream_ranking", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a.mp3 b.m3u8 c.mp4 z.bin' ELSE 'b.m3u8 c.mp4' END AS ordered FROM orders")
def _(spark, d):
    streams = F.when(F.col("o_orderkey") % 2 == 0, F.array(*map(F.lit, ("z.bin", "c.mp4", "s-1.ts", "b.m3u8", "a.mp3")))).otherwise(F.array(*map(F.lit, ("c.mp4", "b.m3u8", "x.m4s"))))
    return load(spark, d, "orders").select("o_orderkey", F.array_join(ordering.ranked_streams(streams), " ").alias("ordered"))


@query("srt_08_next_up", WQ + f"SELECT type, id, rk FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY due_at, id) AS rk FROM work_queue WHERE status = 'queued' AND due_at > TIMESTAMP '{QUEUE_NOW}') WHERE rk <= 5")
def _(spark, d):
    q = load(spark, d, "work_queue").where((F.col("status") == "queued") & (F.col("due_at") > ts(QUEUE_NOW)))
    return ordering.top_per_group(q, ["type"], ["due_at", "id"], 5).select("type", "id", "rk")


@query("srt_09_hash_order", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR) LIMIT 50")
def _(spark, d):
    return load(spark, d, "documents").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(50).select("doc_id")


@query("srt_10_random_sample", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id::VARCHAR), doc_id LIMIT 20")
def _(spark, d):
    return load(spark, d, "documents").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id").limit(20).select("doc_id")


@query("srt_11_offset_page", EV + "SELECT event_id FROM disc_events ORDER BY created_at DESC, event_id LIMIT 25 OFFSET 50")
def _(spark, d):
    return load(spark, d, "disc_events").orderBy(F.desc("created_at"), "event_id").offset(50).limit(25).select("event_id")


# --- Upserts ---

KEYED = f"""keyed AS (SELECT event_id, company_id, {sql_norm_title('title')} || '|' || {sql_norm_date('event_date')} AS dedup_key, title, source_url, media FROM disc_events)"""


@query(
    "ups_01_merge_upsert",
    EV
    + ", "
    + KEYED
    + """, g AS (SELECT company_id, dedup_key, min(event_id) AS event_id, arg_min(title, event_id) AS title, arg_min(source_url, event_id) FILTER (WHERE source_url <> '') AS source_url,
  list_sort(list_distinct(list_filter(flatten(list(string_split(media, '|'))), lambda u: u <> ''))) AS urls FROM keyed GROUP BY 1, 2) SELECT company_id, dedup_key, event_id, title, source_url, array_to_string(urls, ' ') AS urls FROM g""",
)
def _(spark, d):
    e = media(load(spark, d, "disc_events")).withColumn("dedup_key", F.concat(text.norm_title(F.col("title")), F.lit("|"), dates.norm_date(F.col("event_date")))).select("event_id", "company_id", "dedup_key", "title", "source_url", "urls")
    out = upserts.merge_upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["company_id", "dedup_key"], version="event_id", unions=["urls"], first_filled=["source_url"], keep=["title"])
    return out.select("company_id", "dedup_key", "event_id", "title", "source_url", F.array_join("urls", " ").alias("urls"))


@query("ups_02_latest_wins", UL + "SELECT url, arg_max(raw_status, (event_id * 10 + line) * 1000 + ascii(raw_status)) AS raw_status FROM url_ledger GROUP BY 1")
def _(spark, d):
    return upserts.latest(load(spark, d, "url_ledger").withColumn("v", (F.col("event_id") * 10 + F.col("line")) * 1000 + F.ascii("raw_status")), ["url"], "v").select("url", "raw_status")


@query("ups_03_insert_if_absent", UL + "SELECT DISTINCT event_id, canon_key FROM url_ledger")
def _(spark, d):
    k = load(spark, d, "url_ledger").select("event_id", "canon_key").distinct()
    return upserts.insert_absent(k.where("event_id % 3 = 0"), k.where("event_id % 2 = 0").unionByName(k), ["event_id", "canon_key"])


@query("ups_04_never_downgrade", UL + "SELECT event_id, canon_key, CASE WHEN count(*) FILTER (WHERE raw_status LIKE 'done%') > 0 THEN 'done' ELSE split_part(arg_max(raw_status, line * 1000 + ascii(raw_status)), ':', 1) END AS status FROM url_ledger GROUP BY 1, 2")
def _(spark, d):
    u = load(spark, d, "url_ledger").withColumn("status", text.coarse_status(F.col("raw_status"))).withColumn("v", F.col("line") * 1000 + F.ascii("raw_status"))
    return upserts.never_downgrade(u, ["event_id", "canon_key"], "status", "done", "v").select("event_id", "canon_key", "status")


@query("ups_05_first_in_batch", EV + ", " + KEYED + " SELECT company_id, dedup_key, min(event_id) AS event_id FROM keyed GROUP BY 1, 2")
def _(spark, d):
    e = load(spark, d, "disc_events").withColumn("dedup_key", F.concat(text.norm_title(F.col("title")), F.lit("|"), dates.norm_date(F.col("event_date"))))
    return ordering.top_per_group(e, ["company_id", "dedup_key"], ["event_id"], 1).select("company_id", "dedup_key", "event_id")


@query("ups_06_key_reuse", OVERLAP.replace("SELECT b.event_id, min(a.event_id) AS reuses FROM k b", "SELECT b.event_id, coalesce(min(a.event_id), b.event_id) AS key_of FROM (SELECT DISTINCT event_id, company_id, day, canon FROM k) b").replace("JOIN k a ON", "LEFT JOIN k a ON"))
def _(spark, d):
    e = media(load(spark, d, "disc_events")).where("event_date is not null").withColumn("day", dates.norm_date(F.col("event_date")))
    new = e.where("event_id % 24 >= 12").where(F.exists("urls", lambda u: F.lower(u).startswith("http")))
    hit = joins.url_overlap(new, e.where("event_id % 24 < 12"), ["company_id", "day"])
    return new.join(hit, "event_id", "left").select("event_id", F.coalesce("hit", "event_id").alias("key_of"))


@query("ups_07_rekey_with_merge", EV + f", k AS (SELECT event_id, company_id, left({sql_norm_title('title')}, 6) AS dedup_key, media FROM disc_events) SELECT company_id, dedup_key, min(event_id) AS winner, count(*) - 1 AS losers FROM k GROUP BY 1, 2")
def _(spark, d):
    e = load(spark, d, "disc_events").withColumn("dedup_key", F.substring(text.norm_title(F.col("title")), 1, 6))
    return e.groupBy("company_id", "dedup_key").agg(F.min("event_id").alias("winner"), (F.count("*") - 1).alias("losers"))


@query("ups_08_repair_with_before_image", EV + "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Fixed' ELSE title END AS title, CASE WHEN event_id % 3 = 0 THEN title END AS before FROM disc_events")
def _(spark, d):
    e = load(spark, d, "disc_events").withColumn("new_title", F.when(F.col("event_id") % 3 == 0, "Fixed").otherwise(""))
    out = upserts.repair(e, {"title": "new_title"})
    return out.select("event_id", "title", F.col("meta_fixed")["title"].alias("before"))


@query("ups_09_fenced_completion", WQ + "SELECT id, CASE WHEN id % 7 = id % 5 THEN 'queued' ELSE status END AS status FROM work_queue")
def _(spark, d):
    q = load(spark, d, "work_queue")
    done = q.select("id", F.concat(F.lit("tok"), (F.col("id") % 5).cast("string")).alias("claim_token"), F.lit("queued").alias("new_status"))
    return upserts.fenced(q, done, "id", "claim_token", {"status": "new_status"}).select("id", "status")


@query(
    "ups_10_backoff",
    EV + "SELECT event_id, CASE WHEN fail_count + 1 >= 3 THEN 'dead_letter' ELSE 'failed' END AS status, 30 * power(2, fail_count)::DOUBLE + ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 1024 / 1024.0::DOUBLE * 10 AS delay_s FROM disc_events WHERE status = 'rendering'",
)
def _(spark, d):
    return upserts.backoff(load(spark, d, "disc_events").where("status = 'rendering'"), "event_id").select("event_id", "status", "delay_s")


@query("ups_11_attempt_cap", WQ + "SELECT id, CASE WHEN attempt >= 4 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN attempt >= 4 THEN 0 ELSE 300 END AS wait_s FROM work_queue WHERE status = 'running'")
def _(spark, d):
    q = load(spark, d, "work_queue").where("status = 'running'")
    return q.select("id", F.when(F.col("attempt") >= 4, "failed").otherwise("queued").alias("status"), F.when(F.col("attempt") >= 4, 0).otherwise(300).alias("wait_s"))


@query("ups_12_rearm", WQ + "SELECT id, 'queued' AS status, strftime(due_at + to_seconds(CASE WHEN type = 'full' THEN 604800 ELSE 8400 END), '%Y-%m-%d %H:%M:%S') AS due FROM work_queue")
def _(spark, d):
    return upserts.rearm(load(spark, d, "work_queue"), 8400).select("id", "status", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss").alias("due"))


@query("ups_13_14_reclaim", WQ + f"SELECT id, CASE WHEN status = 'running' AND lease_until < TIMESTAMP '{QUEUE_NOW}' THEN 'queued' WHEN status = 'failed' AND updated_at < TIMESTAMP '{QUEUE_NOW}' - INTERVAL 6 HOUR THEN 'queued' ELSE status END AS status, CASE WHEN status = 'failed' AND updated_at < TIMESTAMP '{QUEUE_NOW}' - INTERVAL 6 HOUR THEN 0 ELSE attempt END AS attempt FROM work_queue")
def _(spark, d):
    return upserts.reclaim(load(spark, d, "work_queue"), ts(QUEUE_NOW)).select("id", "status", "attempt")


@query("ups_15_retire", EV + "SELECT event_id, CASE WHEN media = '' OR (NOT contains(media, '|') AND media = source_url) THEN 'deferred' ELSE status END AS status FROM disc_events")
def _(spark, d):
    e = media(load(spark, d, "disc_events"))
    nothing = (F.size("urls") == 0) | ((F.size("urls") == 1) & (F.get("urls", F.lit(0)) == F.col("source_url")))
    return e.select("event_id", F.when(nothing, "deferred").otherwise(F.col("status")).alias("status"))


@query("ups_16_changed_only", EV + "SELECT event_id FROM disc_events WHERE (CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 4 END) IS DISTINCT FROM fail_count")
def _(spark, d):
    new = F.when(F.col("event_id") % 8 != 0, F.col("event_id") % 4)
    return load(spark, d, "disc_events").where(~F.col("fail_count").eqNullSafe(new)).select("event_id")


@query("ups_17_claim_batch", EV + "SELECT event_id, sha256('b7:' || event_id) AS claim_token FROM (SELECT event_id FROM disc_events WHERE status = 'discovered' ORDER BY enrich_priority DESC, next_retry_at IS NOT NULL, queue_pos NULLS LAST, event_id LIMIT 16)")
def _(spark, d):
    return upserts.claim_batch(ordering.claim_order(load(spark, d, "disc_events").where("status = 'discovered'")), "event_id", "b7", 16).select("event_id", "claim_token")


@query("ups_19_cascade", UL + "SELECT event_id, line, canon_key FROM url_ledger WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    gone = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("event_id"))
    return load(spark, d, "url_ledger").join(gone, "event_id", "left_anti").select("event_id", "line", "canon_key")


@query("ups_20_ordered_dedup", EV + f"SELECT event_id, nullif({ONE_URL}[1], '') AS first FROM disc_events")
def _(spark, d):
    first = F.get(F.array_distinct(F.concat("urls", "urls")), F.lit(0))
    return media(load(spark, d, "disc_events")).select("event_id", first.alias("first"))


@query(
    "ups_21_line_union",
    r"WITH l AS (SELECT doc_id, trim(line) AS line, min(pos) AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) GROUP BY 1, 2) SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS h FROM l GROUP BY 1",
)
def _(spark, d):
    lines = F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)))
    return load(spark, d, "documents").select("doc_id", F.md5(F.array_join(lines, "\n")).alias("h"))


@query("ups_22_graph_merge", EV + "SELECT company_id, count(DISTINCT lower(title)) AS mentions, bool_or(event_id % 29 = 0) AS mismatch FROM disc_events GROUP BY 1")
def _(spark, d):
    return load(spark, d, "disc_events").groupBy("company_id").agg(F.count_distinct(F.lower("title")).alias("mentions"), F.bool_or(F.col("event_id") % 29 == 0).alias("mismatch"))
