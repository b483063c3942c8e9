"""Queries over predicates, text, URL, date, hash and JSON functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import dates, text, urls
from ledgerloom.plans.domain import EVENTS_NOW, QUEUE_NOW, load, ts, with_tables
from ledgerloom.registry import query

EV = with_tables("disc_events")
WQ = with_tables("work_queue")
UL = with_tables("url_ledger")


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def picked(values, key: str) -> F.Column:
    """The value whose turn it is by a key, so that rows go through all of them."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def sql_picked(values, key: str) -> str:
    listed = ", ".join("NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({key} % {len(values)} + 1)::INT]"


def sql_scheme(u: str) -> str:
    return f"(CASE WHEN starts_with(lower({u}), 'http') THEN {u} ELSE 'https://' || {u} END)"


def sql_netloc(u: str) -> str:
    return f"lower(regexp_extract({sql_scheme(u)}, '://([^/?#]*)', 1))"


def sql_path(u: str) -> str:
    return f"regexp_extract({sql_scheme(u)}, '://[^/?#]*([^?#]*)', 1)"


def sql_query(u: str) -> str:
    return f"regexp_extract({sql_scheme(u)}, '://[^?#]*\\?([^#]*)', 1)"


def sql_canon(u: str) -> str:
    return (
        f"(lower(regexp_extract({sql_scheme(u)}, '^([^:]+)://', 1)) || '://' || {sql_netloc(u)} || regexp_replace({sql_path(u)}, '/+$', '')"
        f" || CASE WHEN {sql_query(u)} <> '' THEN '?' || {sql_query(u)} ELSE '' END)"
    )


def sql_ext(u: str) -> str:
    return f"(CASE WHEN contains(regexp_extract({sql_path(u)}, '([^/]*)$', 1), '.') THEN lower(regexp_extract(regexp_extract({sql_path(u)}, '([^/]*)$', 1), '\\.([^.]*)$', 1)) ELSE '' END)"


def sql_registrable(h: str) -> str:
    parts = f"string_split(lower({h}), '.')"
    return f"(CASE WHEN len({parts}) >= 3 AND array_to_string({parts}[-2:], '.') IN ({quoted(urls.TWO_PART_SUFFIXES)}) THEN array_to_string({parts}[-3:], '.') WHEN len({parts}) >= 2 THEN array_to_string({parts}[-2:], '.') ELSE {parts}[1] END)"


def sql_norm_date(d: str) -> str:
    return f"(CASE WHEN regexp_matches(lower(trim(coalesce({d}, ''))), '^\\d{{4}}-\\d\\d-\\d\\dt') THEN split_part(lower(trim(coalesce({d}, ''))), 't', 1) ELSE lower(trim(coalesce({d}, ''))) END)"


def sql_norm_title(t: str) -> str:
    return f"regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9]+', '', 'g')"


def java_to_re2(pattern: str) -> str:
    return pattern.replace("'", "''")


ONE_URL = "string_split(media, '|')"
SQL_UNWRAP = "(CASE WHEN regexp_extract(trim({0}), '^\\[[^\\]]*\\]\\((https?://[^)\\s]+)\\)', 1) <> '' THEN regexp_extract(trim({0}), '^\\[[^\\]]*\\]\\((https?://[^)\\s]+)\\)', 1) ELSE trim({0}) END)"


def media(df):
    return df.withColumn("urls", F.filter(F.split("media", r"\|"), lambda u: u != ""))


def each_url(spark, d):
    return media(load(spark, d, "disc_events")).select("event_id", F.posexplode("urls").alias("pos", "url"))


EACH_URL = EV + ", urls AS (SELECT event_id, unnest(list_filter(string_split(media, '|'), lambda u: u <> '')) AS url, unnest(range(len(list_filter(string_split(media, '|'), lambda u: u <> '')))) AS pos FROM disc_events)"


# --- Predicates ---


@query("flt_01_pruned_projection", EV + "SELECT event_id, event_type, event_date FROM disc_events WHERE props IS NOT NULL")
def _(spark, d):
    return load(spark, d, "disc_events").where("props is not null").select("event_id", "event_type", "event_date")


@query("flt_02_has_media", EV + "SELECT event_id, len(list_filter(string_split(media, '|'), lambda u: u <> ''))::BIGINT AS n_urls FROM disc_events WHERE media <> ''")
def _(spark, d):
    return media(load(spark, d, "disc_events")).where(F.size("urls") > 0).select("event_id", F.size("urls").cast("long").alias("n_urls"))


def enrich_claimable(df, now):
    """Rows that enrichment may claim: fresh, partial, lapsed or due again; with an address, not a filing, not only its own source."""
    state = (
        F.col("status").isin("discovered", "partial") | ((F.col("status") == "rendering") & (F.col("lease_until") < now)) | ((F.col("status") == "failed") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
    )
    own = (F.size("urls") == 1) & (F.get("urls", F.lit(0)) == F.col("source_url"))
    return df.where(state & ~F.col("source_url").rlike(urls.FILINGS) & (F.size("urls") > 0) & ~own)


@query(
    "flt_03_enrichment_claimable",
    EV
    + f"""SELECT event_id, status FROM disc_events WHERE (status IN ('discovered', 'partial') OR (status = 'rendering' AND lease_until < TIMESTAMP '2024-01-15') OR (status = 'failed' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-15')))
  AND NOT regexp_matches(source_url, '{urls.FILINGS}') AND media <> '' AND NOT (NOT contains(media, '|') AND media = source_url)""",
)
def _(spark, d):
    return enrich_claimable(media(load(spark, d, "disc_events")), ts("2024-01-15 00:00:00")).select("event_id", "status")


@query("flt_04_work_claimable", WQ + f"SELECT id, type FROM work_queue WHERE (status = 'queued' OR (status = 'running' AND lease_until < TIMESTAMP '{QUEUE_NOW}')) AND due_at <= TIMESTAMP '{QUEUE_NOW}' AND type = 'full'")
def _(spark, d, unit_type="full"):
    now = ts(QUEUE_NOW)
    out = load(spark, d, "work_queue").where((F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until") < now))).where(F.col("due_at") <= now)
    return (out.where(F.col("type") == unit_type) if unit_type else out).select("id", "type")


@query("flt_05_optional_parameter", EV + "SELECT run_id, count(*) AS n FROM disc_events WHERE (NULL IS NULL OR run_id = NULL) GROUP BY run_id")
def _(spark, d, run_id=None):
    df = load(spark, d, "disc_events")
    return (df if run_id is None else df.where(F.col("run_id") == run_id)).groupBy("run_id").agg(F.count("*").alias("n"))


@query("flt_06_not_filings", EV + f"SELECT event_id, source_url FROM disc_events WHERE NOT regexp_matches(source_url, '{urls.FILINGS}')")
def _(spark, d):
    return load(spark, d, "disc_events").where(~F.col("source_url").rlike(urls.FILINGS)).select("event_id", "source_url")


@query("flt_07_date_shape", EV + r"SELECT event_id, event_date FROM disc_events WHERE NOT regexp_matches(event_date, '(?i)^(\d{4})(?:-(?:Q[1-4]|\d{2}(?:-\d{2})?))?$')")
def _(spark, d):
    return load(spark, d, "disc_events").where(~F.col("event_date").rlike(dates.SHAPE)).select("event_id", "event_date")


SQL_PERIOD = """(event_date IN (strftime({t}, '%Y') || '-Q' || quarter({t}), strftime({t} - INTERVAL 3 MONTH, '%Y') || '-Q' || quarter({t} - INTERVAL 3 MONTH), strftime({t}, '%Y-%m'), strftime({t}, '%Y'))
  OR (regexp_matches(event_date, '^\\d{{4}}-(FY|H[12])$') AND left(event_date, 4) = strftime({t}, '%Y')) OR (regexp_matches(event_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND coalesce(TRY_CAST(event_date AS DATE) = CAST({t} AS DATE), false)))"""


@query("flt_08_period_is_current", EV + "SELECT event_id, event_date, " + SQL_PERIOD.format(t=f"TIMESTAMP '{EVENTS_NOW}'") + " AS period_now FROM disc_events")
def _(spark, d):
    return load(spark, d, "disc_events").select("event_id", "event_date", dates.period_now(F.col("event_date"), ts(EVENTS_NOW)).alias("period_now"))


@query("flt_09_valid_date", EV + r"SELECT event_id, CASE WHEN regexp_matches(event_date, '^\d{4}-\d{2}-\d{2}$') THEN TRY_CAST(event_date AS DATE) IS NOT NULL ELSE false END AS valid FROM disc_events WHERE event_date IS NOT NULL")
def _(spark, d):
    c = F.col("event_date")
    return load(spark, d, "disc_events").where(c.isNotNull()).select("event_id", (c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull()).alias("valid"))


@query("flt_10_relative_window", EV + f"SELECT event_id FROM disc_events WHERE created_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 36 HOUR")
def _(spark, d):
    return load(spark, d, "disc_events").where(F.col("created_at") > ts(EVENTS_NOW) - F.expr("INTERVAL 36 HOURS")).select("event_id")


@query("flt_11_length_range", "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 800 AND 60000 AND length(source) < 60")
def _(spark, d):
    return load(spark, d, "documents").where(F.col("n_chars").between(800, 60000) & (F.length("source") < 60)).select("doc_id", "n_chars")


@query("flt_12_fuzzy_name", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%red%' AND p_name ILIKE '%wid%' OR p_name ILIKE '%RING%'")
def _(spark, d):
    from functools import reduce

    c = F.col("p_name")
    every, some = [c.ilike(f"%{k}%") for k in ("red", "wid")], [c.ilike(f"%{k}%") for k in ("RING",)]
    return load(spark, d, "part").where(reduce(lambda a, b: a & b, every) | reduce(lambda a, b: a | b, some)).select("p_partkey", "p_name")


@query("flt_13_in_list", WQ + "SELECT id, status FROM work_queue WHERE company_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def _(spark, d):
    wanted = load(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("company_id"))
    return load(spark, d, "work_queue").join(wanted, "company_id", "left_semi").select("id", "status")


@query("flt_14_scheme_guard", EACH_URL + " SELECT event_id, pos, url FROM urls WHERE regexp_matches(url, '(?i)^https?://')")
def _(spark, d):
    return each_url(spark, d).where(F.col("url").rlike("(?i)^https?://"))


@query("flt_15_limit_clamp", "SELECT o_orderkey AS id, least(greatest(coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 900 END, 100), 1), 500)::BIGINT AS lim FROM orders")
def _(spark, d):
    asked = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 900)
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.least(F.greatest(F.coalesce(asked, F.lit(100)), F.lit(1)), F.lit(500)).alias("lim"))


for _name, _pattern in (("flt_16_non_event_url", urls.NON_EVENT), ("flt_17_tracker_url", urls.TRACKER)):

    @query(_name, EACH_URL + f" SELECT event_id, pos, url FROM urls WHERE regexp_matches(url, '{java_to_re2(_pattern)}')")
    def _(spark, d, pattern=_pattern):
        return each_url(spark, d).where(F.col("url").rlike(pattern))


@query("flt_18_noise_route", f"SELECT page_id, url, len(list_intersect(string_split(lower({sql_path('url')}), '/'), [{quoted(urls.NOISE_SEGMENTS)}])) > 0 AS noise FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", "url", urls.is_noise_route(F.col("url")).alias("noise"))


@query("flt_19_binary_route", UL + f"SELECT event_id, line, canon_key, url FROM url_ledger WHERE regexp_matches({sql_path('url')}, '{java_to_re2(urls.BINARY_ROUTE)}') OR regexp_matches({sql_path('url')}, '{java_to_re2(urls.DOCUMENT_PATH)}')")
def _(spark, d):
    return load(spark, d, "url_ledger").where(urls.is_binary_route(F.col("url"))).select("event_id", "line", "canon_key", "url")


@query("flt_20_same_site", f"SELECT page_id, {sql_registrable(sql_netloc('url'))} = 'example.com' AS same FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", urls.same_site(F.col("url"), F.lit("https://ir.example.com/")).alias("same"))


#: What pages' sites are asked for beside the pages themselves, so that each rule meets both cases.
IR_ENDS = ("", "/", "/investors/", "/investor-relations/events-and-presentations", "/ir/q1.pdf", "/careers/ir/", "/about", "/Quarterly-results")
CANDIDATES = (
    "WITH candidates AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) || ["
    + quoted(IR_ENDS)
    + f"][page_id % {len(IR_ENDS)} + 1] FROM pages UNION ALL SELECT page_id, 'https://c' || page_id || '.q4web.com/events/' FROM pages)"
)


@query(
    "flt_21_ir_candidates",
    CANDIDATES
    + f""", c AS (SELECT page_id, {sql_canon('url')} AS canon FROM candidates WHERE NOT regexp_matches(url, '{java_to_re2(urls.IR_MATERIAL)}') AND NOT regexp_matches(url, '{java_to_re2(urls.NON_IR_PATH)}')
    AND ({sql_registrable(sql_netloc('url'))} = 'example.com' OR regexp_matches({sql_netloc('url')}, '{java_to_re2(urls.IR_PLATFORM)}')) AND ({sql_path('url')} IN ('', '/') OR regexp_matches({sql_path('url')}, '{java_to_re2(urls.IR_PATH)}')))
  SELECT min(page_id) AS page_id, canon FROM c GROUP BY canon ORDER BY 1, 2 LIMIT 120""",
)
def _(spark, d):
    p = load(spark, d, "pages")
    ends = F.array(*map(F.lit, IR_ENDS))
    end = F.element_at(ends, (F.col("page_id") % len(IR_ENDS) + 1).cast("int"))
    platform = F.concat(F.lit("https://c"), F.col("page_id").cast("string"), F.lit(".q4web.com/events/"))
    every = p.select("page_id", "url").unionByName(p.select("page_id", F.concat(F.regexp_extract("url", "^(https?://[^/]*)", 1), end).alias("url"))).unionByName(p.select("page_id", platform.alias("url")))
    c = every.where(urls.is_ir_candidate(F.col("url"), F.lit("https://example.com")))
    return c.groupBy(urls.canon_url(F.col("url")).alias("canon")).agg(F.min("page_id").alias("page_id")).orderBy("page_id", "canon").limit(120).select("page_id", "canon")


@query(
    "flt_22_expandable",
    "SELECT page_id, NOT regexp_matches(url, '" + urls.LEAF + "') AND (len(list_distinct(regexp_extract_all(html, '" + urls.YEAR_CONTROL.replace("'", "''") + "', 1))) >= 2 OR regexp_matches(html, '" + urls.MORE_CONTROL.replace("'", "''") + "')) AS expandable FROM pages",
)
def _(spark, d):
    return load(spark, d, "pages").select("page_id", urls.should_expand(F.col("url"), F.col("html")).alias("expandable"))


@query(
    "flt_23_walled_or_thin",
    "SELECT doc_id, "
    + " OR ".join(f"contains(lower(text), '{m}')" for m in text.WALL_MARKERS)
    + r" AS challenge, length(trim(text)) < 200 OR len(regexp_extract_all(text, '[.。][ \t" + "\"''”)" + r"\]]|\.[A-Z]')) < 2 AS thin FROM documents",
)
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", text.is_challenge(F.col("text")).alias("challenge"), text.is_thin(F.col("text")).alias("thin"))


@query("flt_24_binary_text", "SELECT doc_id, regexp_matches(text, '^(%PDF-|PK\\x03\\x04|GIF8|ID3|OggS|fLaC)') OR len(regexp_extract_all(left(text, 2000), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) > 0.05 * length(left(text, 2000)) AS looks_binary FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", text.looks_binary(F.col("text")).alias("looks_binary"))


@query("flt_25_not_text", r"SELECT doc_id, regexp_matches(ltrim(text), '^(\{\\rtf|%PDF|PK\x03\x04)') AS not_text FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.ltrim("text").rlike(r"^(\{\\rtf|%PDF|PK\x03\x04)").alias("not_text"))


@query("flt_26_all_deferred", UL + "SELECT event_id, bool_and(starts_with(raw_status, 'skipped')) AS deferred FROM url_ledger GROUP BY event_id")
def _(spark, d):
    return load(spark, d, "url_ledger").groupBy("event_id").agg(F.bool_and(F.col("raw_status").startswith("skipped")).alias("deferred"))


@query("flt_27_nothing_usable", with_tables("scan_log") + "SELECT scan_id FROM scan_log WHERE failed_render > 0 AND n_events = 0 AND render_pages <= failed_render")
def _(spark, d):
    return load(spark, d, "scan_log").where("failed_render > 0 and n_events = 0 and render_pages <= failed_render").select("scan_id")


# --- Text ---


@query("txt_01_norm_title", EV + f"SELECT event_id, {sql_norm_title('title')} AS t FROM disc_events")
def _(spark, d):
    return load(spark, d, "disc_events").select("event_id", text.norm_title(F.col("title")).alias("t"))


SQL_KEY = f"CASE WHEN {sql_norm_title('title')} <> '' THEN {sql_norm_title('title')} || '|' || {sql_norm_date('event_date')} WHEN media <> '' THEN {sql_canon(ONE_URL + '[1]')} ELSE '' END"


@query("txt_02_event_key", EV + f"SELECT event_id, {SQL_KEY} AS k FROM disc_events")
def _(spark, d):
    return media(load(spark, d, "disc_events")).select("event_id", urls.event_key(F.col("title"), F.col("event_date"), F.col("urls")).alias("k"))


@query("txt_03_norm_words", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS h FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(text.norm_words(F.col("text"))).alias("h"))


@query(
    "txt_06_unwrap_markdown",
    EACH_URL + " SELECT event_id, pos, " + SQL_UNWRAP.format("url") + " AS bare FROM urls",
)
def _(spark, d):
    return each_url(spark, d).select("event_id", "pos", urls.unwrap_markdown(F.col("url")).alias("bare"))


@query(
    "txt_10_fixed_step_chunks",
    """WITH d AS (SELECT doc_id, text, greatest(ceil(length(text) / 4000.0)::BIGINT, 1) AS n FROM documents), s AS (SELECT *, ceil(length(text) / n::DOUBLE)::BIGINT AS step, unnest(range(n)) AS i FROM d)
  SELECT doc_id, i AS block, md5(CASE WHEN i = 0 THEN substr(text, 1, step) ELSE left(text, 1000) || substr(text, greatest(i * step - 1500, 0) + 1, step + least(i * step, 1500)) END) AS h FROM s""",
)
def _(spark, d):
    blocks = text.chunks(F.col("text"), 4000, 1500, 1000)
    return load(spark, d, "documents").select("doc_id", F.posexplode(blocks).alias("block", "b")).select("doc_id", F.col("block").cast("long").alias("block"), F.md5("b").alias("h"))


@query(
    "txt_11_12_cjk_cap",
    EV
    + """, r AS (SELECT event_id, CASE WHEN length(title) > 0 THEN len(regexp_extract_all(left(title, 4000), '[　-鿿가-힯＀-￯]')) / length(left(title, 4000))::DOUBLE ELSE 0.0 END AS ratio FROM disc_events)
  SELECT event_id, ratio, CASE WHEN ratio > 0.05 THEN floor(40000 * (1.0::DOUBLE - 0.64::DOUBLE * ratio))::BIGINT ELSE 40000 END AS cap FROM r""",
)
def _(spark, d):
    return load(spark, d, "disc_events").select("event_id", text.cjk_ratio(F.col("title")).alias("ratio"), text.text_cap(F.col("title")).alias("cap"))


@query("txt_13_token_budget", f"SELECT doc_id, length(left(text, {text.token_budget(8192, 4096)}))::BIGINT AS n FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.length(F.substring("text", 1, text.token_budget(8192, 4096))).cast("long").alias("n"))


#: Titles that fire each rule, or just fail to, beside whole texts and accession numbers.
ODD_TITLES = (" Home ", "ab", "Investor Relations", "Just a moment...", "Are you a human?", "Slide 12", "投影片3", "Presentation", "Slide deck 12", "Error | page", "Error in the report", "error", "Cloudflare", "Attention Required!", "q1.XLSX", "q1.pdf", "0a1b2c3d-aaaa-bbbb", "Universal Registration Document", "404")
TITLES = (
    "WITH titles AS (SELECT doc_id, unnest([0, 1, 2])::BIGINT AS n, unnest([text, lpad(doc_id::VARCHAR, 10, '0') || '-24-' || lpad((doc_id % 1000)::VARCHAR, 6, '0'), ["
    + quoted(ODD_TITLES)
    + f"][doc_id % {len(ODD_TITLES)} + 1]]) AS t FROM documents)"
)


@query(
    "txt_15_generic_or_machine_title",
    TITLES
    + f""" SELECT doc_id, n, lower(trim(t)) IN ({quoted(text.GENERIC_TITLES)}) OR contains(lower(t), 'just a moment') OR contains(lower(t), 'are you a human') OR length(trim(t)) < 3 AS generic,
  regexp_matches(trim(t), '{text.ACCESSION_NUMBER}') OR regexp_matches(trim(t), '{text.HEX_ID}') AS machine,
  regexp_matches(trim(t), '{text.ACCESSION_NUMBER}') OR regexp_matches(trim(t), '{text.HEX_ID}') OR lower(trim(t)) IN ('error', 'cloudflare') OR regexp_matches(lower(trim(t)), '^error [|-]') OR contains(lower(t), 'attention required') OR contains(lower(t), 'just a moment')
    OR regexp_matches(lower(trim(t)), '{text.SLIDE_TITLE}') OR regexp_matches(lower(trim(t)), '{text.FILE_TITLE}') AS junk FROM titles""",
)
def _(spark, d):
    id_ = F.col("doc_id").cast("string")
    accession = F.concat(F.lpad(id_, 10, "0"), F.lit("-24-"), F.lpad((F.col("doc_id") % 1000).cast("string"), 6, "0"))
    made = F.element_at(F.array(*map(F.lit, ODD_TITLES)), (F.col("doc_id") % len(ODD_TITLES) + 1).cast("int"))
    t = load(spark, d, "documents").select("doc_id", F.posexplode(F.array("text", accession, made)).alias("n", "t"))
    return t.select("doc_id", F.col("n").cast("long").alias("n"), text.is_generic_title(F.col("t")).alias("generic"), text.is_machine_id(F.col("t")).alias("machine"), text.is_junk_title(F.col("t")).alias("junk"))


@query("txt_16_title_from_html", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query("txt_18_strip_nul", "SELECT doc_id, length(replace(text, chr(0), ''))::BIGINT AS n FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.length(F.replace("text", F.lit("\0"), F.lit(""))).cast("long").alias("n"))


@query("txt_19_truncate", "SELECT doc_id, left(text, 300) AS t FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.substring("text", 1, 300).alias("t"))


@query(
    "txt_20_coarse_status",
    UL + "SELECT canon_key, event_id, line, split_part(raw_status, ':', 1) AS status, left(trim(regexp_replace(raw_status, '^(done|failed|skipped|pending):?', '')), 200) AS reason FROM url_ledger",
)
def _(spark, d):
    return load(spark, d, "url_ledger").select("canon_key", "event_id", "line", text.coarse_status(F.col("raw_status")).alias("status"), text.status_reason(F.col("raw_status")).alias("reason"))


@query(
    "txt_22_exchange_tags",
    r"""WITH t AS (SELECT c_custkey, 'Acme (NYSE: A' || c_custkey % 9 || ') and (TSX: B; NASDAQ: C' || c_custkey % 7 || ') with (NYSE: A' || c_custkey % 9 || ') once more (Paris)' AS body FROM customer)
  SELECT c_custkey, array_to_string(list_sort(list_distinct(regexp_extract_all(body, '(?i)\((?:NYSE American|NYSE|NASDAQ|TSXV|TSX|LSE|SIX|Euronext|ASX)[^):]{0,15}:\s*[^)]{1,40}\)')))[1:10], ' ') AS tags FROM t""",
)
def _(spark, d):
    k = lambda n: (F.col("c_custkey") % n).cast("string")
    body = F.concat(F.lit("Acme (NYSE: A"), k(9), F.lit(") and (TSX: B; NASDAQ: C"), k(7), F.lit(") with (NYSE: A"), k(9), F.lit(") once more (Paris)"))
    return load(spark, d, "customer").select("c_custkey", F.array_join(text.exchange_tags(body), " ").alias("tags"))


@query(
    "txt_23_tickers",
    r"""WITH t AS (SELECT c_custkey, '(TSX: CC' || chr((65 + c_custkey % 26)::INT) || '; NYSE: MOG.A, www.x.com)' AS tag FROM customer),
  b AS (SELECT c_custkey, regexp_replace(' ' || tag, '(?i)\b(NYSE American|NYSE|NASDAQ|TSXV|TSX|LSE|SIX|Euronext|ASX|Paris|London)\b', ' ', 'g') AS body FROM t)
  SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(body, '[:\s]\s*([A-Z][A-Z0-9.\-]{0,9})\b', 1), lambda x: x NOT IN ('AND', 'WWW')))), ' ') AS tickers FROM b""",
)
def _(spark, d):
    tag = F.concat(F.lit("(TSX: CC"), F.char(65 + F.col("c_custkey") % 26), F.lit("; NYSE: MOG.A, www.x.com)"))
    return load(spark, d, "customer").select("c_custkey", F.array_join(text.tickers(tag), " ").alias("tickers"))


@query(
    "txt_24_transcript_like",
    r"WITH c AS (SELECT conv_id, string_agg('OPERATOR ' || upper(role) || ': ' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id) SELECT conv_id, len(regexp_extract_all(body, '"
    + text.SPEAKER
    + "')) >= 2 AS transcript FROM c",
)
def _(spark, d):
    line = F.concat(F.lit("OPERATOR "), F.upper("role"), F.lit(": "), "text").alias("line")
    turns = F.array_sort(F.collect_list(F.struct("turn", line)))
    body = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("body"))
    return body.select("conv_id", text.is_transcript_like(F.col("body")).alias("transcript"))


@query(
    "txt_25_suppress_repeated_blocks",
    with_tables("segments") + ", t AS (SELECT event_id, string_agg(text, ' ' ORDER BY ord, text) AS said FROM segments GROUP BY event_id) SELECT s.event_id, s.ord, contains(t.said, left(s.text, 200)) AS dropped FROM segments s JOIN t USING (event_id)",
)
def _(spark, d):
    s = load(spark, d, "segments")
    said = s.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda t: t["text"]), " ").alias("said"))
    return s.join(said, "event_id").select("event_id", "ord", F.col("said").contains(F.substring("text", 1, 200)).alias("dropped"))


@query("txt_26_slug", EV + "SELECT event_id, left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM disc_events")
def _(spark, d):
    return load(spark, d, "disc_events").select("event_id", text.slug(F.col("title")).alias("slug"))


@query(
    "txt_27_search_keys",
    "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' of ' || p_brand || ' ' || p_type, ' '), lambda k: trim(k)), lambda k: length(k) >= 3)[1:3], '+') AS keys FROM part",
)
def _(spark, d):
    words = F.split(F.concat_ws(" ", "p_name", F.lit("of"), "p_brand", "p_type"), " ")
    return load(spark, d, "part").select("p_partkey", F.array_join(text.search_keys(words), "+").alias("keys"))


# --- URLs ---


@query("url_01_canon", EACH_URL + f" SELECT event_id, pos, {sql_canon('url')} AS canon FROM urls WHERE starts_with(lower(url), 'http')")
def _(spark, d):
    return each_url(spark, d).where(F.lower("url").startswith("http")).select("event_id", "pos", urls.canon_url(F.col("url")).alias("canon"))


@query(
    "url_02_canon_media",
    f"""WITH p AS (SELECT page_id, url, list_sort(list_filter(string_split({sql_query('url')}, '&'), lambda p: p <> '' AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ({quoted(urls.TRACKING_PARAMS)}))) AS kept FROM pages)
  SELECT page_id, regexp_replace({sql_canon('url')}, '\\?.*$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canon FROM p""",
)
def _(spark, d):
    return load(spark, d, "pages").select("page_id", urls.canon_url_media(F.col("url")).alias("canon"))


@query("url_03_compare_key", f"SELECT page_id, {sql_canon('trim(url)')} AS k FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", urls.canon_url(F.trim("url")).alias("k"))


@query("url_04_host", "SELECT page_id, coalesce(regexp_extract(url, '://([^/]+)', 1), '') AS host, regexp_replace(" + sql_netloc("url") + ", '^www\\.', '') AS site FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), F.regexp_replace(urls.netloc(F.col("url")), r"^www\.", "").alias("site"))


@query("url_05_registrable_domain", f"SELECT page_id, {sql_registrable(sql_netloc('url'))} AS reg, {sql_registrable(chr(39) + 'ir.a' + chr(39) + ' || page_id % 5 || ' + chr(39) + '.co.uk' + chr(39))} AS reg_uk FROM pages")
def _(spark, d):
    uk = F.concat(F.lit("ir.a"), (F.col("page_id") % 5).cast("string"), F.lit(".co.uk"))
    return load(spark, d, "pages").select("page_id", urls.registrable_domain(urls.netloc(F.col("url"))).alias("reg"), urls.registrable_domain(uk).alias("reg_uk"))


@query(
    "url_06_unwrap_viewer",
    "SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'https://cdn.example.org/d' || page_id || '.pdf' ELSE 'https://v.example.com/pdf-viewer?file=https%3A%2F%2Fcdn.example.org%2Fd' || page_id || '.zip' END AS u FROM pages",
)
def _(spark, d):
    wrapped = F.concat(F.lit("https://v.example.com/pdf-viewer?file=https%3A%2F%2Fcdn.example.org%2Fd"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".pdf").otherwise(".zip"))
    return load(spark, d, "pages").select("page_id", urls.unwrap_viewer(wrapped).alias("u"))


SQL_KIND = (
    f"CASE WHEN NOT regexp_matches(lower({{u}}), '^https?://') THEN 'other' WHEN regexp_matches({{u}}, '{urls.ASSET}') THEN 'other' WHEN regexp_matches(regexp_replace({{n}}, ':.*$', ''), '{urls.VIDEO_HOSTS}') THEN 'video'"
    f" WHEN {{e}} IN ({quoted(urls.NON_CONTENT)}) THEN 'other' "
    + " ".join(f"WHEN {{e}} IN ({quoted(es)}) THEN '{k}'" for k, es in urls.EXTENSION_KINDS)
    + " WHEN {e} = '' AND regexp_matches({p}, '(?i)/pdf/?$') THEN 'pdf' ELSE 'html' END"
)
SQL_KIND = SQL_KIND.replace("{u}", "url").replace("{n}", sql_netloc("url")).replace("{e}", sql_ext("url")).replace("{p}", sql_path("url"))


@query("url_07_classify", UL + f"SELECT event_id, line, canon_key, {SQL_KIND} AS k FROM url_ledger")
def _(spark, d):
    return load(spark, d, "url_ledger").select("event_id", "line", "canon_key", urls.classify(F.col("url")).alias("k"))


@query("url_07_classify_media", EACH_URL + f" SELECT event_id, pos, {SQL_KIND} AS k FROM urls")
def _(spark, d):
    return each_url(spark, d).select("event_id", "pos", urls.classify(F.col("url")).alias("k"))


@query(
    "url_08_content_type",
    "WITH c AS (SELECT o_orderkey, (['application/pdf; x', 'Text/HTML', 'audio/mpeg', 'application/vnd.ms-excel', 'application/octet-stream'])[(o_orderkey % 5 + 1)::INT] AS ct FROM orders) SELECT o_orderkey, CASE "
    + " ".join(f"WHEN contains(lower(ct), '{n}') THEN '{k}'" for n, k in urls.CONTENT_TYPES)
    + " ELSE 'html' END AS k FROM c",
)
def _(spark, d):
    kinds = F.array(*map(F.lit, ("application/pdf; x", "Text/HTML", "audio/mpeg", "application/vnd.ms-excel", "application/octet-stream")))
    return load(spark, d, "orders").select("o_orderkey", urls.classify_content_type(F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("k"))


@query("url_09_extension", UL + f"SELECT event_id, line, canon_key, {sql_ext('url')} AS ext, {sql_ext('url')} <> '' AS has_ext, regexp_matches({sql_path('url')}, '(?i)/static-files/|/resource/download/|/api/asset/|/download/?$') AS opaque FROM url_ledger")
def _(spark, d):
    u = F.col("url")
    return load(spark, d, "url_ledger").select("event_id", "line", "canon_key", urls.extension(u).alias("ext"), (urls.extension(u) != "").alias("has_ext"), urls.is_opaque_download(u).alias("opaque"))


@query(
    "url_10_dashboard_kind",
    EACH_URL
    + r""" SELECT event_id, pos, CASE WHEN regexp_matches(lower(url), '\.pdf(\?|#|$)') THEN 'pdf' WHEN regexp_matches(lower(url), '\.(mp3|wav|m4a|aac)(\?|#|$)') THEN 'audio'
  WHEN regexp_matches(lower(url), '\.(mp4|mov|webm)(\?|#|$)') THEN 'video' WHEN regexp_matches(lower(url), '\.(pptx?|key)(\?|#|$)') THEN 'slides' ELSE 'page' END AS k FROM urls""",
)
def _(spark, d):
    return each_url(spark, d).select("event_id", "pos", urls.dashboard_kind(F.col("url")).alias("k"))


@query("url_11_office_format", UL + f"SELECT event_id, line, canon_key, CASE WHEN {sql_ext('url')} IN ('pdf', 'xlsx', 'xls', 'docx', 'doc', 'pptx', 'ppt') THEN {sql_ext('url')} WHEN {sql_ext('url')} = '' AND regexp_matches({sql_path('url')}, '(?i)/pdf/?$') THEN 'pdf' END AS fmt FROM url_ledger")
def _(spark, d):
    e = urls.extension(F.col("url"))
    fmt = F.when(e.isin("pdf", "xlsx", "xls", "docx", "doc", "pptx", "ppt"), e).when((e == "") & urls.path(F.col("url")).rlike("(?i)/pdf/?$"), "pdf")
    return load(spark, d, "url_ledger").select("event_id", "line", "canon_key", fmt.alias("fmt"))


#: Forms of video addresses, and whether the 11 characters in them are an id.
VIDEO_FORMS = (
    ("https://www.youtube.com/watch?t=1&v={}", True), ("https://youtu.be/{}", True), ("https://vimeo.com/{}", False), ("https://m.youtube.com/embed/{}", True), ("https://youtube.com/shorts/{}?a=b", True), ("https://www.youtube.com/live/{}#t", True),
    ("https://www.youtube-nocookie.com/v/{}", True), ("https://youtu.be/{}xx", False), ("https://youtube.com.evil.example/watch?v={}", False), ("https://www.youtube.com/channel/{}", False), ("https://music.youtube.com/watch?v={}", True), ("https://youtu.be/{}/", True),
)


@query("url_12_video_id", f"SELECT o_orderkey, CASE WHEN {sql_picked([ok for _, ok in VIDEO_FORMS], 'o_orderkey')} THEN lpad(o_orderkey::VARCHAR, 11, 'a') ELSE '' END AS v FROM orders")
def _(spark, d):
    u = F.replace(picked([f for f, _ in VIDEO_FORMS], "o_orderkey"), F.lit("{}"), F.lpad(F.col("o_orderkey").cast("string"), 11, "a"))
    return load(spark, d, "orders").select("o_orderkey", urls.video_id(u).alias("v"))


@query("url_13_primary_url", EV + f"SELECT event_id, list_filter(string_split(media, '|'), lambda u: starts_with(u, 'http') AND NOT regexp_matches(u, '{java_to_re2(urls.TRACKER)}'))[1] AS u FROM disc_events")
def _(spark, d):
    return media(load(spark, d, "disc_events")).select("event_id", urls.primary_url(F.col("urls")).alias("u"))


MAGIC_REASONS = (("binary: %PDF-1.7", "pdf"), ("zip with xl/", "xlsx"), ("zip with word/", "docx"), ("zip with ppt/", "pptx"), ("noise", "other"), ("", "other"), (None, "other"))


@query("url_14_magic_kind", f"SELECT o_orderkey, {sql_picked([k for _, k in MAGIC_REASONS], 'o_orderkey')} AS k FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", urls.magic_kind(picked([r for r, _ in MAGIC_REASONS], "o_orderkey")).alias("k"))


@query("url_15_event_file_id", f"SELECT page_id, left(replace({sql_canon('url')}, '/', '-'), 120) AS i FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", F.substring(F.replace(urls.canon_url(F.col("url")), F.lit("/"), F.lit("-")), 1, 120).alias("i"))


# --- Dates ---


@query("dat_01_norm_date", EV + f"SELECT event_id, {sql_norm_date('event_date')} AS v FROM disc_events")
def _(spark, d):
    return load(spark, d, "disc_events").select("event_id", dates.norm_date(F.col("event_date")).alias("v"))


RAW_DATES = """WITH raw AS (SELECT o_orderkey, (o_orderkey % 12 + 1) AS m, (o_orderkey % 28 + 1) AS dd, (1995 + o_orderkey % 30) AS y FROM orders),
 shaped AS (SELECT *, CASE o_orderkey % 12 WHEN 0 THEN y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(dd::VARCHAR, 2, '0') || 'T09:00:00Z' WHEN 1 THEN y || '/' || m || '/' || dd WHEN 2 THEN dd || '/' || m || '/' || y
  WHEN 3 THEN y || '年' || m || '月' || dd || '日' WHEN 4 THEN y || 'H1' WHEN 5 THEN 'FY' || y WHEN 6 THEN 'March ' || dd || ', ' || y WHEN 7 THEN dd || ' Sept. ' || y WHEN 8 THEN 'Jul ' || y WHEN 9 THEN y || '-q' || (m + 2) // 3
  WHEN 10 THEN y || '-05-02 - ' || y || '-05-09' ELSE 'circa ' || y || '?' END AS s FROM raw)"""


@query(
    "dat_02_read_date",
    RAW_DATES
    + """ SELECT o_orderkey, s, CASE o_orderkey % 12 WHEN 0 THEN left(s, 10) WHEN 1 THEN y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(dd::VARCHAR, 2, '0')
  WHEN 2 THEN CASE WHEN dd > 12 THEN y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(dd::VARCHAR, 2, '0') ELSE y || '-' || lpad(dd::VARCHAR, 2, '0') || '-' || lpad(m::VARCHAR, 2, '0') END
  WHEN 3 THEN y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(dd::VARCHAR, 2, '0') WHEN 4 THEN y::VARCHAR WHEN 5 THEN y::VARCHAR WHEN 6 THEN y || '-03-' || lpad(dd::VARCHAR, 2, '0') WHEN 7 THEN y || '-09-' || lpad(dd::VARCHAR, 2, '0')
  WHEN 8 THEN y || '-07' WHEN 9 THEN upper(s) WHEN 10 THEN y || '-05-02' ELSE y::VARCHAR END AS v FROM shaped""",
)
def _(spark, d):
    o = load(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey % 12 AS k", "cast(o_orderkey % 12 + 1 as string) AS m", "cast(o_orderkey % 28 + 1 as string) AS dd", "cast(1995 + o_orderkey % 30 as string) AS y")
    s = F.expr("""CASE k WHEN 0 THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') || 'T09:00:00Z' WHEN 1 THEN y || '/' || m || '/' || dd WHEN 2 THEN dd || '/' || m || '/' || y
      WHEN 3 THEN y || '年' || m || '月' || dd || '日' WHEN 4 THEN y || 'H1' WHEN 5 THEN 'FY' || y WHEN 6 THEN 'March ' || dd || ', ' || y WHEN 7 THEN dd || ' Sept. ' || y WHEN 8 THEN 'Jul ' || y
      WHEN 9 THEN y || '-q' || cast((m + 2) div 3 as string) WHEN 10 THEN y || '-05-02 - ' || y || '-05-09' ELSE 'circa ' || y || '?' END""")
    return o.withColumn("s", s).select("o_orderkey", "s", dates.norm_date_shape(F.col("s")).alias("v"))


@query("dat_03_plausible", EV + r"SELECT event_id, coalesce(trim(event_date), '') = '' OR coalesce(TRY_CAST(regexp_extract(event_date, '(?i)^(\d{4})(?:-(?:Q[1-4]|\d{2}(?:-\d{2})?))?$', 1) AS INT) BETWEEN 1993 AND 2026, false) AS ok FROM disc_events")
def _(spark, d):
    return load(spark, d, "disc_events").select("event_id", dates.plausible_date(F.col("event_date"), 2021).alias("ok"))


@query(
    "dat_04_quarter_bucket",
    EV
    + f""", n AS (SELECT event_id, {sql_norm_date('event_date')} AS t FROM disc_events), m AS (SELECT *, TRY_CAST(regexp_extract(t, '^\\d{{4}}-(\\d\\d)(?:-\\d\\d)?$', 1) AS INT) AS mon FROM n)
  SELECT event_id, CASE WHEN mon BETWEEN 1 AND 12 THEN left(t, 4) || '-q' || (mon - 1) // 3 + 1 WHEN mon IS NOT NULL THEN left(t, 4) ELSE t END AS b FROM m""",
)
def _(spark, d):
    return load(spark, d, "disc_events").select("event_id", dates.date_bucket(F.col("event_date")).alias("b"))


@query(
    "dat_05_precision",
    EV
    + r"""SELECT event_id, CASE WHEN regexp_matches(event_date, '^\d{4}$') THEN 'year' WHEN regexp_matches(event_date, '(?i)^\d{4}-Q[1-4]$') THEN 'quarter' WHEN regexp_matches(event_date, '^\d{4}-\d{2}$') THEN 'month'
  WHEN regexp_matches(event_date, '^\d{4}-\d{2}-\d{2}(T.*)?$') THEN 'day' ELSE 'unknown' END AS p FROM disc_events""",
)
def _(spark, d):
    return load(spark, d, "disc_events").select("event_id", dates.date_precision(F.col("event_date")).alias("p"))


@query(
    "dat_06_period_anchors",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS cur_month, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS cur_quarter, strftime(o_orderdate - INTERVAL 3 MONTH, '%Y') || '-Q' || quarter(o_orderdate - INTERVAL 3 MONTH) AS last_quarter FROM orders",
)
def _(spark, d):
    t = F.col("o_orderdate")
    quarter = lambda x: F.concat(F.date_format(x, "yyyy"), F.lit("-Q"), F.quarter(x).cast("string"))
    return load(spark, d, "orders").select("o_orderkey", F.date_format(t, "yyyy-MM").alias("cur_month"), quarter(t).alias("cur_quarter"), quarter(F.add_months(t.cast("date"), -3)).alias("last_quarter"))


@query("dat_07_time_zone_shift", EV + "SELECT event_id, strftime(created_at + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS tokyo FROM disc_events")
def _(spark, d):
    return load(spark, d, "disc_events").select("event_id", F.date_format(F.from_utc_timestamp(F.col("created_at").cast("timestamp"), "Asia/Tokyo"), "yyyy-MM-dd HH:mm").alias("tokyo"))


@query("dat_08_iso_format", EV + "SELECT event_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso FROM disc_events")
def _(spark, d):
    return load(spark, d, "disc_events").select("event_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("dat_09_10_lease_seconds", WQ + "SELECT id, epoch(lease_until - due_at)::BIGINT AS held_s, strftime(due_at + to_seconds(90 * attempt), '%H:%M:%S') AS renewed FROM work_queue")
def _(spark, d):
    later = F.col("due_at") + F.make_dt_interval(secs=F.col("attempt") * 90)
    return load(spark, d, "work_queue").select("id", ((F.unix_micros(F.col("lease_until").cast("timestamp")) - F.unix_micros(F.col("due_at").cast("timestamp"))) / 1e6).cast("long").alias("held_s"), F.date_format(later, "HH:mm:ss").alias("renewed"))


@query(
    "dat_11_stale_coverage",
    WQ + f"SELECT type, round(100.0 * count(*) FILTER (WHERE last_scanned_at >= TIMESTAMP '{QUEUE_NOW}' - INTERVAL 30 DAY) / count(*), 3)::DOUBLE AS covered_pct FROM work_queue GROUP BY type",
)
def _(spark, d):
    fresh = F.count_if(F.col("last_scanned_at") >= ts(QUEUE_NOW) - F.expr("INTERVAL 30 DAYS"))
    return load(spark, d, "work_queue").groupBy("type").agg(F.round(100.0 * fresh / F.count("*"), 3).alias("covered_pct"))


@query(
    "dat_12_period_bounds",
    EV
    + r"""SELECT event_id, CASE WHEN regexp_matches(event_date, '^\d{4}-\d{2}-\d{2}') THEN strftime(TRY_CAST(left(event_date, 10) AS DATE), '%Y-%m-%d') WHEN regexp_matches(event_date, '-Q') THEN left(event_date, 4) || '-' || lpad(((right(event_date, 1)::INT - 1) * 3 + 1)::VARCHAR, 2, '0') || '-01'
  WHEN regexp_matches(event_date, '-H') THEN left(event_date, 4) || '-' || lpad(((right(event_date, 1)::INT - 1) * 6 + 1)::VARCHAR, 2, '0') || '-01' WHEN regexp_matches(event_date, '^\d{4}-\d{2}$') THEN event_date || '-01' WHEN regexp_matches(event_date, '^\d{4}') THEN left(event_date, 4) || '-01-01' END AS first_day FROM disc_events""",
)
def _(spark, d):
    return load(spark, d, "disc_events").select("event_id", F.date_format(dates.period_bounds(F.col("event_date"))["period_start"], "yyyy-MM-dd").alias("first_day"))


# --- Hashes and numbers ---


@query("mth_01_02_03_hashes", "SELECT doc_id, sha256(text) AS sha, md5('{\"doc\": ' || doc_id || ', \"lang\": \"' || lang || '\"}') AS canonical, md5(doc_id::VARCHAR) AS by_id FROM documents")
def _(spark, d):
    canonical = F.format_string('{"doc": %d, "lang": "%s"}', "doc_id", "lang")
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5(canonical).alias("canonical"), F.md5(F.col("doc_id").cast("string")).alias("by_id"))


@query("mth_04_hash_jitter", WQ + "SELECT id, ('0x' || substr(md5(url), 1, 8))::BIGINT % 1024 / 1024.0::DOUBLE AS jitter FROM work_queue")
def _(spark, d):
    return load(spark, d, "work_queue").select("id", (F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long") % 1024 / 1024.0).alias("jitter"))


@query("mth_05_batch_token", WQ + "SELECT id, sha256('batch-1' || ':' || id) AS token FROM work_queue")
def _(spark, d):
    return load(spark, d, "work_queue").select("id", F.sha2(F.concat(F.lit("batch-1:"), F.col("id").cast("string")), 256).alias("token"))


@query(
    "mth_06_to_10_numbers",
    """SELECT o_orderkey, (100 * (o_orderkey % 7)) // greatest(o_orderkey % 5, 1) AS pct, round(o_totalprice, 1) AS r, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE (o_orderkey % 7) / (o_orderkey % 5)::DOUBLE END AS rate,
  least(greatest(coalesce(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE (o_orderkey % 200 - 50)::VARCHAR END AS DOUBLE) / 100, 0.5), 0.0), 1.0) AS score, ceil(o_orderkey / 7.0)::BIGINT AS blocks FROM orders""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, "x").otherwise((k % 200 - 50).cast("string"))
    return load(spark, d, "orders").select(
        "o_orderkey",
        F.floor(100 * (k % 7) / F.greatest(k % 5, F.lit(1))).alias("pct"),
        F.round("o_totalprice", 1).alias("r"),
        F.coalesce(F.try_divide(k % 7, k % 5), F.lit(1.0)).alias("rate"),
        F.least(F.greatest(F.coalesce(raw.try_cast("double") / 100, F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("score"),
        F.ceil(k / 7).alias("blocks"),
    )


# --- JSON, arrays and maps ---


@query("jsn_01_02_array_access", EV + "SELECT event_id, len(list_filter(string_split(media, '|'), lambda u: u <> ''))::BIGINT AS n, nullif(string_split(media, '|')[1], '') = source_url AS own FROM disc_events")
def _(spark, d):
    return media(load(spark, d, "disc_events")).select("event_id", F.size("urls").cast("long").alias("n"), (F.get("urls", F.lit(0)) == F.col("source_url")).alias("own"))


@query("jsn_03_07_list_coercion", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a,b' ELSE '' END AS items FROM events")
def _(spark, d):
    payload = F.when(F.col("event_id") % 3 == 0, '["a","b"]').when(F.col("event_id") % 3 == 1, '{"a":1}').otherwise("not json")
    items = F.coalesce(F.from_json(payload, "array<string>"), F.array().cast("array<string>"))
    return load(spark, d, "events").select("event_id", F.array_join(F.filter(items, lambda x: x.isNotNull()), ",").alias("items"))


@query("jsn_04_05_unnest", EACH_URL + " SELECT event_id, pos + 1 AS ord, url FROM urls")
def _(spark, d):
    zipped = F.arrays_zip(F.sequence(F.lit(1), F.size("urls")).alias("ord"), F.col("urls").alias("url"))
    return media(load(spark, d, "disc_events")).where(F.size("urls") > 0).select("event_id", F.explode(zipped).alias("z")).select("event_id", F.col("z.ord").cast("long").alias("ord"), F.col("z.url").alias("url"))


@query("jsn_06_merge_objects", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS title, 'kept' AS other FROM events")
def _(spark, d):
    from ledgerloom.functions.nested import merge_maps

    old = F.create_map(F.lit("title"), F.lit("old"), F.lit("other"), F.lit("kept"))
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("title"), F.lit("new")))
    m = merge_maps(old, new)
    return load(spark, d, "events").select("event_id", m["title"].alias("title"), m["other"].alias("other"))


@query("jsn_08_salvage_object", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE (event_id % 100)::BIGINT END AS k FROM events")
def _(spark, d):
    from ledgerloom.functions.nested import salvage_json

    body = F.concat(F.lit('{"k": '), (F.col("event_id") % 100).cast("string"), F.lit("}"))
    reply = F.when(F.col("event_id") % 3 == 0, body).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure! ```json "), body, F.lit("``` done"))).otherwise("no object here")
    return load(spark, d, "events").select("event_id", F.get_json_object(salvage_json(reply), "$.k").cast("long").alias("k"))


@query("jsn_09_hub_normalisation", "SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE 'https://x.example.com/' || c_custkey END AS url, CASE c_custkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'events' END AS kind FROM customer")
def _(spark, d):
    from ledgerloom.functions.nested import normal_hub

    u = F.concat(F.lit("https://x.example.com/"), F.col("c_custkey").cast("string"))
    element = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"'), u, F.lit('"'))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('{"url":"'), u, F.lit('","kind":"events"}'))).otherwise("17")
    h = normal_hub(element)
    return load(spark, d, "customer").select("c_custkey", h["url"].alias("url"), h["kind"].alias("kind"))


@query("jsn_10_property", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
