"""The domain's tables, derived from the driver's by one SQL text that both Spark and DuckDB run.

Queries read these through ``load``; their SQL twins put ``with_tables`` in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed anchors in place of now(), so that results repeat.
EVENTS_NOW = "2024-01-31 00:00:00"
QUEUE_NOW = "1998-06-01 00:00:00"

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "companies": (
        ("customer",),
        "SELECT c_custkey AS company_id, 'T' || CAST(c_custkey AS STRING) AS ticker, c_name AS name, c_mktsegment AS market, 'https://ir.co' || CAST(c_custkey % 60 AS STRING) || '.example.com/' AS ir_url FROM customer",
    ),
    "disc_events": (
        ("events",),
        """SELECT event_id, user_id AS company_id, ts AS created_at,
  CASE event_type WHEN 'view' THEN 'Earnings' WHEN 'click' THEN 'press_release' WHEN 'purchase' THEN ' webcast ' WHEN 'signup' THEN 'Investor Day' ELSE '' END AS event_type,
  CASE WHEN event_id % 13 = 0 THEN '決算説明会' ELSE 'Q' || CAST(event_id % 4 + 1 AS STRING) || ' 2024  Earnings Call! (part ' || CAST(event_id % 17 AS STRING) || ')' END AS title,
  CASE event_id % 12 WHEN 0 THEN '2024' WHEN 1 THEN '2024-Q1' WHEN 2 THEN '2023-Q4' WHEN 3 THEN '2024-01' WHEN 4 THEN '2024-01-31' WHEN 5 THEN '2024-H1'
    WHEN 6 THEN '2024-FY' WHEN 7 THEN '2024-02-30' WHEN 8 THEN '' WHEN 9 THEN NULL WHEN 10 THEN '2027-Q3' ELSE '2024-01-' || lpad(CAST(event_id % 28 + 1 AS STRING), 2, '0') || 'T09:00:00' END AS event_date,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE 'https://IR.co' || CAST(user_id % 60 AS STRING) || '.example.com/' || CASE event_id % 4 WHEN 0 THEN 'events' WHEN 1 THEN 'News-and-Events' WHEN 2 THEN 'financials/sec-filings' ELSE 'investors' END || '/' END AS source_url,
  CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'https://IR.co' || CAST(user_id % 60 AS STRING) || '.example.com/files/Q' || CAST(event_id % 4 AS STRING) || '.pdf'
    WHEN 2 THEN 'https://IR.co' || CAST(user_id % 60 AS STRING) || '.example.com/events/|https://ir.co' || CAST(user_id % 60 AS STRING) || '.example.com/events'
    WHEN 3 THEN 'https://www.example.com/Tracker?data=' || CAST(event_id AS STRING) || '|http://cdn.example.org/a/' || CAST(event_id % 50 AS STRING) || '.mp4?utm_source=x&b=2&a=1'
    WHEN 4 THEN 'mailto:ir@example.com|HTTPS://media.example.net/w/' || CAST(event_id % 31 AS STRING) || '/#top' ELSE 'https://x.example.com/rss/news.xml|[Deck](https://x.example.com/deck.pptx)' END AS media,
  CASE event_id % 7 WHEN 0 THEN 'discovered' WHEN 1 THEN 'partial' WHEN 2 THEN 'rendering' WHEN 3 THEN 'failed' WHEN 4 THEN 'enriched' WHEN 5 THEN 'dead_letter' ELSE 'deferred' END AS status,
  event_id % 4 AS fail_count, event_id % 3 AS enrich_priority, CASE WHEN event_id % 8 = 0 THEN NULL ELSE ts + INTERVAL 5 MINUTE END AS next_retry_at, ts + INTERVAL 2 HOUR AS lease_until,
  'tok' || CAST(event_id % 5 AS STRING) AS claim_token, value AS queue_pos, 'r' || CAST(event_id % 3 AS STRING) AS run_id, props FROM events""",
    ),
    "scan_log": (
        ("events",),
        """SELECT event_id AS scan_id, user_id AS company_id, ts, CASE WHEN event_id % 3 = 0 THEN 'full' ELSE 'incremental' END AS unit_type, event_id % 7 AS render_pages, event_id % 4 AS vlm_calls,
  event_id % 5 AS vlm_skipped, event_id % 6 AS n_events, CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS extract_errors, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS failed_render FROM events""",
    ),
    "work_queue": (
        ("orders",),
        """SELECT o_orderkey AS id, o_custkey AS company_id, CASE WHEN o_orderkey % 4 = 0 THEN 'full' ELSE 'incremental' END AS type,
  'https://co' || CAST(o_custkey % 97 AS STRING) || '.example.com/ir/' || CAST(o_orderkey AS STRING) AS url,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS due_at, o_orderkey % 6 AS attempt, o_orderkey % 3 AS priority,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate - INTERVAL 3 DAY END AS last_scanned_at, o_orderkey % 30 AS last_event_count, o_totalprice / 1000 AS duration_s,
  o_orderkey % 9 AS last_render_pages, o_orderkey % 5 AS last_vlm_calls, o_orderdate + INTERVAL 1 HOUR AS lease_until, o_orderdate + INTERVAL 2 HOUR AS updated_at, 'tok' || CAST(o_orderkey % 7 AS STRING) AS claim_token FROM orders""",
    ),
    "url_ledger": (
        ("lineitem",),
        """SELECT l_orderkey AS event_id, 'u' || CAST(l_partkey AS STRING) AS canon_key, l_linenumber AS line,
  'https://h' || CAST(l_suppkey AS STRING) || '.example.com/' || CAST(l_partkey AS STRING) || CASE l_linenumber % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xlsx' WHEN 2 THEN '/' WHEN 3 THEN '.mp3' WHEN 4 THEN '.ics' ELSE '/pdf/' END AS url,
  CASE l_linenumber % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'xlsx' ELSE 'video' END AS kind,
  CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'R' THEN 'failed: timeout' ELSE 'skipped: budget' END AS raw_status, l_shipdate AS seen_at FROM lineitem""",
    ),
    "event_documents": (
        ("documents",),
        """SELECT doc_id, doc_id % 400 AS event_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'pptx' ELSE 'html' END AS kind, source AS url, text AS md, n_chars, lang FROM documents""",
    ),
    "segments": (("conversations",), "SELECT conv_id AS event_id, turn AS ord, role AS speaker, text, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn * 2.5 END AS start_s FROM conversations"),
    "audio": (("conversations",), "SELECT DISTINCT conv_id AS event_id, 'a' || CAST(conv_id % 9 AS STRING) AS url FROM conversations WHERE conv_id % 3 = 0"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table, or one of the driver's by its own name."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sources, sql = TABLES[name]
    for s in sources:
        sql = sql.replace(f" FROM {s}", f" FROM {{{s}}}")
    return spark.sql(sql, **{s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in sources})


def with_tables(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the SQL twin of a query."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n][1]})" for n in names) + " "


def ts(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def seconds(later, earlier) -> F.Column:
    """Seconds from one timestamp to another, as a double; both without a time zone."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6
