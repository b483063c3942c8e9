"""The queries opN_<name> of this folder's operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import chat, decontaminate, mixing, neighbours, quality, secrets, simhash, toxicity, url_filter, warc
from ledgerloom.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(conversations.unionByName(chat.probe_conversation(spark))))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_neighbours": op2_neighbours,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_chat": op6_chat,
    "op7_secrets": op7_secrets,
    "op8_url_filter": op8_url_filter,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
}

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
per AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(2 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS level
  FROM per
  WINDOW w AS (ORDER BY 2 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, floor(sum(source_size) OVER () * 1.5::DOUBLE)::BIGINT AS budget,
         CASE WHEN level * weight >= 2 * source_size THEN (2 * source_size)::DOUBLE
              ELSE max(CASE WHEN level * weight < 2 * source_size THEN level END) OVER () * weight END AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.source, s.size, s.h, t.source_size, t.target, t.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id ASC NULLS LAST, s.size ROWS UNBOUNDED PRECEDING) AS done,
         row_number() OVER () AS rid
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CASE WHEN target > 0 THEN (done + source_size * epoch)::DOUBLE / target END AS t
  FROM placed, (SELECT unnest([0, 1]) AS epoch)),
served AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY t NULLS LAST, source ASC NULLS LAST, epoch, h, doc_id ASC NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM copies)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(size, budget - before)))::BIGINT AS taken
FROM served GROUP BY rid, doc_id, size, source_size, target
"""

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": MIXING_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op6_chat": chat.ORACLE_SQL,
    "op8_url_filter": url_filter.oracle_sql(),
}
