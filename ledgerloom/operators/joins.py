"""Joins that pre-aggregate, key or explode first, so that none compares all pairs of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import coarse_status
from ledgerloom.functions.urls import canon_url


def left_counts(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of ``left`` with the number of matching rows of ``right``, 0 if none; the count is aggregated before the join."""
    n = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def artifact_counts(documents: DataFrame, segments: DataFrame, audio: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per event that any of the four tables knows: counts of documents, segments, audio and addresses.

    Each table is reduced to counters and the union is summed once: one shuffle in place of a chain of full outer joins.
    """
    names = ("blocks", "files", "segments", "audio", "urls", "urls_done", "urls_failed", "urls_skipped")

    def counters(df: DataFrame, kind: Column = F.lit(None).cast("string"), **exprs: Column) -> DataFrame:  # noqa: B008
        return df.select("event_id", kind.alias("kind"), *[exprs.get(n, F.lit(0)).cast("long").alias(n) for n in names])

    status = coarse_status(F.col("raw_status"))
    html = F.col("kind") == "html"
    one = F.lit(1)
    parts = [
        counters(documents, F.when(~html, F.col("kind")), blocks=html.cast("int"), files=(~html).cast("int")),
        counters(segments, segments=one),
        counters(audio, audio=one),
        counters(ledger, urls=one, urls_done=(status == "done").cast("int"), urls_failed=(status == "failed").cast("int"), urls_skipped=(status == "skipped").cast("int")),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    # Kinds are few: a first aggregate by (event, kind) keeps the list per event short.
    by_kind = rows.groupBy("event_id", "kind").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names])
    entry = F.when(F.col("kind").isNotNull(), F.concat("kind", F.lit(":"), F.col("n").cast("string")))
    out = by_kind.groupBy("event_id").agg(*[F.sum(c).alias(c) for c in names], F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("file_kinds"))
    return out.withColumn("file_kinds", F.when(F.col("file_kinds") != "", F.col("file_kinds")))


def url_overlap(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """event_id of ``new`` and hit: the least event_id of ``stored`` that shares the keys and a canonical address."""

    def exploded(df: DataFrame) -> DataFrame:
        u = df.select("event_id", *keys, F.explode("urls").alias("u")).where(F.lower("u").startswith("http"))
        return u.select("event_id", *keys, canon_url(F.col("u")).alias("canon"))

    known = exploded(stored).groupBy(*keys, "canon").agg(F.min("event_id").alias("hit"))
    return exploded(new).join(known, [*keys, "canon"]).groupBy("event_id").agg(F.min("hit").alias("hit"))


def narrowest(every: str, each: dict[str, str]) -> tuple[Column, Column]:
    """(used, n): all keys together if they match anything, else the single key with the fewest matches above none."""
    some = F.array_sort(F.filter(F.array(*[F.struct(F.col(c).alias("n"), F.lit(k).alias("k")) for k, c in each.items()]), lambda s: s["n"] > 0))
    first = F.get(some, F.lit(0))
    joint = F.col(every) > 0
    return F.when(joint, "and").otherwise(first["k"]).alias("used"), F.when(joint, F.col(every)).otherwise(F.coalesce(first["n"], F.lit(0))).alias("n")


def resolve_references(rows: DataFrame, table: DataFrame, key: str, refs: str) -> DataFrame:
    """Reference tokens turned into the addresses they stand for, in order; unknown tokens fall away."""
    each = rows.select(key, F.posexplode(refs).alias("pos", "ref")).join(table, "ref")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "url")))
    return each.groupBy(key).agg(F.transform(ordered, lambda x: x["url"]).alias("urls"))


def routes_not_events(routes: DataFrame, events: DataFrame, page: str = "page_id", url: str = "url") -> DataFrame:
    """Routes whose address is no event's on the same page; an event is a leaf. ``events`` has a row per page and address."""
    return routes.join(events.select(page, url), [page, url], "left_anti").select(*routes.columns)
