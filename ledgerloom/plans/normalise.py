"""Normalisation pipelines: each keeps rows with a drop reason until the end, so that losses can be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, text, urls
from ledgerloom.operators import joins
from ledgerloom.sources.files import shared_folder


def normalise_events(raw: DataFrame, now_year: int) -> DataFrame:
    """title, event_date, event_type, urls and drop_reason of raw events.

    Addresses are cleaned; an event needs one, or both a date and a title; dates are read, and one that cannot be
    or lies outside the calendar window drops the event; types outside the list become other.
    """
    cleaned = raw.withColumn("urls", urls.clean_urls(F.col("urls"))).withColumn("title", F.substring(F.trim(F.coalesce("title", F.lit(""))), 1, 300))
    read = cleaned.withColumn("raw_date", F.trim(F.coalesce("event_date", F.lit("")))).withColumn("event_date", dates.norm_date_shape(F.col("event_date")))
    nothing = (F.size("urls") == 0) & ((F.col("raw_date") == "") | (F.col("title") == ""))
    unread = (F.col("raw_date") != "") & (F.col("event_date") == "")
    reason = F.when(nothing, "no_identity").when(unread, "unread_date").when(~dates.plausible_date(F.col("event_date"), now_year), "implausible_date")
    return read.withColumn("event_type", text.coerce_type(F.col("event_type"))).withColumn("drop_reason", reason).drop("raw_date")


def normalise_routes(routes: DataFrame, tags: DataFrame, score: Column, least: float = 0.35) -> DataFrame:
    """page_id, url and score of the routes (page_id, pos, base, ref, and what ``score`` reads) worth following.

    A reference is a tag of the page's links (``tags``: page_id, ref, url) or an address, resolved against the page's
    own; others are dropped, never guessed. The score is clamped to [0, 1], 0.5 if unreadable. Of a page's repeated
    addresses the first counts. Assets, documents and noise pages are left out, event hubs raised.
    """
    clamped = F.least(F.greatest(F.coalesce(score.try_cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    known = tags.select("page_id", "ref", F.col("url").alias("tagged"))
    address = F.when(F.col("ref").rlike("^(?i:https?:)|^[/.?]|/"), urls.resolve(F.col("base"), F.col("ref")))
    each = routes.withColumn("score", clamped).join(known, ["page_id", "ref"], "left").withColumn("url", F.coalesce("tagged", address)).where("url is not null")
    u = F.col("url")
    first = each.where(~u.rlike(urls.NON_EVENT)).groupBy("page_id", "url").agg(F.min_by("score", "pos").alias("score"))
    kept = first.withColumn("score", urls.boosted_score(u, F.col("score"))).where(~urls.is_binary_route(u) & ~urls.is_noise_route(u))
    return kept.where(F.col("score") >= least)


def combine_pages(pages: DataFrame, events: DataFrame, routes: DataFrame) -> DataFrame:
    """page_id, events, routes, flag: both halves of a page's reading, put together.

    ``pages`` has page_id, error, route_error and partial (null: none); ``events`` page_id, title and urls; ``routes``
    page_id, url and score. A route that is an event's address on the same page falls away. The halves fail each on
    its own: an extraction error takes the events, a routing error the routes, and events of a partial reading stay.
    """
    leaves = events.select("page_id", F.explode("urls").alias("url")).distinct()
    kept = joins.routes_not_events(routes, leaves)
    heard = lambda rows, fields, name: rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = pages.join(heard(events, ["title", "urls"], "events"), "page_id", "left").join(heard(kept, ["url", "score"], "routes"), "page_id", "left")
    without = lambda name, failed: F.when(failed | F.col(name).isNull(), F.slice(name, 1, 0)).otherwise(F.col(name))
    out = out.withColumn("events", F.coalesce(without("events", F.col("error").isNotNull()), F.expr("cast(array() as array<struct<title:string,urls:array<string>>>)")))
    out = out.withColumn("routes", F.coalesce(without("routes", F.col("route_error").isNotNull()), F.expr("cast(array() as array<struct<url:string,score:double>>)")))
    flag = F.when(F.col("error").isNotNull(), "error").when(F.col("partial").isNotNull(), "partial").when(F.col("route_error").isNotNull(), "route_error").otherwise("")
    return out.select("page_id", "events", "routes", flag.alias("flag"))


def merge_chunks(events: DataFrame, failures: DataFrame, page: str) -> DataFrame:
    """Per page the distinct events of all its blocks, and partial or error if some block failed."""
    key = urls.event_key(F.col("title"), F.col("event_date"), F.col("urls"))
    n = events.withColumn("k", key).groupBy(page).agg(F.count_distinct("k").alias("n_events"))
    failed = failures.groupBy(page).agg(F.count_if("failed").alias("n_failed"))
    out = failed.join(n, page, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    return out.withColumn("flag", F.when(F.col("n_failed") > 0, F.when(F.col("n_events") > 0, "partial").otherwise("error")))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def hash_gate(pages: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """changed: whether a page's content differs from its snapshot; a page without one counts as changed."""
    now = pages.withColumn("content_hash", F.sha2("content", 256))
    before = previous.select(*keys, F.col("content_hash").alias("_before"))
    return now.join(before, keys, "left").withColumn("changed", ~F.col("content_hash").eqNullSafe(F.col("_before"))).drop("_before")


def seeds(companies: DataFrame, hubs: DataFrame) -> DataFrame:
    """company_id, url, ord: the main address first, then hubs, without repeats up to trailing slashes."""
    rows = companies.select("company_id", F.col("ir_url").alias("url"), F.lit(0).cast("long").alias("ord")).unionByName(hubs.select("company_id", "url", F.col("ord").cast("long").alias("ord")))
    bare = F.regexp_replace("url", "/+$", "")
    w = Window.partitionBy("company_id", bare).orderBy("ord", "url")
    return rows.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def crawl(seeds: DataFrame, links: DataFrame, folder: str | None = None, max_rounds: int = 12, batch: int = 5, max_pages: int = 60, least: float = 0.35, same_site: bool = False, page_s: str | None = None, budget_s: float = 600.0) -> DataFrame:
    """site, url, round: a best-first walk of each site over a table of links (url, target, score).

    In each round every site visits its ``batch`` best frontier pages, up to ``max_pages`` in all; with ``same_site``
    only pages of its seeds' registrable domains, and with ``page_s`` (a column of ``links``: the seconds that the
    target takes) no more once they have taken ``budget_s``. The loop is bounded by rounds. Each round is one join of
    the pages just visited with the links; its tables are written to ``folder``, which executors share (a new one if
    none is named), so plans stay small and a lost executor costs one round at most. Joins are by sorting: Spark takes a
    table for as small as its files, which hold addresses compressed and links before they are exploded, and would send
    such a table through the driver.
    """
    spark = seeds.sparkSession
    folder = folder or shared_folder(spark, "crawl")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    takes = F.col(page_s) if page_s else F.lit(0.0)
    ways = links.where(F.col("score") >= least).select(F.col("url").alias("source"), F.col("target").alias("url"), "score", takes.cast("double").alias("takes"))
    home = seeds.select("site", urls.registrable_domain(urls.netloc(F.col("url"))).alias("home")).distinct()
    frontier = seeds.select("site", "url", F.lit(1.0).alias("score"), F.lit(0.0).alias("takes"))
    done = None
    for r in range(max_rounds):
        best = Window.partitionBy("site").orderBy(F.desc("score"), "url")
        room = F.lit(max_pages)
        if done is not None:
            spent = done.groupBy("site").agg(F.count("*").alias("_n"), F.sum("takes").alias("_s"))
            frontier = frontier.join(spent.hint("merge"), "site", "left").where(F.coalesce("_s", F.lit(0.0)) < budget_s)
            room = F.lit(max_pages) - F.coalesce("_n", F.lit(0))
        now = frontier.withColumn("_rk", F.row_number().over(best)).where((F.col("_rk") <= batch) & (F.col("_rk") <= room)).select("site", "url", "takes", F.lit(r).alias("round"))
        now = kept(now, f"visited/r={r}")
        if not now.limit(1).count():
            break
        done = spark.read.schema(now.schema).parquet(*[f"{folder}/visited/r={k}" for k in range(r + 1)])
        found = now.select("site", F.col("url").alias("source")).join(ways.hint("merge"), "source").drop("source")
        if same_site:
            found = found.withColumn("home", urls.registrable_domain(urls.netloc(F.col("url")))).join(home.hint("merge"), ["site", "home"], "left_semi").drop("home")
        rest = frontier.select("site", "url", "score", "takes").unionByName(found.select("site", "url", "score", "takes"))
        rest = rest.groupBy("site", "url").agg(F.max("score").alias("score"), F.max("takes").alias("takes"))
        frontier = kept(rest.join(done.select("site", "url").hint("merge"), ["site", "url"], "left_anti"), f"frontier/r={r}")
    return done.select("site", "url", "round") if done is not None else seeds.select("site", "url", F.lit(0).alias("round")).limit(0)
