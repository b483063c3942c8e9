"""Rankings, queue positions and bounded orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import urls
from ledgerloom.plans.domain import seconds


def hub_ranking(events: DataFrame, top_k: int, recent: str) -> DataFrame:
    """The best listing pages of each company: ranked among all its pages first, filtered by size afterwards."""
    pages = events.where((F.col("source_url") != "") & ~F.col("source_url").rlike(urls.FILINGS))
    g = pages.groupBy("company_id", "source_url").agg(F.count("*").alias("ev"), F.count_if(F.col("event_date").rlike(recent)).alias("recent_ev"))
    rk = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("recent_ev"), "ev", "source_url"))
    return g.withColumn("rk", rk).where(F.col("ev").between(2, 40) & (F.col("recent_ev") >= 1) & (F.col("rk") <= top_k)).select("company_id", "source_url", "ev", "recent_ev", "rk")


def hash_jitter(c: Column) -> Column:
    """A number in [0, 1) that depends on the text alone."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % 1024 / 1024.0


def host_fair_positions(events: DataFrame, now: Column) -> DataFrame:
    """event_id, queue_pos: hosts take turns however many events they have; new events stand before old ones."""
    pool = events.where(F.col("status").isin("discovered", "failed", "partial")).select(
        "event_id", "created_at", urls.host(F.col("source_url")).alias("host"), (F.col("status") == "partial").alias("backfill"), (F.col("created_at") > now - F.expr("INTERVAL 24 HOURS")).alias("is_new")
    )
    group = Window.partitionBy("host", "is_new", "backfill")
    dealt = pool.withColumn("seq", F.row_number().over(group.orderBy("created_at", "event_id"))).withColumn("n_pop", F.count("*").over(group)).withColumn("n_host", F.count("*").over(Window.partitionBy("host")))
    return dealt.select("event_id", (F.when(F.col("is_new"), 0).otherwise(10000) + (F.col("seq") - 0.5) * F.col("n_host") / F.greatest("n_pop", F.lit(1)) + hash_jitter(F.col("host"))).alias("queue_pos"))


def ranked(df: DataFrame, order: list, part: Column, part_ascending: bool = True, name: str = "rank") -> DataFrame:
    """``name``: the place of each row, from 0, in the order of ``part`` (null first) and then ``order``.

    Only rows of one value of ``part``, a prefix of the order that has many values such as a day, are sorted together;
    the window over all parts reads a row for each.
    """
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    by = F.col("_part").asc_nulls_first() if part_ascending else F.col("_part").desc_nulls_last()
    before = F.sum("_n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.withColumn("_within", within).join(starts, F.col("_part").eqNullSafe(F.col("_p"))).withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_p", "_before", "_within")


def even_spacing(df: DataFrame, order: list, part: Column, period_s: float, whole: bool = False) -> DataFrame:
    """offset_s: rows in order spread evenly over a period. ``part`` is a prefix of the order (see ``ranked``)."""
    n = df.agg(F.count("*").alias("_all"))
    rows = ranked(df, order, part, name="_rank").crossJoin(n)  # one row
    offset = F.floor(F.col("_rank") * int(period_s) / F.col("_all")) if whole else F.col("_rank") / F.col("_all") * period_s
    return rows.withColumn("offset_s", offset).drop("_rank", "_all")


def islands(df: DataFrame, by: list[str], x: str, gap: float) -> DataFrame:
    """Rows numbered by island: a new one starts where the step to the previous value exceeds ``gap``."""
    w = Window.partitionBy(*by).orderBy(x)
    new = F.when(F.col(x) - F.lag(x).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def by_urgency(queue: DataFrame, now: Column, t_star_s: float | None) -> DataFrame:
    """Ordered by how much of its own period each unit has used up; never scanned first, then the earliest due."""
    period = F.when(F.col("type") == "full", F.lit(604800.0)).otherwise(F.lit(max(1800.0 if t_star_s is None else t_star_s, 1.0)))
    urgency = F.when(F.col("last_scanned_at").isNull(), F.lit(1e9)).otherwise(seconds(now, F.col("last_scanned_at")) / period)
    return queue.withColumn("urgency", urgency).orderBy(F.desc("urgency"), "due_at", "id")


def claim_order(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("enrich_priority"), F.col("next_retry_at").isNotNull(), F.col("queue_pos").asc_nulls_last(), "event_id")


def capped(df: DataFrame, order: list, cap: int) -> DataFrame:
    """The first rows, with a flag that says whether there were more. One more row than shown is enough to know."""
    more = df.select(F.lit(1).alias("x")).limit(cap + 1).agg((F.count("*") > cap).alias("truncated"))
    return df.orderBy(*order).limit(cap).crossJoin(more)


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rk") <= n)


def kind_rank(u: Column) -> Column:
    """Pages, then documents, then audio and video, then the rest."""
    return F.when(u.rlike(r"(?i)\.(pdf|pptx?|docx?|xlsx?)(\?|#|$)|(?i)\.pdf"), 1).when(u.rlike(r"(?i)\.mp[34]"), 2).otherwise(0)


def by_rank(items: Column, rank) -> Column:
    """An array in order of rank; items of one rank keep their order."""
    decorated = F.transform(items, lambda u, i: F.struct(rank(u).alias("r"), i.alias("i"), u.alias("u")))
    return F.transform(F.array_sort(decorated), lambda s: s["u"])


def ranked_streams(items: Column) -> Column:
    """Audio, then manifests, then progressive video, then the rest; segments of a stream fall away."""
    rank = lambda u: F.when(u.rlike(r"(?i)\.(mp3|m4a|aac|wav)$"), 0).when(u.rlike(r"(?i)\.(m3u8|mpd)$"), 1).when(u.rlike(r"(?i)\.(mp4|webm|mov)$"), 2).otherwise(3)
    return by_rank(F.filter(items, lambda u: ~u.rlike(r"(?i)\.(ts|m4s)$")), rank)
