"""Aggregates of the activity, health and queue reports: one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import period_now
from ledgerloom.plans.domain import seconds


def interval(text: str) -> Column:
    return F.expr(f"INTERVAL {text}")


def activity_pulse(events: DataFrame, now: Column) -> DataFrame:
    """How many events of the last day, hour and minute were found, and how many of them are of a current period."""
    recent = events.where(F.col("created_at") > now - interval("1 DAY")).withColumn("p", F.coalesce(period_now(F.col("event_date"), now), F.lit(False)))
    out = []
    for name, length in (("minute", "1 MINUTE"), ("hour", "1 HOUR"), ("day", "1 DAY")):
        inside = F.col("created_at") > now - interval(length)
        out += [F.count_if(F.col("p") & inside).alias(f"bucket_{name}"), F.count_if(inside).alias(f"fetched_{name}")]
    return recent.agg(*out, F.count_if("p").alias("period_matched"))


def activity_feed(events: DataFrame, companies: DataFrame, now: Column, window: str = "1 HOUR", limit: int | None = None) -> DataFrame:
    """The newest events of a current period within the window, with their company's ticker, primary address and the totals."""
    cap = min(max(100 if limit is None else limit, 1), 500)
    matched = events.where(F.col("created_at") > now - interval(window)).where(F.coalesce(period_now(F.col("event_date"), now), F.lit(False)))
    total = matched.agg(F.count("*").alias("matched"))
    first = F.get(F.filter("urls", lambda u: u.startswith("http")), F.lit(0))
    shown = matched.orderBy(F.desc("created_at"), "event_id").limit(cap)
    out = shown.join(companies.select("company_id", "ticker"), "company_id", "left").crossJoin(total)
    return out.select("event_id", "ticker", "title", "event_date", "event_type", first.alias("url"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("discovered"), "matched", (F.col("matched") > cap).alias("truncated"))


def fleet_health(scans: DataFrame, events: DataFrame, queue: DataFrame, now: Column, queue_now: Column, window_min: int = 30, min_calls: int = 5) -> DataFrame:
    """One row: verdict ok, degraded or down, its reason, and the figures behind it. The first condition that holds decides."""
    since = now - interval(f"{window_min} MINUTES")
    within = lambda c: (F.col(c) > since) & (F.col(c) <= now)
    age = lambda c: F.round(seconds(now, F.max(F.when(F.col(c) <= now, F.col(c)))) / 60, 1)
    total = lambda c: F.coalesce(F.sum(F.when(within("ts"), F.col(c))), F.lit(0)).cast("long")
    s = scans.agg(F.count_if(within("ts")).alias("scans_w"), *[total(c).alias(f"{c}_w") for c in ("vlm_calls", "extract_errors", "failed_render", "render_pages")], age("ts").alias("scan_age_min"))
    e = events.agg(F.count_if(within("created_at")).alias("events_w"), age("created_at").alias("event_age_min"))
    failed = F.col("status") == "failed"
    q = queue.agg(
        F.count_if((F.col("status") == "running") & (F.col("lease_until") < queue_now - interval("6 MINUTES"))).alias("orphan_leases"),
        F.count_if(failed).alias("units_failed"),
        F.count_if(failed & (F.col("updated_at") > queue_now - interval(f"{window_min} MINUTES")) & (F.col("updated_at") <= queue_now)).alias("units_failed_w"),
    )
    c = F.col
    render_bad = (c("failed_render_w") >= 20) & (c("render_pages_w") > 0) & (c("failed_render_w") / c("render_pages_w") > 0.25)
    cases = [
        ((c("vlm_calls_w") >= min_calls) & (c("events_w") == 0), "down", F.format_string("no events from %d calls in " + str(window_min) + " min (%d errors, %d scans)", "vlm_calls_w", "extract_errors_w", "scans_w")),
        (c("scan_age_min").isNull() | (c("scan_age_min") > 2 * window_min), "down", F.format_string("no scan for %s min", F.coalesce(c("scan_age_min").cast("string"), F.lit("ever")))),
        (c("extract_errors_w") > 0, "degraded", F.format_string("%d extraction errors, events still arrive", "extract_errors_w")),
        (c("orphan_leases") > 0, "degraded", F.format_string("%d leases are stuck", "orphan_leases")),
        (c("units_failed_w") > 0, "degraded", F.format_string("%d units newly failed of %d", "units_failed_w", "units_failed")),
        (render_bad, "degraded", F.format_string("%d of %d pages fail to render", "failed_render_w", "render_pages_w")),
    ]
    verdict, reason = F.lit("ok"), F.format_string("%d events from %d scans", "events_w", "scans_w")
    for condition, v, r in reversed(cases):
        verdict, reason = F.when(condition, v).otherwise(verdict), F.when(condition, r).otherwise(reason)
    return s.crossJoin(e).crossJoin(q).select(
        verdict.alias("verdict"), reason.alias("reason"), "scan_age_min", "event_age_min", "scans_w", "events_w", "extract_errors_w", "vlm_calls_w", "orphan_leases", "units_failed", "units_failed_w", "failed_render_w", "render_pages_w"
    )


def throughput(scans: DataFrame, now: Column, hours: int) -> DataFrame:
    recent = scans.where(F.col("ts") > now - interval(f"{hours} HOURS"))
    calls, skipped = F.sum("vlm_calls"), F.sum("vlm_skipped")
    return recent.agg((F.sum("render_pages") / float(hours)).alias("c_r"), (calls / float(hours)).alias("c_v"), F.coalesce(F.try_divide(calls, calls + skipped), F.lit(1.0)).alias("hit_rate"))


def unit_cost(queue: DataFrame) -> DataFrame:
    means = {"secs": "duration_s", "pages": "last_render_pages", "calls": "last_vlm_calls", "events": "last_event_count"}
    return queue.where("last_scanned_at is not null").groupBy("type").agg(F.count("*").alias("n"), *[F.avg(c).alias(n) for n, c in means.items()])


def queue_summary(queue: DataFrame, now: Column, stale: str) -> DataFrame:
    late = F.col("last_scanned_at").isNull() | (F.col("last_scanned_at") < now - interval(stale))
    queued = F.col("status") == "queued"
    return queue.groupBy("type").agg(
        F.count("*").alias("total"), F.count_if(queued).alias("queued"), F.count_if(queued & (F.col("due_at") <= now)).alias("due_now"), F.sum("last_event_count").alias("events"),
        F.count_if(late).alias("remaining"), F.floor(100.0 * F.count_if(~late) / F.count("*") + 0.5).alias("coverage_pct"),
    )


def key_counts(df: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """A map from key to its number of rows, for each group."""
    n = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))


def most_common(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def size_histogram(df: DataFrame, by: str, size: str, bounds: tuple[int, ...]) -> DataFrame:
    """Rows per size class, with least, middle (the upper one of an even number) and greatest size."""
    edges = [None, *bounds, None]
    classes = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        inside = F.lit(True)
        inside = inside & (F.col(size) >= low) if low is not None else inside
        inside = inside & (F.col(size) < high) if high is not None else inside
        classes.append(F.count_if(inside).alias(f"b{low or 0}"))
    # A count per distinct size finds the middle without gathering the values of a group.
    distinct = df.groupBy(by, size).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    upto = F.sum("n").over(Window.partitionBy(by).orderBy(size))
    total = F.sum("n").over(Window.partitionBy(by))
    middle = distinct.withColumn("upto", upto).withColumn("total", total).where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(by).agg(F.min(size).alias("p50"))
    return df.groupBy(by).agg(*classes, F.min(size).alias("least"), F.max(size).alias("most")).join(middle, by)


def weakest_link(*iters: Column) -> Column:
    return F.greatest(*[F.coalesce(i, F.lit(2)) for i in iters])
