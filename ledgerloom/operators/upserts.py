"""Upserts and state changes as pure functions from snapshot and batch to the next snapshot.

Where a version ties or a key repeats, the least row by its other columns counts, so results never depend on the order
in which rows arrive.

Every function is idempotent: applying a batch again gives the same rows, so a job that is run anew after a
failure does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import hash_jitter


def merge_upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, unions: list[str], first_filled: list[str], keep: list[str]) -> DataFrame:
    """One row per key. Arrays are united; of ``first_filled`` the earliest value that is not empty counts, of ``keep`` the earliest.

    ``version`` orders the rows of a key. Partial aggregates combine before the shuffle.
    """
    rows = old.unionByName(new)
    filled = lambda c: F.min_by(F.col(c), F.when(F.col(c) != "", F.col(version)))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return rows.groupBy(*keys).agg(F.min(version).alias(version), *[F.min_by(c, version).alias(c) for c in keep], *[filled(c).alias(c) for c in first_filled], *[united(c).alias(c) for c in unions])


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the greatest version per key; of several, the greatest by their columns in order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *rest)).alias("_row")).select(*keys, "_row.*")


def first_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the least by its other columns in order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else df.distinct()


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(first_of(new, keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def never_downgrade(df: DataFrame, keys: list[str], status: str, final: str, version: str) -> DataFrame:
    """The latest status per key, unless it ever was final."""
    return df.groupBy(*keys).agg(F.when(F.bool_or(F.col(status) == final), final).otherwise(F.max_by(status, F.struct(version, status))).alias(status))


def repair(df: DataFrame, columns: dict[str, str], log: str = "meta_fixed") -> DataFrame:
    """Overwrite columns by non-empty, different corrections, and keep each value so replaced in a map."""
    fixed = {c: (F.coalesce(F.col(n), F.lit("")) != "") & ~F.col(n).eqNullSafe(F.col(c)) for c, n in columns.items()}
    before = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.when(fixed[c], F.col(c)) for c in columns])), lambda _, v: v.isNotNull())
    return df.withColumn(log, before).withColumns({c: F.when(fixed[c], F.col(n)).otherwise(F.col(c)) for c, n in columns.items()})


def fenced(snapshot: DataFrame, completions: DataFrame, key: str, token: str, changes: dict[str, str]) -> DataFrame:
    """Apply completions whose token is still the row's own; stale ones change nothing."""
    c = first_of(completions, [key, token])
    out = snapshot.join(c, [key, token], "left")
    return out.withColumns({old: F.coalesce(F.col(new), F.col(old)) for old, new in changes.items()}).select(*snapshot.columns)


def renew(snapshot: DataFrame, beats: DataFrame, key: str, token: str, at: str, lease_s: int, live: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot with the leases of a batch of heartbeats (key, token, at) renewed, and the claims that are lost.

    A beat renews its row if the row is live and the token is still its own; a lease never gets shorter. A claim whose
    beat finds no such row is another's by now, so its work is to be given up.
    """
    last = beats.groupBy(key, token).agg(F.max(at).alias("_at"))
    held = (F.col("status") == live) & F.col("_at").isNotNull()
    until = F.col("_at") + F.make_dt_interval(secs=F.lit(lease_s))
    out = snapshot.join(last, [key, token], "left").withColumn("lease_until", F.when(held, F.greatest("lease_until", until)).otherwise(F.col("lease_until")))
    lost = last.select(key, token).join(snapshot.where(F.col("status") == live).select(key, token), [key, token], "left_anti")
    return out.select(*snapshot.columns), lost


def backoff(df: DataFrame, key: str, most: int = 3, base_s: float = 30.0, jitter_s: float = 10.0) -> DataFrame:
    """status after one more failure, and delay_s: doubling, plus a jitter that depends on the key alone."""
    dead = F.col("fail_count") + 1 >= most
    delay = base_s * F.pow(F.lit(2.0), F.col("fail_count")) + hash_jitter(F.col(key).cast("string")) * jitter_s
    return df.withColumn("status", F.when(dead, "dead_letter").otherwise("failed")).withColumn("delay_s", delay)


def rearm(queue: DataFrame, t_star_s: int, week_s: int = 604800) -> DataFrame:
    """Recurring work is never done: back to the queue, due one period later."""
    period = F.make_dt_interval(secs=F.when(F.col("type") == "full", week_s).otherwise(t_star_s))
    return queue.withColumn("status", F.lit("queued")).withColumn("due_at", F.col("due_at") + period)


def reclaim(queue: DataFrame, now: Column, cool_off: str = "6 HOURS") -> DataFrame:
    """Lapsed leases return to the queue, and so do failures that have cooled off, with no attempts counted."""
    lapsed = (F.col("status") == "running") & (F.col("lease_until") < now)
    cooled = (F.col("status") == "failed") & (F.col("updated_at") < now - F.expr(f"INTERVAL {cool_off}"))
    return queue.withColumn("attempt", F.when(cooled, 0).otherwise(F.col("attempt"))).withColumn("status", F.when(lapsed | cooled, "queued").otherwise(F.col("status")))


def claim_batch(ordered: DataFrame, key: str, batch: str, n: int) -> DataFrame:
    """The first rows with a token each. A single planner computes batches; tokens repeat if the batch is planned anew."""
    return ordered.limit(n).withColumn("claim_token", F.sha2(F.concat(F.lit(f"{batch}:"), F.col(key).cast("string")), 256))
