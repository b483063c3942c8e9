"""The control plane's computations: period solver, admission, pacing, rate limits and boosts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Capacity profiles: pages and model calls an hour, and the shortest period in seconds.
PROFILES = {"small": (1728.0, 250.0, 1800.0), "medium": (7000.0, 250.0, 1800.0), "large": (14000.0, 250.0, 1800.0)}
PROFILE_COLUMNS = ("render_pph", "vlm_cph", "floor_s")
WEEK_H = 168.0
FULL_SHARE = 0.5
SLOT_UTILISATION = 0.828


def profiles(overrides: DataFrame, probed: DataFrame) -> DataFrame:
    """profile and its capacities: what is configured, or an override's value; a probe's ceiling below that counts instead.

    Both tables have profile and the capacities, null where they say nothing; of several rows the least value counts.
    """
    spark = overrides.sparkSession
    out = spark.createDataFrame([(k, *v) for k, v in PROFILES.items()], "profile string, " + ", ".join(f"{c} double" for c in PROFILE_COLUMNS))
    for table, name in ((overrides, "_o"), (probed, "_p")):
        out = out.join(table.groupBy("profile").agg(*[F.min(c).alias(f"{name}_{c}") for c in PROFILE_COLUMNS]), "profile", "left")
    return out.select("profile", *[F.least(F.coalesce(f"_o_{c}", c), f"_p_{c}").alias(c) for c in PROFILE_COLUMNS])


def solve(demand: DataFrame, harmonic: bool = False) -> DataFrame:
    """The shortest period that all resources allow, per row of demand.

    Columns: render_pph, vlm_cph, slots, floor_s; n_hub, inc_pages, inc_calls, inc_secs, hit_rate; n_full, full_pages,
    full_calls, full_secs. A resource's period is what a cycle costs, over what a week has left after the full
    sweep. If some resource has nothing left, the row is infeasible and the full sweep keeps half of each.
    """
    c = F.col
    slots_known = (c("slots") > 0) & (c("inc_secs") > 0) & (c("full_secs") > 0)
    lanes = {
        "render": (c("render_pph") * WEEK_H, c("n_full") * c("full_pages"), c("n_hub") * c("inc_pages"), F.lit(True)),
        "vlm": (c("vlm_cph") * WEEK_H, c("n_full") * c("full_calls"), c("n_hub") * c("inc_calls") * c("hit_rate"), F.lit(True)),
        "slots": (c("slots") * 3600.0 * WEEK_H * SLOT_UTILISATION, c("n_full") * c("full_secs"), c("n_hub") * c("inc_secs"), slots_known),
    }
    starved = F.lit(False)
    for capacity, full, _, known in lanes.values():
        starved = starved | (known & (capacity - full <= 1e-9))
    out = demand.withColumn("infeasible", starved)
    hours = {}
    for name, (capacity, full, cycle, known) in lanes.items():
        left = F.when(c("infeasible"), capacity * (1 - FULL_SHARE)).otherwise(capacity - full)
        hours[name] = F.when(~known, 0.0).when(left > 1e-9, WEEK_H * cycle / left).otherwise(float("inf"))
        out = out.withColumn(f"t_{name}_h", hours[name])
    names = ("render", "vlm", "slots")
    binding = F.lit(names[-1])
    for n in reversed(names[:-1]):
        binding = F.when(c(f"t_{n}_h") >= F.greatest(*[c(f"t_{m}_h") for m in names]), n).otherwise(binding)
    t = F.greatest(*[c(f"t_{n}_h") for n in names], c("floor_s") / 3600.0)
    if harmonic:
        cycles = F.floor(WEEK_H / t)
        t = F.when(cycles >= 1, WEEK_H / cycles).otherwise(t)
    return out.withColumn("binding", binding).withColumn("t_star_s", t * 3600.0)


def backlog_eta(full_calls_week: Column, calls_per_hour: Column, share: float = FULL_SHARE) -> Column:
    """Hours until a full sweep is through, by Little's law; null without a rate."""
    return F.try_divide(full_calls_week, calls_per_hour * share)


def fair_caps(tenants: DataFrame, limit: int) -> DataFrame:
    """cap: each active tenant's share of the limit by weight, one at least."""
    total = F.sum("weight").over(Window.partitionBy())
    return tenants.withColumn("cap", F.greatest(F.floor(limit * F.col("weight") / total), F.lit(1)))


def admit(in_flight: Column, cost: Column, cap: Column, everything: Column, limit: int) -> Column:
    return (in_flight + cost <= cap) & (everything + cost <= limit)


def sheds(queue: Column, per_second: Column, share: Column, most_wait_s: float = 120.0, most_queue: int = 1000) -> Column:
    return (F.coalesce(F.try_divide(queue, per_second * share), F.lit(float("inf"))) > most_wait_s) | (queue > most_queue)


def paced_starts(requests: DataFrame, host: str, at_s: str, gap_s: float) -> DataFrame:
    """start_s: each request of a host starts when it arrives, or ``gap_s`` after the one before it, whichever is later.

    The recurrence start_i = max(t_i, start_(i-1) + d) equals i*d + max over j <= i of (t_j - j*d): a running maximum.
    """
    w = Window.partitionBy(host).orderBy(at_s, "id")
    i = F.row_number().over(w) - 1
    ranked = requests.withColumn("_i", i).withColumn("_slack", F.col(at_s) - F.col("_i") * gap_s)
    return ranked.withColumn("start_s", F.max("_slack").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i") * gap_s).drop("_i", "_slack")


def window_rate(requests: DataFrame, key: str, at_s: str, span_s: int) -> DataFrame:
    """n: requests of the same key within the last ``span_s`` seconds, this one included."""
    return requests.withColumn("n", F.count("*").over(Window.partitionBy(key).orderBy(at_s).rangeBetween(-span_s, 0)))


def accepted(requests: DataFrame, key: str, at_s: str, most: int, span_s: float) -> DataFrame:
    """ok: whether a sliding-window limiter lets a request pass; only accepted requests count against the limit.

    What passes depends on what passed before, so each key's requests stream through in order (time, id); what is
    held of a key is the times of the last ``most`` accepted ones, however long its history. Requests without a
    time pass and count for nothing.
    """
    columns = requests.columns
    keys, times = columns.index(key), columns.index(at_s)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last = object(), deque(maxlen=most)
        for b in batches:
            ok = []
            for k, t in zip(b.column(keys).to_pylist(), b.column(times).to_pylist(), strict=True):
                if k != here:
                    here, last = k, deque(maxlen=most)
                ok.append(t is None or len(last) < most or last[0] <= t - span_s)
                if ok[-1] and t is not None:
                    last.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, type=pa.bool_())], names=[*columns, "ok"])

    ordered = requests.repartition(key).sortWithinPartitions(key, at_s, "id")
    return ordered.mapInArrow(fold, T.StructType([*requests.schema.fields, T.StructField("ok", T.BooleanType())]))


def cache_hits(requests: DataFrame, key: str, at_s: str, ttl_s: float) -> DataFrame:
    """hit: whether a response cache answers a request; an answer is computed anew once it is ``ttl_s`` old, and its age counts from then."""
    return accepted(requests, key, at_s, 1, ttl_s).withColumn("hit", ~F.col("ok")).drop("ok")


def climb(samples: DataFrame, run: str, order: str, rate: str, start: int = 18, low: int = 4, high: int = 64) -> DataFrame:
    """limit per run after its samples: a hill climber on the smoothed rate.

    The rate is averaged with weight 0.3; a change within 5 % counts as none, a worse one turns the direction after
    four in a row; steps are 2; the best rate fades by 2 % a sample. Samples without a rate are passed over. A run's
    samples stream through in order, and what is held of it is the climber's state.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, begun = None, None, False
        kind = None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([here], type=kind), pa.array([state[2]], type=pa.int32())], names=[run, "limit"])
        for b in batches:
            kind = b.schema.field(0).type
            for r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not begun or r != here:
                    if begun:
                        yield row()
                    here, state, begun = r, (None, 0.0, start, 2, 0), True
                if x is None:
                    continue
                ewma, best, limit, step, bad = state
                ewma = x if ewma is None else 0.3 * x + 0.7 * ewma
                bad = bad + 1 if ewma < best * 0.95 else 0
                turn = bad >= 4
                step = -step if turn else step
                if ewma > best * 1.05 or turn:
                    limit = max(min(limit + step, high), low)
                state = ewma, max(best * 0.98, ewma), limit, step, 0 if turn else bad
        if begun:
            yield row()

    ordered = samples.select(run, F.col(rate).cast("double").alias("rate"), order).repartition(run).sortWithinPartitions(run, order)
    return ordered.select(run, "rate").mapInArrow(fold, T.StructType([samples.schema[run], T.StructField("limit", T.IntegerType())]))


def boost(queue: DataFrame, events: DataFrame, now: Column, most_events: int, limit: int) -> DataFrame:
    """The units to bring forward: queued full sweeps of companies with few events, fewest first, due now at priority 5.

    A unit is made due at once only if it was never scanned, or not within a week.
    """
    limit, most_events = min(max(limit, 1), 200), min(max(most_events, 0), 1000)
    n = events.groupBy("company_id").agg(F.count("*").alias("n_events"))
    q = queue.where("type = 'full' and status = 'queued'").join(n, "company_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    fresh = F.col("last_scanned_at").isNull() | (F.col("last_scanned_at") < now - F.expr("INTERVAL 7 DAYS"))
    picked = q.where(F.col("n_events") <= most_events).orderBy("n_events", "id").limit(limit)
    return picked.withColumn("priority", F.lit(5)).withColumn("due_at", F.when(fresh, now).otherwise(F.col("due_at")))


def has_room(readings: dict[str, tuple[Column, float]]) -> Column:
    """Whether every reading is within its limit; a missing one counts as within."""
    out = F.lit(True)
    for value, limit in readings.values():
        out = out & F.coalesce(value <= limit, F.lit(True))
    return out
