"""Structured Streaming: windows with late data, change detection, idempotent upserts, run-length alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.sources.files import shared_folder


def read_files(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A stream over Parquet files; the schema is read once from what is there.

    The path becomes a glob that matches itself, so that a single file serves as well as a folder.
    """
    glob = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(glob)


def event_time(df: DataFrame, column: str, lateness: str) -> DataFrame:
    """A timestamp without zone cannot carry a watermark, so it is cast first."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def tumbling_usage(scans: DataFrame, length: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    g = event_time(scans, "ts", lateness).groupBy(F.window("ts", length)).agg(F.sum("render_pages").alias("pages"), F.sum("vlm_calls").alias("calls"))
    return g.select(F.col("window.start").alias("start"), "pages", "calls")


def sliding_counts(events: DataFrame, column: str, length: str, step: str, lateness: str = "2 hours") -> DataFrame:
    g = event_time(events, column, lateness).groupBy(F.window(column, length, step), "event_type").count()
    return g.select(F.col("window.start").alias("start"), "event_type", F.col("count").alias("n"))


def changes(pages: DataFrame, lateness: GroupStateTimeout = GroupStateTimeout.NoTimeout) -> DataFrame:
    """key, content_hash, changed: the hash gate with a hash of each key kept as state. Input: key, content_hash, ord."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ord", kind="stable")
        changed = []
        for h in rows["content_hash"]:
            changed.append(h != before)
            before = h
        state.update((before,))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "content_hash": rows["content_hash"].tolist(), "changed": changed})

    return pages.groupBy("key").applyInPandasWithState(step, "key string, content_hash string, changed boolean", "before string", "append", lateness)


def upsert_sink(snapshot: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a Parquet snapshot in versions named by batch.

    A batch reads the version before its own and writes its own anew, so a batch that is delivered twice gives the
    same version. Readers take the greatest version that is complete.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_snapshot(spark, snapshot, below=batch_id)
        out = merge(batch.limit(0) if before is None else before, batch)
        out.write.mode("overwrite").parquet(f"{snapshot}/v={batch_id:08d}")

    return write


def read_snapshot(spark: SparkSession, snapshot: str, below: int | None = None) -> DataFrame | None:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(snapshot)
    store = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(root):
        return None
    found = []
    for s in store.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("v=") and store.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")) and (below is None or int(name[2:]) < below):
            found.append(name)
    return spark.read.parquet(f"{snapshot}/{max(found)}") if found else None


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its rows, from tables in the folder that executors share.

    Each batch is written anew to a place of its own, so one that is delivered twice counts once; in complete mode the
    last batch is the result.
    """
    spark, folder, written = df.sparkSession, shared_folder(df.sparkSession, name), []

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/batch-{batch_id:08d}"
        batch.write.mode("overwrite").parquet(path)
        if path not in written:
            written.append(path)

    q = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if not written:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*(written[-1:] if mode == "complete" else written))


def debounced_alerts(verdicts: DataFrame, at: str, run: int = 3, quiet_s: int = 1800) -> DataFrame:
    """Times of alerts: the third ``down`` in a row, and again only after a quiet time from the last alert of its run."""
    w = Window.partitionBy("fleet").orderBy(at)
    down = F.col("verdict") == "down"
    start = F.when(down & ~F.coalesce(F.lag(down).over(w), F.lit(False)), 1).otherwise(0)
    islands = verdicts.withColumn("_start", start).withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(down)
    inside = Window.partitionBy("fleet", "island").orderBy(at)
    ranked = islands.withColumn("k", F.row_number().over(inside)).where(F.col("k") >= run)
    first = F.min(at).over(Window.partitionBy("fleet", "island"))
    slot = F.floor((F.col(at) - first) / quiet_s)
    return ranked.withColumn("slot", slot).groupBy("fleet", "island", "slot").agg(F.min(at).alias(at)).select("fleet", at)


def lease_deliveries(leases: DataFrame) -> DataFrame:
    """key, attempt, at_s of each delivery: a key is delivered when it comes and again each time its lease lapses."""
    times = F.sequence(F.lit(0), F.floor(F.greatest(F.col("held_s") - 1, F.lit(0)) / F.col("lease_s")))
    return leases.select("key", F.posexplode(times).alias("attempt", "_k"), F.col("at_s"), "lease_s").select("key", "attempt", (F.col("at_s") + F.col("_k") * F.col("lease_s")).alias("at_s"))
