"""What readers of spreadsheets and recordings leave behind, as tables: the rules applied to their raw output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_heading(c: Column) -> Column:
    """4 to 60 characters of which fewer than half are digits: a title, not a date or a figure."""
    t = F.trim(c)
    return F.length(t).between(4, 60) & (F.regexp_count(t, F.lit("[0-9]")) * 2 < F.length(t))


def sheet_tables(cells: DataFrame) -> DataFrame:
    """file, sheet, heading, rows: a grid without header for each sheet of cells (file, sheet, row, col, value).

    Rows and columns without any value fall away; gaps are empty strings; of repeated cells the least value counts.
    The heading is the first cell of the first two rows that reads like one, else the sheet's name. Sheets without a
    value have no row. A sheet is put together in one task.
    """
    sheet = ["file", "sheet"]
    filled = cells.where(F.trim("value") != "").groupBy(*sheet, "row", "col").agg(F.min(F.trim("value")).alias("value"))
    place = lambda c: (F.dense_rank().over(Window.partitionBy(*sheet).orderBy(c)) - 1).alias(c)
    placed = filled.select(*sheet, place("row"), place("col"), "value")
    title = F.min(F.when((F.col("row") < 2) & is_heading(F.col("value")), F.struct("row", "col", F.translate("value", "\n", " ").alias("value"))))
    about = placed.groupBy(*sheet).agg(F.max("col").alias("last"), title["value"].alias("heading"))
    lines = placed.groupBy(*sheet, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("line"))
    full = F.transform(F.sequence(F.lit(0), F.col("last")), lambda c: F.coalesce(F.try_element_at("line", c), F.lit("")))
    rows = lines.join(about, sheet).select(*sheet, "row", "heading", full.alias("cells"))
    grid = F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"])
    out = rows.groupBy(*sheet).agg(F.max("heading").alias("heading"), grid.alias("rows"))
    return out.withColumn("heading", F.coalesce("heading", "sheet"))


def transcripts(audio: DataFrame, segments: DataFrame, models: list[str], cap_s: float) -> DataFrame:
    """id, reason, n_segments, text for each recording (id, n_bytes, duration_s); segments are (id, model, start_s, end_s, text).

    An empty recording or one longer than the cap is refused, which is no failure and so tries no other model. Otherwise
    the first of ``models`` that gave any segment counts; all but the first are named in the reason.
    """
    rank = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    used = segments.withColumn("rank", rank).where("rank > 0")
    said = F.transform(F.array_sort(F.collect_list(F.struct(F.round("start_s", 2).alias("s"), F.round("end_s", 2).alias("e"), F.trim("text").alias("t")))), lambda x: x["t"])
    each = used.groupBy("id", "rank").agg(F.count("*").alias("n"), F.trim(F.array_join(said, " ")).alias("text"))
    best = each.groupBy("id").agg(F.min_by(F.struct("rank", "n", "text"), "rank").alias("best"))
    out = audio.join(best, "id", "left")
    name = F.element_at(F.array(*map(F.lit, models)), F.col("best.rank").cast("int"))
    reason = (
        F.when(F.coalesce("n_bytes", F.lit(0)) == 0, "empty-bytes")
        .when(F.col("duration_s") > cap_s, "too-long")
        .when(F.col("best").isNull(), "transcribe-failed")
        .when(F.col("best.rank") > 1, F.concat(F.lit("fallback:"), name))
        .otherwise("")
    )
    heard = (reason == "") | reason.startswith("fallback")
    return out.select("id", reason.alias("reason"), F.when(heard, F.col("best.n")).otherwise(0).alias("n_segments"), F.when(heard, F.col("best.text")).otherwise("").alias("text"))
