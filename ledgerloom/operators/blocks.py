"""Markdown and table blocks: gaps-and-islands over lines where SQL can say it, Arrow functions where it cannot."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.arrow import arrow

PIPE_ROW = re.compile(r"^\s*\|.*\|\s*$")
RULE_ROW = re.compile(r"^\s*\|[\s:|-]+\|\s*$")
LIST_ROW = re.compile(r"^\s*([-*+]|\d+[.)])\s+")
BLOCK_TYPE = "array<struct<ord:int,type:string,md:string,headers:array<string>,rows:array<array<string>>>>"


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def blocks_of(md: str | None) -> list[dict]:
    """Runs of lines as md, list or table blocks in order; a table is two pipe rows or more, its rule row left out."""
    out: list[dict] = []
    run: list[str] = []
    kind = ""

    def close() -> None:
        nonlocal run
        body = "\n".join(run).strip()
        if body:
            grid = [_cells(x) for x in run if not RULE_ROW.match(x)] if kind == "table" else []
            if kind == "table" and len(run) < 2:
                out.append({"ord": len(out), "type": "md", "md": body, "headers": [], "rows": []})
            else:
                out.append({"ord": len(out), "type": kind, "md": body if kind != "table" else "", "headers": grid[0] if grid else [], "rows": grid[1:]})
        run = []

    for line in (md or "").split("\n"):
        here = "table" if PIPE_ROW.match(line) else "list" if LIST_ROW.match(line) else "md" if line.strip() else ""
        if here != kind:
            close()
            kind = here
        if here:
            run.append(line)
    close()
    return out


def spliced(md: str | None, tables: list[dict]) -> list[dict]:
    """Blocks in reading order, each run of pipe rows giving its place to the next of the page's parsed tables.

    A run without one left keeps its own cells; tables that no run stands for come last.
    """
    left = [t for t in tables if len(t["headers"]) or len(t["rows"])]
    table = lambda t: {"type": "table", "md": "", "headers": list(t["headers"]), "rows": [list(r) for r in t["rows"]]}
    out = [table(left.pop(0)) if b["type"] == "table" and left else b for b in blocks_of(md)]
    return [b | {"ord": k} for k, b in enumerate([*out, *map(table, left)])]


@arrow(BLOCK_TYPE)
def spliced_udf(md: pd.Series, tables: pd.Series) -> pd.Series:
    return pd.Series([spliced(m, list(t)) for m, t in zip(md, tables, strict=True)])


@arrow(BLOCK_TYPE)
def markdown_blocks(md: pd.Series) -> pd.Series:
    return md.map(blocks_of)


def collapse_spans(rows: list[list[str]]) -> list[list[str]]:
    """Rows of one repeated value become one cell; columns that are blank or repeat the one kept before them go."""
    grid = [list(r) for r in rows]
    width = max(map(len, grid), default=0)
    grid = [r + [""] * (width - len(r)) for r in grid]
    kept: list[int] = []
    for c in range(width):
        column = [r[c] for r in grid]
        if any(x.strip() for x in column) and not (kept and column == [r[kept[-1]] for r in grid]):
            kept.append(c)
    out = [[r[c] for c in kept] for r in grid]
    return [r[:1] if len(r) > 1 and len(set(r)) == 1 else r for r in out]


@arrow("array<array<string>>")
def collapse_spans_udf(rows: pd.Series) -> pd.Series:
    return rows.map(lambda t: collapse_spans([list(r) for r in t]))


def flatten_header(parts: Column) -> Column:
    """Header levels joined by a space; empty levels, nan and repeats of the level above left out."""
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: (F.trim(p) != "") & (F.lower(p) != "nan"))), " ")


def pair(blocks: Column) -> Column:
    """(md, tables): block texts joined by blank lines, the n-th table's place taken by [TABLE n]."""
    numbered = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("parts")),
        lambda s, b: F.struct(
            (s["n"] + F.when(b["type"] == "table", 1).otherwise(0)).alias("n"),
            F.concat(s["parts"], F.array(F.when(b["type"] == "table", F.concat(F.lit("[TABLE "), (s["n"] + 1).cast("string"), F.lit("]"))).otherwise(b["md"]))).alias("parts"),
        ),
    )
    tables = F.transform(F.filter(blocks, lambda b: b["type"] == "table"), lambda b: F.struct(b["headers"].alias("headers"), b["rows"].alias("rows")))
    return F.struct(F.array_join(numbered["parts"], "\n\n").alias("md"), tables.alias("tables"))


def placeholder_mismatch(md: Column, tables: Column) -> Column:
    """Whether the placeholders in a text are not as many as its tables."""
    return F.regexp_count(md, F.lit(r"\[TABLE \d+\]|\[\[TABLE:\d+\]\]")) != F.size(tables)


def table_runs(lines: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """Runs of two pipe rows or more among a text's lines: key, run (from 1), first line, number of lines."""
    w = Window.partitionBy(key).orderBy(pos)
    is_row = F.col(line).rlike(r"^\s*\|.*\|\s*$")
    marked = lines.withColumn("_row", is_row).withColumn("_new", F.when(is_row & ~F.coalesce(F.lag(is_row).over(w), F.lit(False)), 1).otherwise(0))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_row")
    out = runs.groupBy(key, "_run").agg(F.min(pos).alias("first_line"), F.count("*").alias("n_lines")).where("n_lines >= 2")
    return out.withColumn("run", F.row_number().over(Window.partitionBy(key).orderBy("_run"))).drop("_run")


def build_documents(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """One row per page of an event, its pieces in first-seen order, and one per file; rows without text fall away."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "md"))), lambda p: p["md"])
    pages = pieces.groupBy("event_id", "url").agg(F.array_join(ordered, "\n\n").alias("md"), F.min("ord").alias("ord"), F.count("*").alias("n_blocks")).withColumn("kind", F.lit("html"))
    out = pages.unionByName(files.select("event_id", "url", "md", "ord", F.lit(1).cast("long").alias("n_blocks"), "kind"))
    return out.where(F.trim("md") != "").withColumn("n_chars", F.length("md"))


def append_transcript(segments: DataFrame) -> DataFrame:
    """Segments with a start count once per (event, speaker, start, text); those without one all stay."""
    named = segments.withColumn("speaker", F.coalesce(F.nullif("speaker", F.lit("")), F.lit("Speaker")))
    timed = named.where("start_s is not null")
    once = timed.groupBy("event_id", "speaker", "start_s", "text").agg(F.min("ord").alias("ord"))
    return once.unionByName(named.where("start_s is null").select("event_id", "speaker", "start_s", "text", "ord"))


def adopt_documents(proposed: DataFrame, on_page: DataFrame, is_document: Column, most: int = 8) -> DataFrame:
    """Proposed addresses that stand on the page and are documents; the first ``most`` per event, in order."""
    first = proposed.where(is_document).join(on_page, ["event_id", "url"], "left_semi").groupBy("event_id", "url").agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy("ord", "url"))
    return first.withColumn("rk", rank).where(F.col("rk") <= most)
