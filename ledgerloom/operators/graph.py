"""Sampling, validation, recall and scoring of text-to-graph extractions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import norm_evidence, tickers


def stratified_sample(df: DataFrame, key: str, strata: list[tuple[str, Column]], quota: int) -> DataFrame:
    """``quota`` rows of each stratum, in order of md5(key); a row taken for one stratum is not taken for a later one.

    Each stratum looks at quota * (its place) candidates at most, which is enough to fill it whatever was taken before.
    """
    taken: DataFrame | None = None
    for place, (name, condition) in enumerate(strata):
        pool = df.where(condition).withColumn("order", F.md5(F.col(key).cast("string"))).orderBy("order").limit(quota * (place + 1))
        pool = pool if taken is None else pool.join(taken.select(key), key, "left_anti")
        part = pool.orderBy("order").limit(quota).select(key, F.lit(name).alias("stratum"))
        taken = part if taken is None else taken.unionByName(part)
    return taken


def validate_edges(edges: DataFrame, mentions: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """Edges with drop_reason: null if their evidence stands in the body, they are no loop and both ends are mentioned."""
    named = mentions.select(key, F.lower("name").alias("name")).distinct()
    known = lambda end: named.select(key, F.col("name").alias(f"_{end}"), F.lit(True).alias(f"_has_{end}"))
    out = edges.join(bodies.select(key, norm_evidence(F.col("body")).alias("_body")), key, "left")
    for end in ("subject", "object"):
        out = out.withColumn(f"_{end}", F.lower(end)).join(known(end), [key, f"_{end}"], "left")
    reason = (
        F.when(~F.contains(F.coalesce("_body", F.lit("")), norm_evidence(F.col("evidence"))), "evidence_not_in_body")
        .when(F.col("_subject") == F.col("_object"), "self_loop")
        .when(F.col("_has_subject").isNull() | F.col("_has_object").isNull(), "unknown_entity")
    )
    return out.withColumn("drop_reason", reason).select(*edges.columns, "drop_reason")


def retry_list(failed: DataFrame, key: str, line: str, most: int = 20) -> DataFrame:
    """The first lines to try again, per key; ``most`` rows are kept before they are gathered."""
    w = Window.partitionBy(key).orderBy(line)
    kept = failed.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= most)
    return kept.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))


def recall_blocks(candidates: DataFrame, mention: str, order: list, k: int = 50, most_blocks: int = 4) -> DataFrame:
    """Candidates with their block of ``k`` and whether the mention is ambiguous (more candidates than blocks hold)."""
    w = Window.partitionBy(mention)
    ranked = candidates.withColumn("_rk", F.row_number().over(w.orderBy(*order))).withColumn("n_candidates", F.count("*").over(w))
    return ranked.where(F.col("_rk") <= k * most_blocks).withColumn("block", F.floor((F.col("_rk") - 1) / k)).withColumn("ambiguous", F.col("n_candidates") > k * most_blocks).drop("_rk")


def merge_verdicts(edges: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """keep, fix, drop or no_verdict per edge; a fix replaces the ends and keeps the original ones."""
    v = verdicts.select(*keys, "verdict", F.col("subject").alias("_s"), F.col("object").alias("_o"))
    out = edges.join(v, keys, "left").withColumn("verdict", F.coalesce("verdict", F.lit("no_verdict")))
    fix = F.col("verdict") == "fix"
    out = out.withColumn("original", F.when(fix, F.concat_ws(" -> ", "subject", "object")))
    return out.withColumn("subject", F.when(fix, F.coalesce("_s", "subject")).otherwise(F.col("subject"))).withColumn("object", F.when(fix, F.coalesce("_o", "object")).otherwise(F.col("object"))).drop("_s", "_o")


def capture_rates(graded: DataFrame, expected: str, found: str) -> DataFrame:
    """captured and exact, in whole percent of rows that expect anything."""
    some = graded.where(F.size(expected) > 0)
    hit, same = F.arrays_overlap(expected, found), F.array_sort(F.array_distinct(expected)) == F.array_sort(F.array_distinct(found))
    pct = lambda c: F.floor(100 * F.count_if(c) / F.greatest(F.count("*"), F.lit(1)))
    return some.agg(F.count("*").alias("n"), pct(hit).alias("captured_pct"), pct(same).alias("exact_pct"))


def suspicious_tables(tables: DataFrame) -> DataFrame:
    """Per table: no numeric cell below headers that are all digits; and whether all of a row's cells are the same."""
    cells = F.flatten("rows")
    numeric = F.filter(cells, lambda c: c.rlike(r"^[\s$€£(+-]*[0-9][0-9,.]*[%)]?$"))
    digits = (F.size("headers") > 0) & F.forall("headers", lambda h: h.rlike("^[0-9]+$"))
    uniform = F.exists("rows", lambda r: (F.size(r) > 1) & (F.size(F.array_distinct(r)) == 1))
    return tables.withColumn("suspicious", (F.size(numeric) == 0) & digits).withColumn("uniform", uniform)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def scoreboard(docs: DataFrame, mentions: DataFrame, edges: DataFrame, drops: DataFrame, common: int = 10) -> DataFrame:
    """section, key, value: the five figures of an extraction run, as rows.

    ``docs`` has id, stratum and tags (exchange tags in the text), ``mentions`` id and exchange_tag, ``edges`` id, level
    and predicate, ``drops`` kind and reason.
    tags: documents that have tags, those for which a tag was noted, and those where a ticker agrees, also in percent.
    levels: edges of each level, -1 where it is missing. predicates: how many there are, how many of them hold a digit
    (a value that belongs elsewhere), all edges, and the most common ones. strata: documents, edges, edges a document
    and the percentage without any. drops: how many were dropped for each reason.
    """
    of = lambda section, key, value: F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    rows = lambda df, *structs: df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
    figures = lambda df, section, names: rows(df, *[of(section, F.lit(n), F.col(n)) for n in names])
    pct = lambda part, whole: F.floor(100 * part / F.greatest(whole, F.lit(1)))

    noted = mentions.groupBy("id").agg(F.flatten(F.collect_set(tickers(F.col("exchange_tag")))).alias("got"))
    tagged = docs.where(F.size("tags") > 0).select("id", F.flatten(F.transform("tags", tickers)).alias("want")).join(noted, "id", "left")
    got = F.coalesce(F.size("got") > 0, F.lit(False))
    tags = tagged.agg(F.count("*").alias("have"), F.count_if(got).alias("caught"), F.count_if(got & F.arrays_overlap("want", "got")).alias("exact"))
    tags = tags.withColumn("caught_pct", pct(F.col("caught"), F.col("have"))).withColumn("exact_pct", pct(F.col("exact"), F.col("have")))

    named = F.coalesce(F.nullif(F.lower(F.trim("predicate")), F.lit("")), F.lit("?")).alias("predicate")
    kinds = edges.groupBy(named).agg(F.count("*").alias("n"))
    used = kinds.agg(F.count("*").alias("kinds"), F.count_if(F.col("predicate").rlike("[0-9]")).alias("with_digits"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))
    most = kinds.orderBy(F.desc("n"), "predicate").limit(common)

    each = docs.join(edges.groupBy("id").agg(F.count("*").alias("n")), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    strata = each.groupBy("stratum").agg(F.count("*").alias("docs"), F.sum("n").alias("edges"), F.count_if(F.col("n") == 0).alias("none"))
    strata = strata.withColumn("mean", F.col("edges") / F.col("docs")).withColumn("zero_pct", pct(F.col("none"), F.col("docs")))
    by_stratum = [of("strata", F.concat_ws(": ", F.col("stratum"), F.lit(c)), F.col(c)) for c in ("docs", "edges", "mean", "zero_pct")]
    parts = [
        figures(tags, "tags", ("have", "caught", "exact", "caught_pct", "exact_pct")),
        rows(edges.groupBy(F.coalesce("level", F.lit(-1)).alias("level")).agg(F.count("*").alias("n")), of("levels", F.col("level"), F.col("n"))),
        figures(used, "predicates", ("kinds", "with_digits", "edges")),
        rows(most, of("common", F.col("predicate"), F.col("n"))),
        rows(strata, *by_stratum),
        rows(drops.groupBy("kind", "reason").agg(F.count("*").alias("n")), of("drops", F.concat_ws(": ", "kind", "reason"), F.col("n"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def media_coverage(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Per key the number of known addresses, how many were found, and the others as ``missing``.

    An address is found if one of the same key equals it, or if either, without its scheme, stands within the other: a
    copy on another host counts. Keys have few addresses, and only those of one key meet.
    """
    tail = lambda c: F.substring_index(c, "://", -1)
    known = truth.select(key, "url").distinct()
    got = found.select(key, F.col("url").alias("got")).distinct()
    hit = (F.col("url") == F.col("got")) | F.contains(F.col("got"), tail(F.col("url"))) | F.contains(F.col("url"), tail(F.col("got")))
    each = known.join(got, key, "left").groupBy(key, "url").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"))
    missing = F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("url"))))
    return each.groupBy(key).agg(F.count("*").alias("total"), F.count_if("hit").alias("found"), missing.alias("missing"))
