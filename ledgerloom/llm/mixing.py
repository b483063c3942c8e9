"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (by hash), twice over, as a document may be taken up to
two times. A document's virtual finish time is the words of its source up to and including it, divided by
the source's target. Served in order of that time, all sources use up their targets at the same pace, so
cutting the global order at the total budget leaves each source near its target.

No order is ever computed in one task. Documents that tie in everything the order goes by (repeated rows, or rows
without an id) are first summed up to one row with their number, so no hash is hot. Within a source these rows are
dealt by their hash into ranges of bounded size; sums per range give each range its start, and only the rows of one
range are ordered together. The global order works the same way: finish times fall into equal ranges (each holds
about the same number of words, as time runs evenly over words), sums over many ranges and then over the ranges
of one of those tell which range holds the cut, and only that range is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD_PATTERN, discard, fresh, row_hash, saved

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
COPIES = 2
#: Documents, and finish times, that are ordered together: about so many.
RANGE_ROWS = 8192
#: Ranges of finish times that are summed up together when the cut is sought.
COARSE = 4096
#: Rows that tie are dealt out again in groups of so many.
TIED_ROWS = 4096
HASH_SPAN = 1 << 32


def words_in(text) -> F.Column:
    """The number of words; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))


def targets(sized: DataFrame) -> DataFrame:
    """source, n_docs, source_size, target, budget: one row per source; ``sized`` has source, size and n, the rows it stands for.

    Weights 5, 2, 1 repeat over the sources by code point, null last. The target is min(2 * size, level *
    weight), at the level where targets add up to 150 % of all words: sharing the excess again and again
    ends there. The windows over all sources see one row for each of them.
    """
    per = sized.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight).withColumn("most", F.col("source_size") * COPIES)
    # A source is capped if the level, found with all sources of no larger most/weight capped, reaches it.
    by_level = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("rank"))
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("budget", F.sum("source_size").over(everything) * SHARE)
        .withColumn("capped_before", F.coalesce(F.sum("most").over(upto), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
    )
    per = per.withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    # Capping a source that need not be lowers the level, so the right one is the highest.
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return per.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("weight"))).select("source", "n_docs", "source_size", "target", F.floor("budget").cast("long").alias("budget"))


def _copies(placed: DataFrame) -> DataFrame:
    """A row for each of the n documents that a row stands for, each with its own ``done``; many of one row are dealt out first."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = placed.where(F.col("n") <= TIED_ROWS).withColumn("k", F.explode(F.expr("sequence(1, n)")))
    chunk = F.explode(F.expr(f"sequence(0, (n - 1) div {TIED_ROWS})")).alias("chunk")
    many = placed.where(F.col("n") > TIED_ROWS).select("*", chunk).repartition(parts, F.rand(1), "chunk")
    many = many.withColumn("k", F.explode(F.expr(f"sequence(chunk * {TIED_ROWS} + 1, least(n, (chunk + 1) * {TIED_ROWS}))"))).drop("chunk")
    return few.unionByName(many).withColumn("done", F.col("done") - (F.col("n") - F.col("k")) * F.col("size")).drop("n", "k")


def _cut(served: DataFrame) -> tuple[int, int]:
    """The range (slot) that holds the end of the budget and the words left for it; ``served`` has slot, words and budget."""

    def within(rows: DataFrame, before: int) -> tuple[int, int] | None:
        running = F.sum("words").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) + before
        first = rows.withColumn("upto", running).where("upto > budget").orderBy("at").select("at", (F.col("upto") - F.col("words")).alias("before"), "budget").first()
        return (first["at"], first["before"], first["budget"]) if first else None

    # Each window sees a row per range of ranges, or per range of one of those.
    coarse = within(served.groupBy(F.floor(F.col("slot") / COARSE).alias("at")).agg(F.sum("words").alias("words"), F.max("budget").alias("budget")), 0)
    if coarse is None:
        return 1 << 62, 0
    at, before, budget = within(served.where(F.floor(F.col("slot") / COARSE) == coarse[0]).withColumnRenamed("slot", "at"), coarse[1])
    return at, budget - before


def _taken(rows: DataFrame, tie: list[str]) -> DataFrame:
    """The columns ``tie``, size, source_size, target, taken, a row for each of ``rows`` (source, h, size and ``tie``).

    The order within a source is that of h, tie (null last) and size.
    """
    grouped = saved(rows.groupBy("source", "h", *tie, "size").agg(F.count("*").alias("n")), "sizes")
    per = saved(targets(grouped).coalesce(1), "targets")  # a row per source
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / RANGE_ROWS))
    dealt = grouped.join(per.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    dealt = dealt.withColumn("part", F.floor(F.col("h") * ranges / HASH_SPAN)).drop("n_docs")
    known = dealt.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    starts = known.withColumn("start", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("words")
    order = ["h", *[F.col(c).asc_nulls_last() for c in tie], "size"]
    inner = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("inner", inner).join(starts.withColumnRenamed("source", "s").withColumnRenamed("part", "p"), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    placed = _copies(placed.withColumn("done", F.col("start") + F.col("inner")).drop("inner", "start", "s", "p", "part"))
    time = lambda epoch: F.when(F.col("target") > 0, (F.col("done") + F.col("source_size") * epoch) / F.col("target"))
    placed = saved(placed.withColumn("t0", time(0)).withColumn("t1", time(1)), "finish-times")

    n = placed.count()
    step = 1 / max(1, -(-COPIES * n // RANGE_ROWS))  # finish times near 1 are cut, so ranges split the time before it
    slot = lambda t: F.floor(F.col(t) / step)
    served = placed.where("size > 0").select("budget", "size", F.explode(F.array(slot("t0"), slot("t1"))).alias("slot")).groupBy("slot").agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    served = saved(served, "served")
    at, room = _cut(served)

    out = [*tie, "size", "source_size", "target", "taken"]
    whole = lambda t: F.when(slot(t) < at, F.col("size")).otherwise(0)
    in_cut = lambda t: (F.col("size") > 0) & F.coalesce(slot(t) == at, F.lit(False))
    rest = placed.where(~(in_cut("t0") | in_cut("t1"))).withColumn("taken", F.when(F.col("size") > 0, whole("t0") + whole("t1")).otherwise(0))
    # Of documents with a word, source and done tell each from all others.
    copies = placed.where(in_cut("t0") | in_cut("t1")).select("*", F.posexplode(F.array("t0", "t1")).alias("epoch", "t"))
    ordered = Window.orderBy("t", F.col("source").asc_nulls_last(), "epoch", *order).rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.least(F.col("size"), room - F.coalesce(F.sum("size").over(ordered), F.lit(0))))
    at_cut = copies.where(slot("t") == at).withColumn("some", part)
    some = at_cut.unionByName(copies.where(slot("t") != at).withColumn("some", whole("t")))
    keys = ["source", "done", *tie, "size", "source_size", "target"]
    cut_rows = some.groupBy(*keys).agg(F.sum("some").alias("taken"))
    taken = saved(rest.select(*out).unionByName(cut_rows.select(*out)).withColumn("taken", F.col("taken").cast("long")), "taken")
    discard(grouped, per, placed, served)
    return taken


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    Size is the number of words; null and empty texts have size 0 and nothing is taken of them. The
    document at the cut gives the words that are left of the budget. Ties in the hash are ordered by
    doc_id and size, so rows that tie in everything are interchangeable and reruns agree; repeated rows and
    rows with a null doc_id are documents of their own. Other columns are ignored; an empty table gives an
    empty result.
    """
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return _taken(sizes(docs).withColumn("h", h), ["doc_id"])


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with all columns and ``taken``; a column of that name is replaced.

    Null and empty texts give no words and so go; so does an empty table's nothing. Rows are ordered by a hash of all
    their columns, so rows without an id or with a repeated one stand apart as any others do. Only rows that agree
    in everything tie; if the cut runs through them, as many of them as it says have each share.
    """
    row, words, taken, number, whole = fresh(docs, "row", "words", "taken_words", "number", "whole")
    own = row_hash(docs)
    sized = docs.select(own.alias("row"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    each = _taken(sized.withColumn("h", F.shiftrightunsigned("row", 32)), ["row"])
    decided = saved(each.groupBy(F.col("row").alias(row), F.col("taken").alias(taken)).agg(F.count("*").alias(number)), "decided")
    discard(each)
    several = saved(decided.groupBy(row).agg(F.count("*").alias("ways")).where("ways > 1").select(row), "cut-through")
    kept = [c for c in docs.columns if c.lower() != "taken"]
    hashed = docs.withColumn(row, own)
    plain = decided.join(several, row, "left_anti").where(F.col(taken) > 0).drop(number)
    out = hashed.join(plain, row).select(*kept, F.col(taken).alias("taken"))
    if not several.limit(1).count():
        return out
    split = decided.join(several, row).where(F.col(taken) > 0)
    one = hashed.join(several, row).groupBy(row).agg(F.min_by(F.struct(*docs.columns), F.lit(0)).alias(whole))
    each = one.join(split, row).withColumn(words, F.explode(F.expr(f"sequence(1, {number})")))
    return out.unionByName(each.select(f"{whole}.*", taken).select(*kept, F.col(taken).alias("taken")))
