"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, saved


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star round over the edges (u, v) with u > v of a saved table, which it deletes; the result is saved.

    The least neighbour per node is a partial aggregate, so a hub's edges are combined before the shuffle. It is
    written before the join, so that both of the join's sides are shuffled for it alone: with one row per node on
    the one, the hub's rows on the other are split among tasks.
    """
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = saved(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
    linked = near.join(least, "u")
    if both_ways:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = saved(out.where("u <> v").distinct(), "star")
    discard(least, edges)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node with an edge, except roots themselves; root is the least node reachable.

    ``edges`` has long columns u and v in any direction, repeats allowed. Each round is written to the
    shared folder; a fingerprint of the edge set (count and hash sum) tells when nothing changes.
    The result is a saved table.
    """
    current = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark[0] == 0 or mark == seen:
            out = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._ledgerloom_path = current._ledgerloom_path
            return out
        seen = mark
        current = _star(_star(current, True), False)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
