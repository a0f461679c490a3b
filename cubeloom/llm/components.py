"""Connected components of an edge list, by alternating star contractions.

In a round every node first hands its larger neighbours to the least node of
its neighbourhood (large star), then itself and its smaller neighbours to the
least of those (small star).  Both keep the components; rounds end when every
edge leads to its component's least node, which the edges themselves show: each
larger end has one edge, and none is a smaller end too.  Each round is written
to shared storage, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple[int, int, bool]:
    """(edges, most edges of a node, whether all are stars around least nodes) of distinct edges (u > v)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    found = nodes.agg(F.sum("up").alias("n"), F.max("n").alias("most"), F.max((F.col("up") > 0) & (F.col("n") > 1)).alias("open")).first()
    return found["n"] or 0, found["most"] or 0, not found["open"]


def _stars(edges: DataFrame, n_edges: int, most: int, large: bool) -> DataFrame:
    """One star step over edges (u > v); the centre of a large star is no task's own."""
    ways = edges if not large else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ways.groupBy("u").agg(F.min("v").alias("__m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "__m").alias("m"), "n")
    # an edge hands on one edge at most, so that no node has more smaller neighbours after a large star than it had before
    joined = common.join_counted(ways, least, "u", 2 * n_edges) if most > common.hot_from(2 * n_edges) else ways.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) long pairs -> (node, root): every node that has an edge, and the least of its component."""
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    both = common.settle(both, "components")
    for _ in range(rounds):
        n, most, done = _state(both)
        if done:
            break
        wide = common.settle(_stars(both, n, most, True), "components")
        common.discard(both)
        both = common.settle(_stars(wide, n, most, False), "components")
        common.discard(wide)
    else:
        raise RuntimeError("components did not settle")
    return both.select(F.col("u").alias("node"), F.col("v").alias("root")).union(both.select(F.col("v"), F.col("v")).distinct())
