"""Connected components of an undirected graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b) with a > b. large: each node ties its larger neighbours to its smallest one."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        tied = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return tied.where("a <> b").distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable.

    Self-links, nulls and repeated edges don't matter; no edges give no rows. Every round is checkpointed in the
    shared folder. A hub's edges are aggregated before they are shuffled, and joins on a hub can be split. The
    rounds end when the edges no longer change, which two sums over all edges show; their number grows with the logarithm
    of a component's diameter, and a graph that isn't settled after `rounds` ends the job rather than give wrong roots.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        edges = cut(_star(_star(edges, True), False))
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = found
    raise RuntimeError(f"components did not settle in {rounds} rounds")
