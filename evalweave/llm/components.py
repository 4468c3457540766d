"""Connected components of an edge list, by alternating star contractions.

Large-star links every greater neighbour of a node to the node's smallest neighbour, small-star
every smaller one (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).  Each
round is two aggregates and joins; the edges never grow and no component meets in one task.
Where the edges are counted and few, the rounds need no exchange: on a list of thousands, the files
and tasks of some forty exchanges cost more than the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.plans.shared import cut

# Edge lists of no more rows go through their rounds in one partition; longer ones are shuffled.
FEW_EDGES = 1 << 16


def _least(edges: DataFrame, few: bool) -> DataFrame:
    """The edges with m, the least b of their a; in one partition a window serves, else no node meets in one task."""
    if few:
        return edges.coalesce(1).withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both, few).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = _least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), few)
    moved = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return down.select(F.explode(moved).alias("e")).select("e.a", "e.b").where("a > b")


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the long columns a, b; root is the smallest node reachable.

    NULL ends and loops are ignored; repeated edges do not matter; no edges give no rows.
    """
    now = cut(edges.where("a <> b").select("a", "b").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        few = state[0] <= FEW_EDGES
        now = now.coalesce(1) if few else now
        if state[0] == 0 or state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
        now = cut(_small_star(_large_star(now, few).distinct(), few).distinct())
