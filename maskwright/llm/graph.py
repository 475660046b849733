"""Connected components of an edge table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import ensure_checkpoint_dir

#: Rounds after which the edges would have to be wrong; each at least halves the depth.
ROUNDS = 60


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none: nothing is left to do."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    met = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return met.where("hangs + holds > 1").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches: the smallest node that it reaches.

    Nodes are of any type that can be ordered.  Every round hangs all neighbours
    of a node on the smallest of them (large star: the greater neighbours; small
    star: the smaller ones and the node), until the edges are stars.  Only
    aggregates by node and joins with their one row per node are shuffled; no
    group is gathered, and lineage is cut with checkpoint().
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    for _ in range(ROUNDS):
        if _are_stars(edges):
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # b > a >= m: never a loop
        least = hung.groupBy("a").agg(F.min("b").alias("m"))
        near = hung.join(least, "a")
        edges = near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(near.select("a", F.col("m").alias("b"))).distinct().checkpoint()
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
