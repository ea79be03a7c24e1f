"""Connected components of a graph too large for one machine, by alternating stars.

Large-star points every greater neighbour of a node at the least node it sees, small-star does the same
for the lesser ones; after a few rounds each component is a star around its least node. Every step is an
aggregation with map-side combine and a join of two written tables, so that a node with very many
neighbours is combined before it moves and its join partition can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "components-both")
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "components-least")
    return both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(down: DataFrame) -> DataFrame:
    """``down``: edges from a greater node a to a lesser node b, perhaps repeated."""
    down = materialize(down.distinct(), "components-down")
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "components-least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (a > b) is a centre or has one edge, to a centre; then no round changes them."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return degrees.where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: long); the root is the least node of the component."""
    stars = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while not _are_stars(stars):
        stars = materialize(_small_star(_large_star(stars)), "components")
    roots = stars.select("b").distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
