"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.support import staged


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent or only children, which ends the steps."""
    ends = edges.select("a", F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    seen = ends.groupBy("a").agg(F.sum("up").alias("parents"), F.count("*").alias("n"))
    return seen.where("parents > 1 or (parents = 1 and n > 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` run from the larger to the smaller end."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """For links ``(a, b)`` the rows ``(node, component)`` of each linked node, where component is the least node id reachable.

    Least neighbours are found by an aggregation with partial sums. The join back on a hub's id is a plain equi-join of
    16 bytes a link, which adaptive execution splits where one hub's links outgrow its threshold of bytes; a hub below it
    is a small task. No link reaches the driver, which sees a yes or no per round.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        edges = staged(_small_star(_large_star(edges)))
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
