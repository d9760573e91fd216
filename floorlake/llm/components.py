"""Connected components by alternating large-star and small-star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorlake.staging import broadcast_if_small, staged



def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = _both_ways(edges)
    # staged by itself, so that a hub's edges meet it by broadcast or in a join that Spark can split
    least = staged(sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return sym.filter("v > u").join(broadcast_if_small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = staged(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(broadcast_if_small(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` below it that is no other's ``u``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"), (F.col("v") > F.col("u")).cast("int").alias("wrong"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1), F.lit(0)))
    shape = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"), F.max("wrong").alias("wrong"))
    return shape.filter("below > 1 or below = 1 and above = 1 or wrong = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for each node that has an edge (u, v) to another.

    ``edges`` is a staged table, and each round is staged; a star for each component is the end.
    """
    now = edges.select("u", "v").filter("u <> v")
    while not _is_stars(now):
        now = staged(_small_star(_large_star(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
