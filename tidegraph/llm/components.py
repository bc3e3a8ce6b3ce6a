"""Connected components by alternating large-star and small-star, as joins and aggregates of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import keep, release


def _least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``m``: the least of u and its v's.  A partial aggregate joined back, so a hub is no single group."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"))
    return pairs.join(least.hint("merge"), F.col("u") == F.col("__u")).drop("__u")


def large_star(edges: DataFrame) -> DataFrame:
    """Join each node's larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Join each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _least(down)
    moved = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v) with u > v are stars around their v: no node has two v's, or is both u and v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    wrong = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
    return wrong.agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) for each node of ``edges`` (u, v); self-links and nulls are left out.

    Each round is written to the shared folder; rounds end when all edges are stars around the least node of
    their component.
    """
    edges = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not are_stars(edges):
        before, edges = edges, keep(small_star(large_star(edges)), "stars")
        release(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
