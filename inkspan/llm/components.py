"""Connected components of an edge table by alternating star contraction, without gathering any component.

Large-star links every neighbour that is larger than a vertex to the least vertex it sees; small-star does so with the
smaller ones. Both are an aggregate (partly aggregated before its exchange) and a join with the edges; the aggregate is dealt
anew first, so that adaptive execution can split the join at a hot vertex. Each round is written to the shared folder; rounds go
as the logarithm of the longest path, and end when all that is left are stars around the least vertex of each component.

Edges with a null end, and from a vertex to itself, link nothing and are left out; without edges there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common as C


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex is either named by others alone, or names one other."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("names"), F.lit(0).alias("named")), F.struct(F.col("v").alias("x"), F.lit(0).alias("names"), F.lit(1).alias("named")))).alias("e")).select("e.*")
    per = ends.groupBy("x").agg(F.sum("names").alias("names"), F.max("named").alias("named"))
    return per.where((F.col("names") > 1) | ((F.col("names") > 0) & (F.col("named") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) of longs, in any direction, repeats allowed. Returns (node, root), root the least node of its component."""
    edges = C.durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = C.durable(both.where("v > u").join(least.hint("rebalance"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small.hint("rebalance"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = C.durable(linked.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
