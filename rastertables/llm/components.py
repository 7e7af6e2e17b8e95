"""Connected components of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import materialize


def _point_to_least(edges: DataFrame) -> DataFrame:
    """For each node u of edges (u, v): (v, m) and (u, m), m the least of u and its v; without loops."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    found = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return found.select("e.*").filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _open(edges: DataFrame) -> bool:
    """True while some node has two parents, or a parent is a child elsewhere."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    seen = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return not seen.filter("child > 1 or (child = 1 and parent = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that is not its component's least, from links (u, v).

    Rounds go on until every component is a star around its least node; each is a stored table.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "links")
    while _open(edges):
        edges = materialize(_point_to_least(_large_star(edges)), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
