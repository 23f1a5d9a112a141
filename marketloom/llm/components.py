"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import common


def stars(edges: DataFrame) -> bool:
    """Whether each node of the (distinct) edges is the larger end of one edge, or else the smaller end of any number."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    apart = ends.groupBy("node").agg(((F.sum("up") > 1) | (F.max("up") > F.min("up"))).alias("apart"))
    return not apart.agg(F.bool_or("apart")).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component (the smallest node id reachable) for every node with an edge.

    A node's neighbours are never gathered: only their least id is aggregated and joined back. Each round is
    written to the shared folder; the number of rounds grows with the logarithm of the number of nodes, and edges that
    are stars already take none."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.materialize(edges, "edges")
    while not stars(edges):
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = edges.unionByName(back).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = back.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u <> v")
            .distinct()
        )
        last, edges = edges, common.materialize(small, "edges")
        common.discard(last)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
