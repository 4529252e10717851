"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoscope.llm.tables import stored


def _toward_min(edges: DataFrame) -> DataFrame:
    """Every edge of a node, from its higher end, moves to the node's smallest neighbour."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def components(links: DataFrame, low: str, high: str) -> DataFrame:
    """links(low, high) -> (node, component), component = smallest node reachable.

    Only nodes that have a link come back.  Each pass is a grouped minimum
    joined back to the edges, so a hub with millions of links is one aggregated
    key and never one task's list; the number of passes grows with the
    logarithm of the longest chain.  The edges are done when they are stars: no
    node then has two centres or is a centre and a leaf.
    """
    edges = links.select(F.least(low, high).alias("u"), F.greatest(low, high).alias("v")).where("u < v")
    while True:
        # a pass makes an edge of each edge, so those that come up again may wait for its end
        down = _toward_min(_both(edges)).where("v > u AND m < v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _toward_min(down)
        edges = small.select("m", F.explode(F.array("u", "v")).alias("v")).withColumnRenamed("m", "u")
        edges = stored(edges.where("u < v").distinct(), "edges")
        named = edges.select(F.col("u").alias("component"), F.explode(F.array("u", "v")).alias("node"))
        ends = named.groupBy("node").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        if ends.where("least < most").isEmpty():
            return named.select("node", "component").distinct()
