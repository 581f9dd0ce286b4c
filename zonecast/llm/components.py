"""Connected components of a graph given as edges, by alternating large and small stars.

Each step is a map-side minimum by node and a join on the node; edges are written between steps, so lineage stays
short. No adjacency list is gathered: a node with very many edges is many rows, and its join can be split. Steps go on
until the edges are stars, which takes a number of steps that grows with the logarithm of the graph. Edges with a null
end are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: every node's larger neighbours go to its least neighbour; small: its smaller ones and itself do."""
    ways = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = ways.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and is nobody's v. As u > v, each v is then the least of its component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR (below = 1 AND above = 1)").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node with an edge, from edges (a, b) of one integer type; component: the least id reachable."""
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(now):
        after = keep(_star(_star(now, True), False).distinct(), "edges")
        drop(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
