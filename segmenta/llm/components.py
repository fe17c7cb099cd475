"""Connected components of a graph of links, by joins and minima alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def are_stars(links: DataFrame) -> bool:
    """Whether each node of different ``links`` (u, v), u > v, is only a centre or links to one: what both steps leave as it is."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); component is the smallest node of its component.

    Alternates large-star and small-star steps: each replaces links by links to the smallest neighbour and keeps all
    connections, so the graph becomes one star per component after a number of steps that grows with the logarithm of
    its diameter.  Only minima are aggregated, no list of neighbours is gathered.  Each step is a table in the shared
    folder.  Loops and repeated links do no harm; null ends are dropped.
    """
    links = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while not are_stars(links):
        # large-star: from the view of each node, larger neighbours link to its smallest neighbour (or itself)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: smaller neighbours and the node itself link to its smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        links = written(small.select("e.*").where("u != v").distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
