"""Connected components of a table of links, as joins and groupings.

Large-star and small-star in turn (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every node's neighbours are linked to the
smallest of them until each component is a star around its smallest node.
A node with very many neighbours costs one row per neighbour, its smallest
is found by a pre-aggregated minimum, and the join is one that Spark splits
where it is skewed. Each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half round over links (u, v) with u > v."""
    near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    # written, so that the join has two plain sides and Spark can split a node of very many neighbours
    least = written(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    to = near.join(least, "u")
    if large:
        out = to.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = to.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node that is not its component's smallest.

    ``links``: columns a and b, any order, repeats and self-links allowed;
    links with a null end are ignored."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                    "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()    # two numbers
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, edges = now, written(_star(_star(edges, True), False), "stars")
