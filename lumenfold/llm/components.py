"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: every node's greater neighbours get linked to its least neighbour. Small: its lesser ones do.

    The least neighbour is an aggregate joined back to the links: no node's neighbours meet in one task unless the join may split them."""
    if large:
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = around.join(least, around["u"] == least["c"])
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _checksum(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(links: DataFrame) -> DataFrame:
    """From links (a long, b long), in any order and repeated at will: (node, component) for every node that has a link to another, where the
    component is the least node reachable. Lineage is cut after every double step; the driver sees a count and a checksum a step."""
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges, "edges")
    seen = _checksum(edges)
    while seen[0]:
        edges = cut(_star(_star(edges, True), False), "edges")
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    # Now each link leads to the least node of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
