"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm import shared


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link every node's neighbours (its larger or its smaller ones) to the least node around it.

    Rows may repeat, so that the next step can read them as they come.
    """
    both = edges.union(edges.select("v", "u"))
    if larger:
        near = both
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    linked = near.join(least, "u")
    if larger:
        moved = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v")


def _finished(edges: DataFrame) -> bool:
    """Whether every node that has a smaller neighbour has one only, and that one has none itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("_down")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("_down")))
    around = ends.groupBy("x").agg(F.sum("_down").alias("_n"), F.min("_down").alias("_least"))
    return around.filter("_n > 1 OR (_n = 1 AND _least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v; longs, staged) but the roots, root being the least of a component.

    Alternates steps that link larger and smaller neighbours to the least node nearby until all that
    is left are stars around their least node: a number of steps logarithmic in the longest path.
    Every step aggregates before it shuffles and joins by node, and is staged, so no task holds a
    component. Result rows of an earlier call may be among the edges: components are then extended.
    """
    edges = edges.select("u", "v").filter("u <> v")
    while True:
        edges = shared.staged(_star(_star(edges, True), False).distinct(), "graph")
        if _finished(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """`found`, a result of `components`, with further `links` (u, v; staged)."""
    if links.isEmpty():
        return found
    return components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links))
