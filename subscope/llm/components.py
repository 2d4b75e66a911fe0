"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a minimum per vertex (partial aggregation) and a lookup of it that broadcasts the few
vertices with very many edges, so a vertex with a third of all edges never meets them in one task;
nothing but two counts per round reaches the driver. After each round the edges are cut from their
lineage; when they are stars around smallest vertices, no further round can change them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import cut, lookup, narrowed


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Large: every larger neighbour of a vertex is linked to the smallest of it and its
    neighbours. Small: the vertex itself and its smaller neighbours are. ``total``: edges, about."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"), F.count("*").alias("n"))
        out = lookup(around, ["a"], least, "n", 2 * total).where("b > a")
        return cut(narrowed(out.select(F.col("root").alias("a"), "b").where("a < b"), total))
    down = edges.select(F.col("b").alias("v"), F.col("a").alias("u"))  # u < v
    least = down.groupBy("v").agg(F.min("u").alias("root"), F.count("*").alias("n"))
    found = lookup(down, ["v"], least, "n", total)
    out = found.select(F.col("root").alias("a"), F.col("u").alias("b")).where("a < b")
    return narrowed(out.unionByName(least.select(F.col("root").alias("a"), F.col("v").alias("b"))), 2 * total).distinct()


def _open(edges: DataFrame, total: int) -> int:
    """Vertices that keep ``edges`` from being stars: those with two smaller neighbours or with both a
    smaller and a larger one."""
    ends = edges.select(F.col("b").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("a").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    at = narrowed(ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")), 2 * total)
    return at.agg(F.count_if(F.expr("up > 1 OR up = 1 AND down = 1"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, any order, loops and repeats allowed) to (node, root): one row per
    vertex that is not the smallest of its component, with that smallest vertex."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .where("a < b").distinct())
    while True:
        total = edges.count()
        edges = narrowed(edges, total)
        if not total or not _open(edges, total):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = cut(narrowed(_star(_star(edges, large=True, total=total), large=False, total=total), 2 * total))
