"""Connected components of links between hashable nodes, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeframe.session import discard, materialize

FEW = 100_000  # rows that may be broadcast


def sized(side: DataFrame, rows: int) -> DataFrame:
    """``side`` of a join. Beyond ``FEW`` rows Spark must not broadcast, which takes compressed files for the rows' size in memory."""
    return side if rows <= FEW else side.hint("merge")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node that can be reached.

    Each step links every node's neighbours to the smallest of them; minima are combined per task before the
    shuffle, and joins against them can be split, so a node with very many links is no obstacle. Every step is
    written to the shared folder; the number of steps grows with the logarithm of the longest chain.
    """
    edges = materialize(links.filter("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(), name)
    before, count = None, edges.count()
    while True:
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Large star: every larger neighbour of u is linked to the smallest node around u.
        large = materialize(both.join(sized(least, count), "u").filter("v > u and v <> m").selectExpr("v as u", "m as v").distinct(), name)
        # Small star: u's smaller neighbours and u itself are linked to the smallest of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sized(lower, count), "u").selectExpr("v as u", "m as v").filter("u <> v").unionByName(lower.selectExpr("u", "m as v"))
        after = materialize(small.distinct(), name)
        discard(large)
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if mark == before:
            break
        before, count = mark, mark[0]
    stars = edges.selectExpr("u as node", "v as root")
    return stars.unionByName(edges.selectExpr("v as node", "v as root").distinct())
