"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.tables import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    tied = down.join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    return tied.unionByName(low.select(F.col("u").alias("a"), F.col("low").alias("b"))).filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (a, b) but the roots; the root is a component's smallest node.

    Rounds are written to the shared folder, and end when the links no longer change: about the
    logarithm of a component's size.  No link needs to be there twice, and none may be null.
    """
    edges = cut(links.filter("a != b").distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        edges = cut(_small_star(_large_star(edges)), "links")
