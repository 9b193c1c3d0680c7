"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsrate.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m"))
    return (
        both.join(least, "a")
        .filter(F.col("b") > F.col("a"))
        .select(F.least("a", "_m").alias("a"), "b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them. Rows have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("_m"))
    joined = edges.join(least, "b")
    moved = joined.filter(F.col("a") != F.col("_m")).select(
        F.col("_m").alias("a"), F.col("a").alias("b")
    )
    return moved.union(least.select(F.col("_m").alias("a"), "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mark).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b) that are not their component's smallest
    node, which is its name. Every round works on one row per link and is written, and neither
    links nor components are collected; a few rounds are enough for any number of nodes."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(links.select(a.alias("a"), b.alias("b")).filter("a < b").distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
