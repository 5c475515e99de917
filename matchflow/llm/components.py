"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchflow.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    """One row that changes when the set of edges does."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of an edge list (a, b) reaches: node, label.

    Large-star and small-star steps by turns until the edges stay as they are.
    Every step is an aggregation and a join, so a node with very many links is
    combined inside tasks first and split by the join. Loops and repeated edges
    change nothing; nodes without edges are not returned.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = _signature(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(nearest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(nearest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
