"""Connected components of an edge table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.sized import shuffled
from tallystone.session import written


def _toward_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): for every u the least of u and its v's, beside each v."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(shuffled(least), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) of every node of ``edges`` (a, b).

    Alternates large-star and small-star steps: every node's neighbours are linked to the least of
    them, until nothing changes, in a number of rounds that grows with the logarithm of the size. A
    step is an aggregation by node and a join, so a node with very many neighbours is a skewed join,
    never a collected group. Each round is written out. Self-loops, repeated edges and rows with a
    null are harmless and add no component; nodes of self-loops only are left out.
    """
    links = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _toward_least(large)
        links = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
