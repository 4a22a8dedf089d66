"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelgraph.llm.common import discard, join_skewed, materialize

ROUNDS = 60


def _linked_to_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with m, the least b of their a; of a hub the join is by broadcast."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size"))
    return join_skewed(edges, materialize(least, "cc-least"), "a", "size").drop("size")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): the smallest node it can reach.

    Alternates large-star and small-star steps until nothing changes, which takes a number of
    rounds logarithmic in the longest path. Each round writes its edges to the shared folder,
    so no lineage grows and a lost executor costs only its unfinished tasks. The neighbours of a
    hub never meet in one task; only counts reach the driver.
    """
    pair = F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")
    now = materialize(edges.where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y")).select(*pair).distinct(), "cc")
    before = None
    for _ in range(ROUNDS):
        # Large star: every larger neighbour of a node is linked to the smallest one around it, or to it.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least("m", "a")
        large = _linked_to_least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), least.alias("b")).distinct()
        large = materialize(large, "cc-large")
        # Small star: the smaller neighbours of a node, and itself, are linked to the smallest.
        small = _linked_to_least(large)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(small, "cc")
        # Edges are distinct, so equal counts and xors of hashes mean that nothing changed.
        mark = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        discard(now)
        discard(large)
        now = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
