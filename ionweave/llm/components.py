"""Connected components by distributed union-find (alternating large-star and small-star).

Edges stay in DataFrames; each round is written to the shared folder, so a lost executor costs
one round. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _least(df: DataFrame, key: str, other: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(other).alias("m"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the smallest node it is linked to."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = scratch.keep(edges, "edges")
    before = None
    while True:
        # Large-star: link each larger neighbour of a node to the node's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, "u", "v").select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small-star: link each smaller neighbour, and the node itself, to the smallest of them.
        least = _least(large, "u", "v")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.keep(small, "stars")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = after
        if mark == before:
            break
        before = mark
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
