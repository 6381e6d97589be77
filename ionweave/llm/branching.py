"""Recursive branching of groups of minwise signatures until groups are small (chosen paths).

A group too large to compare picks signature coordinates by a hash of its own path and splits by
their values; documents of similarity J stay together at a split with probability J. One
coordinate is always picked, a second with probability GAIN / least - 1, so a pair at the least
similarity stays together in GAIN groups of the next level in expectation: more than one, so that
the chance to stay together somewhere doesn't fade with depth.

Groups that don't get small within ``depth`` splits are compared in full, block against block:
nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, join_counted


GAIN = 1.1


def pick(path, salt: int, width: int):
    return (F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(width)) + 1).cast("int")


def unit(path, salt: int):
    return F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def groups(nodes: DataFrame, most: int, most_weight: int) -> DataFrame:
    """(leaf, n, w, small) joined to ``nodes`` (leaf, item, weight): groups of two and more, of equal groups one.

    A group is small with at most ``most`` items and a summed weight of at most ``most_weight``,
    or with two items.
    """
    return nodes.join(group_sizes(nodes, most, most_weight), "leaf")


def group_sizes(nodes: DataFrame, most: int, most_weight: int) -> DataFrame:
    """(leaf, n, w, small) of groups of two and more, of equal groups one; w is the summed weight."""
    sizes = nodes.groupBy("leaf").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"), F.min("item").alias("lo"),
        F.sum(F.shiftrightunsigned(F.xxhash64("item"), 20)).alias("mark"), F.bit_xor(F.xxhash64("item", F.lit(7))).alias("mark2"),
    ).where("n > 1")
    # Groups of the same members are one group; the smallest path stands for them.
    sizes = sizes.groupBy("n", "w", "lo", "mark", "mark2").agg(F.min("leaf").alias("leaf"))
    return sizes.select("leaf", "n", "w", ((F.col("n") <= most) & (F.col("w") <= most_weight) | (F.col("n") == 2)).alias("small"))


def distinct_groups(nodes: DataFrame, most: int, most_weight: int) -> DataFrame:
    """As :func:`groups`, for groups that are known to have two members or more; those of a hot group
    aren't gathered in one task."""
    sizes = group_sizes(nodes, most, most_weight)
    return join_counted(nodes, sizes, ["leaf"], "n")


def blocks(large: DataFrame, most: int, most_weight: int) -> DataFrame:
    """``large`` (leaf, item, n, w and others) dealt out to pairs of blocks of about ``most`` / 2 items and
    ``most_weight`` / 2 of weight: with ``block`` (the pair), ``own`` (the item's block) and ``same``
    (a block paired with itself)."""
    count = F.greatest(F.ceil(F.col("n") / F.lit(max(1, most // 2))), F.least(F.ceil(F.col("w") / F.lit(max(1, most_weight // 2))), "n")).cast("int")
    mine = large.withColumn("n_blocks", count).withColumn("own", F.pmod(F.xxhash64("item", F.lit(11)), F.col("n_blocks")).cast("int"))
    pairs = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    pairs = pairs.withColumn("block", F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other"))).withColumn("same", F.col("own") == F.col("other"))
    return pairs.drop("n_blocks", "other", "leaf", "n", "w")


def refine(nodes: DataFrame, signatures: Callable[[DataFrame], DataFrame], scratch: Scratch, most: int, most_weight: int, least: float, width: int, depth: int = 24) -> DataFrame:
    """Small groups (leaf, item) from groups ``nodes`` (leaf, item, weight).

    A group is small with at most ``most`` items and a summed weight of at most ``most_weight``,
    or with two items. Equal groups from different paths are returned once. ``signatures`` takes the
    items (item) of groups that are still large and returns one (item, sig array of ``width``
    values) for each.
    """
    out = None
    for level in range(depth + 1):
        kept = scratch.keep(groups(nodes, most, most_weight), f"level{level}")
        small = kept.where("small").select("leaf", "item", "weight")
        out = small if out is None else out.unionByName(small)
        large = kept.where("NOT small")
        if large.isEmpty():
            return out
        if level < depth:
            path = F.col("leaf")
            child = lambda salt: F.xxhash64(path, F.lit(salt), F.element_at("sig", pick(path, salt, width)))
            kids = F.array_compact(F.array(child(1), F.when(unit(path, 3) < GAIN / least - 1, child(2))))
            nodes = large.join(signatures(large.select("item").distinct()), "item").select(F.explode(kids).alias("leaf"), "item", "weight")
    # What is still large is compared block by block.
    pairs = blocks(large, most, most_weight).select(F.col("block").alias("leaf"), "item", "weight")
    return out.unionByName(pairs)
