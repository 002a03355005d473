"""Connected components of links, by alternating stars: every round lets nodes point to smaller ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.staging import stage


def _with_least(links: DataFrame) -> DataFrame:
    """Links (u, v) with `least`, the smallest of u and all its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """`node` and `root` for every node of the links (`u`, `v`): the root is the smallest node reachable, itself included.

    Large stars link every larger neighbour to the smallest one, small stars every smaller one; this keeps
    components and ends, after a number of rounds that grows with the logarithm of their length, with all
    nodes linked to their root. Each round is written to the shared folder. Links may repeat and point
    either way; loops are left out.
    """
    now = stage(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        starred = _with_least(stage(large, "links"))
        small = starred.select("u", F.col("least").alias("v")).unionByName(
            starred.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        )
        now = stage(small.distinct(), "links")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
