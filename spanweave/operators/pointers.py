"""Chains and closures by doubling: rounds grow with the logarithm of a chain's length."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators.checkpoints import cut


def follow(pointers: DataFrame) -> DataFrame:
    """(node, target) of pointers(node, next, target): the target at the end of each node's chain; null where there is none.

    A node has a target, a next node, or neither. Each round takes over the next node's target, or else its next
    node, so a chain's reach doubles. What has no target when every chain has been passed runs in a circle.
    """
    at = cut(pointers.select("node", F.when(F.col("target").isNull(), F.col("next")).alias("next"), "target"))
    for _ in range(max(1, math.ceil(math.log2(at.count() + 1))) + 1):
        if at.where("next is not null").isEmpty():
            break
        ahead = at.select(F.col("node").alias("next"), F.col("next").alias("_next"), F.col("target").alias("_target"))
        at = cut(at.join(ahead, "next", "left").select("node", F.when(F.col("_target").isNull(), F.col("_next")).alias("next"), F.coalesce("target", "_target").alias("target")))
    return at.select("node", "target")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, distance) for all pairs that edges(src, dst) connect over one or more steps, src itself left out; circles end."""
    known = cut(edges.where("src <> dst").select("src", "dst").distinct().withColumn("distance", F.lit(1).cast("long")))
    n = known.count()
    while n:
        onward = known.alias("a").join(known.alias("b"), F.col("a.dst") == F.col("b.src")).where(F.col("a.src") != F.col("b.dst"))
        longer = onward.select("a.src", "b.dst", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        known = cut(known.unionByName(longer).groupBy("src", "dst").agg(F.min("distance").alias("distance")))
        if (more := known.count()) == n:
            break
        n = more
    return known
