"""Connected components of a link table, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.staging import discard, staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each end of links (a, b): label is the smallest node that it's connected to.

    Each round gives the nodes a random order, a hash of the round's seed and the node, maps every node to the
    first of itself and its neighbours, and replaces the ends of links by what they map to. Links that become
    loops or equal go. Under a fresh order at most three quarters of the nodes are expected to stay, whatever the
    graph, so rounds grow with the logarithm of the nodes, also on a long path whose nodes lie in order. A seed
    serves two rounds, so that a star is one node after the second. Each round is written to the shared folder; it
    ends when no link is left. A link with a null end is none; an empty table gives an empty result.
    """
    left = staged(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = staged(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    done = 0
    while not left.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(done // 2), c).alias("h"), F.col(c).alias("node"))  # noqa: E731, B023
        ends = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")
        first = ends.groupBy(F.col("a").alias("end")).agg(F.min(place("b")).alias("m"))
        to = staged(first.select("end", F.least(place("end"), "m")["node"].alias("to")), "targets")
        at = lambda c: to.select(F.col("end").alias(c), F.col("to").alias(f"to_{c}"))  # noqa: E731, B023
        mapped = staged(labels.join(to, labels.label == to.end, "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        new = left.join(at("a"), "a").join(at("b"), "b").where("to_a <> to_b")
        fewer = staged(new.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        discard(left, labels, to)
        left, labels, done = fewer, mapped, done + 1
    discard(left)
    smallest = labels.groupBy("label").agg(F.min("node").alias("low"))
    return labels.join(smallest, "label").select("node", F.col("low").alias("label"))
