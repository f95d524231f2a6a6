"""Statistics of flows and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _of(kind: str) -> Column:
    return F.count_if(F.col("type") == kind)


def forward_stats(flow: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Steps, files and steps of each kind in flow(type, file)."""
    return flow.groupBy(*by).agg(
        F.count("*").alias("steps"), F.countDistinct(F.nullif("file", F.lit(""))).alias("unique_files"), _of("function").alias("functions"), _of("api").alias("api_calls"), _of("external").alias("external"), _of("event").alias("events"), _of("route").alias("routes")
    )


def backward_stats(flow: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Calling functions (other kinds don't count), files and events."""
    return flow.groupBy(*by).agg(_of("function").alias("total_callers"), F.countDistinct(F.nullif("file", F.lit(""))).alias("unique_files"), _of("event").alias("events"))


def stat_cards(flow: DataFrame) -> DataFrame:
    """(card, n, percent): total, frontend, backend, api with external, event with route; percent of the total, rounded."""
    total = F.count("*")
    sums = flow.agg(
        total.alias("total"), F.count_if(F.col("layer") == "frontend").alias("frontend"), F.count_if(F.col("layer") == "backend").alias("backend"), F.count_if(F.col("type").isin("api", "external")).alias("api"), F.count_if(F.col("type").isin("event", "route")).alias("entry")
    )
    cards = F.explode(F.array(*[F.struct(F.lit(c).alias("card"), F.col(c).alias("n")) for c in ("total", "frontend", "backend", "api", "entry")])).alias("c")
    return sums.select("total", cards).select("c.card", "c.n", F.floor(100 * F.col("c.n") / F.greatest(F.lit(1), "total") + 0.5).cast("long").alias("percent"))


def connection_counts(edges: DataFrame) -> DataFrame:
    """(connections, nodes): distinct pairs and distinct ends of edges(src, dst)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.countDistinct("node").alias("nodes"))
    return edges.agg(F.countDistinct("src", "dst").alias("connections")).join(F.broadcast(ends))
