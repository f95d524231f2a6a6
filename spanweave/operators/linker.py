"""The linker: one graph of functions, routes, UI events, API calls and files from the fact tables, with what stays unresolved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.operators.checkpoints import cut
from spanweave.operators.resolve import link_api_calls, link_functions


@dataclass
class Linked:
    """nodes(id, type), edges(src, dst, type), unresolved_calls and unresolved_api_calls as given, stats: one row of nine counters."""

    nodes: DataFrame
    edges: DataFrame
    unresolved_calls: DataFrame
    unresolved_api_calls: DataFrame
    stats: DataFrame


def callers(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """refs(file, from) with caller_id: the file's last function of that name or with it as the last part of its name, null if none."""
    names = F.array_distinct(F.array("name", F.element_at(F.split("name", r"\."), -1)))
    last = functions.select(F.col("file").alias("_f"), F.explode(names).alias("_n"), F.struct("row_ord", "id").alias("at")).groupBy("_f", "_n").agg(F.max("at").alias("at"))
    return refs.join(last, (F.col("file") == F.col("_f")) & (F.col("from") == F.col("_n")), "left").withColumn("caller_id", F.col("at.id")).drop("_f", "_n", "at")


def _ids(rows: DataFrame, target: str, functions: DataFrame) -> DataFrame:
    """rows with function_id of the function that target names, null if none."""
    return link_functions(rows.withColumn("target", F.col(target)), functions).drop("target", "rank")


def link(functions: DataFrame, calls: DataFrame, routes: DataFrame, events: DataFrame, api_calls: DataFrame, imports: DataFrame) -> Linked:
    """Link six fact tables; every step is a join by key, so no name or file makes pairs of rows.

    functions(id, name, file, file_ord, row_ord); calls(call_id, file, from, callee_id); routes(route_id, method, key,
    handler_id); events(event_id, handler_id, call_ids); api_calls(api_id, method, key, file, from); imports(file, resolved).
    A node's first kind wins, in the order function, route, event, apiCall, file. Edges: calls (from the function
    around a call, or file::name where there is none, and from events and to API calls), handles (from routes and
    events), requests (to all routes on the longest suffix of a key that any route has) and imports; equal ones stay.
    Ids and files that are null take no part in edges. Empty tables give counters of 0.
    """
    calls = cut(_ids(callers(calls, functions), "callee_id", functions))
    requests = cut(link_api_calls(api_calls.select(F.col("api_id").alias("call_id"), "method", "key"), routes.select("route_id", "method", "key")))
    inside = events.select("event_id", F.explode("call_ids").alias("callee_id"))
    edge = lambda d, src, dst, kind: d.select(F.col(src).alias("src") if isinstance(src, str) else src.alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type")).where("src is not null and dst is not null")
    around: Column = F.coalesce("caller_id", F.concat_ws("::", "file", "from"))
    local = imports.where("resolved is not null").select(F.concat(F.lit("file::"), "file").alias("src"), F.concat(F.lit("file::"), "resolved").alias("dst"))
    parts = [
        edge(calls.where("function_id is not null"), around, "function_id", "calls"),
        edge(_ids(routes, "handler_id", functions), "route_id", "function_id", "handles"),
        edge(_ids(events, "handler_id", functions), "event_id", "function_id", "handles"),
        edge(_ids(inside, "callee_id", functions), "event_id", "function_id", "calls"),
        edge(requests, "call_id", "route_id", "requests"),
        edge(callers(api_calls, functions), "caller_id", "api_id", "calls"),
        edge(local, "src", "dst", "imports"),
    ]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    kinds = [(functions, "id", "function"), (routes, "route_id", "route"), (events, "event_id", "event"), (api_calls, "api_id", "apiCall"), (local, "src", "file"), (local, "dst", "file")]
    nodes = None
    for rank, (d, c, _) in enumerate(kinds):
        d = d.select(F.col(c).alias("id"), F.lit(rank).alias("rank"))
        nodes = d if nodes is None else nodes.unionByName(d)
    nodes = nodes.where("id is not null").groupBy("id").agg(F.min("rank").alias("rank"))
    nodes = nodes.select("id", F.get(F.array(*[F.lit(kind) for _, _, kind in kinds]), F.col("rank")).alias("type"))
    lost = calls.where("function_id is null").drop("caller_id", "function_id")
    lost_api = api_calls.join(requests.select(F.col("call_id").alias("api_id")).distinct(), "api_id", "left_anti")
    counted = [(functions, "total_functions"), (calls, "total_calls"), (events, "total_events"), (routes, "total_routes"), (api_calls, "total_api_calls"), (lost, "unresolved_calls"), (lost_api, "unresolved_api_calls")]
    stats = None
    for d, name in counted:
        one = d.agg(F.count("*").alias(name))
        stats = one if stats is None else stats.join(F.broadcast(one))
    stats = stats.withColumn("resolved_calls", F.col("total_calls") - F.col("unresolved_calls")).withColumn("resolved_api_calls", F.col("total_api_calls") - F.col("unresolved_api_calls"))
    return Linked(nodes, edges, lost, lost_api, stats)
