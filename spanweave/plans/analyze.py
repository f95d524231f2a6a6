"""The whole flow query: a source tree's facts, an entry's function, its trace with code, filtered steps, counts and metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.scalars import clamp_depth, classify_entry
from spanweave.operators import resolve, stats, trace
from spanweave.operators.checkpoints import cut
from spanweave.operators.linker import Linked, callers, link
from spanweave.sources.extract import extract_all, with_callees
from spanweave.sources.files import attach_code


@dataclass
class Facts:
    """Fact tables of one source tree; ord and file_ord are whatever orders the rows.

    functions(id, name, file, file_ord, row_ord, start_line, end_line),
    calls(call_id, name, object, from, file, line, ord), api_calls(call_id, method, url, from, file, line, ord),
    routes(route_id, method, path, handler, file, ord), files(path, content),
    ui_events(event_id, event, element, file, handler, handler_function_id, calls_inside, line, ord).
    """

    functions: DataFrame
    calls: DataFrame
    routes: DataFrame
    ui_events: DataFrame
    api_calls: DataFrame
    files: DataFrame


@dataclass
class Flow:
    nodes: DataFrame
    edges: DataFrame
    steps: DataFrame
    stats: DataFrame


def _place(line: Column, pos: Column | None = None) -> Column:
    """An order of places in a file that sorts as text."""
    return F.concat_ws(":", "file", F.lpad(line.cast("string"), 9, "0"), F.lpad((F.lit(0) if pos is None else pos).cast("string"), 9, "0"))


def facts_of(files: DataFrame) -> Facts:
    """The facts of files(path, content), by the extractors; ids are made of file, name and place."""
    t = extract_all(files)
    functions = cut(t["functions"].withColumn("file_ord", F.col("file")).withColumn("row_ord", F.col("start_line")))
    line = F.col("start_line")
    calls = with_callees(t["calls"], functions, t["imports"], t["exports"]).withColumn("ord", _place(line, F.col("pos"))).withColumn("call_id", F.concat_ws("#", "ord", "callee"))
    api = t["api_calls"].withColumn("ord", _place(line)).withColumn("call_id", F.concat_ws("#", "ord", "method", "url"))
    routes = t["routes"].where("method <> 'USE'").withColumn("ord", _place(line)).withColumnRenamed("id", "route_id")
    handler = t["ui_events"].withColumn("from", F.element_at(F.split("handler", r"\."), -1))
    events = callers(handler, functions).withColumnRenamed("caller_id", "handler_function_id").drop("from")
    events = events.withColumn("ord", _place(line, F.col("pos"))).withColumn("event_id", F.concat_ws("#", "ord", "event"))
    at_line = lambda d: cut(d.withColumnRenamed("start_line", "line"))
    return Facts(functions, at_line(calls), at_line(routes), at_line(events), at_line(api), files)


def linked_tree(files: DataFrame) -> Linked:
    """The linked graph of files(path, content)."""
    f, imports = facts_of(files), extract_all(files)["imports"]
    events = f.ui_events.select("event_id", F.col("handler_function_id").alias("handler_id"), F.transform("calls_inside", lambda c: F.concat_ws("::", "file", c)).alias("call_ids"))
    routes = f.routes.withColumn("from", F.element_at(F.split("handler", r"\."), -1))
    routes = callers(routes, f.functions).select("route_id", "method", F.col("path").alias("key"), F.coalesce("caller_id", F.when(F.col("handler") != "inline", F.concat_ws("::", "file", "from"))).alias("handler_id"))
    calls = f.calls.select("call_id", "file", "from", F.col("callee_function_id").alias("callee_id"))
    api = f.api_calls.select(F.col("call_id").alias("api_id"), "method", F.regexp_replace("normalized_url", "^dynamic:", "").alias("key"), "file", "from")
    return link(f.functions, calls, routes, events, api, imports.select("file", "resolved").where("resolved is not null"))


def typed_actions(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """(what each function does, functions with their types)."""
    acts = trace.actions(facts.functions, facts.calls, facts.api_calls, facts.routes, facts.ui_events)
    return cut(acts), cut(trace.node_types(facts.functions, facts.routes, facts.ui_events))


def entry_functions(facts: Facts, entries: DataFrame) -> DataFrame:
    """entries(entry, file_hint) with type and function_id: a route's handler, an event's function, or the function named."""
    e = entries.withColumn("e", classify_entry(F.col("entry"))).select("entry", "file_hint", "e.*")
    named = e.where("type = 'function'").select(F.col("entry").alias("ref_id"), "name", F.col("file_hint").alias("caller_file"))
    route = e.where("type = 'route'").select(F.col("entry").alias("call_id"), "method", F.col("path").alias("url"))
    route = resolve.match_routes(route, facts.routes).join(facts.routes.select("route_id", "handler"), "route_id")
    route = route.select(F.col("call_id").alias("ref_id"), F.col("handler").alias("name"), F.lit(None).cast("string").alias("caller_file"))
    direct = resolve.resolve_functions(named.unionByName(route), facts.functions).select(F.col("ref_id").alias("entry"), "function_id")
    event = e.where("type = 'event'")
    event = event.join(resolve.resolve_event_entries(event.select("event", "element"), facts.ui_events, facts.functions), ["event", "element"]).select("entry", "function_id")
    return e.select("entry", "type").join(direct.unionByName(event), "entry", "left")


def analyze(facts: Facts, entries: DataFrame, direction: str = "forward", depth: int | None = None, metrics: DataFrame | None = None) -> Flow:
    """The flows of many entries at once; direction applies to functions, routes and events are always traced forward.

    nodes: functions, API calls, outside calls, UI events and routes with their distance, the code of those with
    lines and, for routes where metrics(metric_key, ...) is given, what has been measured of them. steps keep
    their numbers when noise is filtered out.
    """
    found = entry_functions(facts, entries).where("function_id is not null")
    roots = found.select(F.col("function_id").alias("root"), "type").distinct()
    acts, typed = typed_actions(facts)
    backward = roots.where(F.lit(direction == "backward") & (F.col("type") == "function")).select("root").distinct()
    forward = roots.where(~(F.lit(direction == "backward") & (F.col("type") == "function"))).select("root").distinct()
    most = clamp_depth(depth)
    parts = [trace.trace_forward(acts, typed, forward, most)] if direction != "backward" else [trace.trace_forward(acts, typed, forward, most), trace.trace_backward(acts, typed, backward, most)]
    nodes, edges, steps = (x[0] if len(x) == 1 else x[0].unionByName(x[1]) for x in zip(*parts, strict=True))
    nodes = attach_code(nodes, facts.files)
    if metrics is not None:
        named = F.split("label", " ")
        routes = nodes.where("type = 'route' and node like 'route:%'").select("root", "node", F.get(named, F.lit(0)).alias("method"), F.get(named, F.lit(1)).alias("path"))
        measured = resolve.attach_metrics(routes, metrics).drop("method", "path")
        nodes = nodes.join(measured, ["root", "node"], "left")
    steps = resolve.filter_flow(steps)
    count = stats.backward_stats if direction == "backward" else stats.forward_stats
    return Flow(nodes, edges, steps, count(steps, ["root"]))


def trace_roots(facts: Facts):
    """A function from a stream's detected root, a direction and a depth to (nodes, edges) of its flow."""

    def run(root: dict, direction: str, depth: int) -> tuple[DataFrame, DataFrame]:
        entries = facts.files.sparkSession.createDataFrame([(root["root_name"], root["file"])], "entry string, file_hint string")
        flow = analyze(facts, entries, direction, depth)
        return flow.nodes, flow.edges

    return run
