"""Traces with typed nodes: functions, API calls, outside calls, UI events and routes, as sets or in the order of a walk."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.functions.scalars import layer
from spanweave.operators import graph, resolve
from spanweave.operators.checkpoints import cut

#: What a function does: (src, phase, ord, kind, key, label, file, line, target). kind: call, api, external, event or
#: route; target: the function that a call or an API call's route leads to, null if none; key: the node's id.
ACTION = ["src", "phase", "ord", "kind", "key", "label", "file", "line", "target"]


def node_types(functions: DataFrame, routes: DataFrame, events: DataFrame) -> DataFrame:
    """functions with type: route if it handles one, else event if it handles one by its id, else function.

    routes(route_id, handler); events(event_id, handler_function_id).
    """
    is_route = resolve.routes_of(functions, routes).select(F.col("function_id").alias("id"), F.lit(True).alias("_r")).distinct()
    is_event = resolve.events_by_handler(functions, events).select(F.col("function_id").alias("id"), F.lit(True).alias("_e")).distinct()
    kind = F.when(F.col("_r"), "route").when(F.col("_e"), "event").otherwise("function")
    return functions.join(is_route, "id", "left").join(is_event, "id", "left").withColumn("type", kind).drop("_r", "_e")


def actions(functions: DataFrame, calls: DataFrame, api_calls: DataFrame, routes: DataFrame, events: DataFrame) -> DataFrame:
    """ACTION of every function, in the order: API calls, calls, events, routes, each in their own.

    functions(id, name, file, file_ord, row_ord, start_line, end_line); calls(call_id, name, object, from, file, line, ord);
    api_calls(call_id, method, url, from, file, line, ord); routes(route_id, method, path, handler, file, ord);
    events(event_id, event, element, file, handler, calls_inside, line, ord). Calls that aren't worth following are left out.
    """
    target = lambda refs: resolve.resolve_functions(refs, functions).select("ref_id", F.col("function_id").alias("target"))
    label_of: Column = F.concat_ws(" ", "method", F.coalesce("url", F.lit("unknown")))
    api = resolve.calls_of(functions, api_calls)
    matched = resolve.match_routes(api_calls.select("call_id", "method", "url"), routes).where("route_id is not null").select("call_id", "route_id")
    handled = matched.join(routes.select("route_id", "handler", F.col("file").alias("r_file")).where("handler is not null"), "route_id")
    handled = target(handled.select(F.col("call_id").alias("ref_id"), F.col("handler").alias("name"), F.col("r_file").alias("caller_file"))).withColumnRenamed("ref_id", "call_id")
    api = api.join(handled, "call_id", "left").select(F.col("function_id").alias("src"), F.lit(0).alias("phase"), "ord", F.lit("api").alias("kind"), F.concat(F.lit("api:"), label_of).alias("key"), label_of.alias("label"), "file", "line", "target")
    known = resolve.known_names(calls.select("call_id", "name"), functions).select("call_id").distinct().withColumn("_k", F.lit(True))
    kept = calls.join(known, "call_id", "left").where(resolve.relevant(F.col("name"), F.col("object"), F.coalesce("_k", F.lit(False)))).drop("_k")
    kept = kept.join(target(kept.select(F.col("call_id").alias("ref_id"), "name", F.col("file").alias("caller_file"))).withColumnRenamed("ref_id", "call_id"), "call_id", "left")
    outside = F.concat(F.concat_ws(".", F.nullif("object", F.lit("")), "name"), F.lit("()"))
    inner = F.col("target").isNotNull()
    call = resolve.calls_of(functions, kept).select(
        F.col("function_id").alias("src"), F.lit(1).alias("phase"), "ord", F.when(inner, "call").otherwise("external").alias("kind"), F.when(inner, F.col("target")).otherwise(F.concat(F.lit("ext:"), outside)).alias("key"), F.when(inner, F.col("name")).otherwise(outside).alias("label"), "file", "line", "target"
    )
    none = F.lit(None).cast("string").alias("target")
    event = resolve.events_of(functions, events).join(events, "event_id").select(
        F.col("function_id").alias("src"), F.lit(2).alias("phase"), "ord", F.lit("event").alias("kind"), F.concat(F.lit("evt:"), "file", F.lit(":"), "line").alias("key"), F.concat("event", F.lit(" on <"), "element", F.lit(">")).alias("label"), "file", "line", none
    )
    route = resolve.routes_of(functions, routes).join(routes, "route_id").select(
        F.col("function_id").alias("src"), F.lit(3).alias("phase"), "ord", F.lit("route").alias("kind"), F.concat(F.lit("route:"), "route_id").alias("key"), F.concat_ws(" ", "method", "path").alias("label"), "file", F.lit(None).cast("int").alias("line"), none
    )
    return api.unionByName(call).unionByName(event).unionByName(route).select(*[F.col(c).cast("string" if c not in ("phase", "line") else "int").alias(c) for c in ACTION])


def function_edges(acts: DataFrame) -> DataFrame:
    """(src, dst) between functions."""
    return acts.where("target is not null").select("src", F.col("target").alias("dst")).distinct()


def _typed(reached: DataFrame, acts: DataFrame, typed: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of reached(root, node, depth) and of what these functions do of these kinds."""
    f = typed.select(F.col("id").alias("node"), F.col("name").alias("label"), "file", "start_line", "end_line", "type")
    own = reached.join(f, "node")
    does = reached.withColumnRenamed("node", "src").join(acts.where(F.col("kind").isin(kinds)), "src")
    out = does.groupBy("root", F.col("key").alias("node")).agg(F.min("depth").alias("depth"), F.min_by(F.struct("label", "file", F.col("line").alias("start_line"), F.col("kind").alias("type")), F.struct("depth", "src", "phase", "ord")).alias("x"))
    out = out.select("root", "node", "depth", "x.label", "x.file", "x.start_line", F.lit(None).cast("int").alias("end_line"), "x.type")
    into = F.col("kind").isin("event", "route")
    edges = does.select("root", F.when(into, F.col("key")).otherwise(F.col("src")).alias("src"), F.when(into, F.col("src")).otherwise(F.col("key")).alias("dst"))
    return own.select(*out.columns).unionByName(out), edges


def trace_forward(acts: DataFrame, typed: DataFrame, roots: DataFrame, max_depth: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, steps) of what the roots(root) do, as sets: every node at its smallest distance.

    Functions are reached by frontier joins; what each does outside (API calls, outside calls, events, routes)
    hangs on it. An API call leads on to its route's handler. steps: the nodes, one for each type, label and file,
    numbered by distance and then by node.
    """
    acts, typed = cut(acts), cut(typed)
    reached = graph.reach(function_edges(acts), roots, max_depth)
    nodes, edges = _typed(reached, acts, typed, ["api", "external", "event", "route"])
    inner = reached.withColumnRenamed("node", "src").where(F.col("depth") < max_depth).join(acts.where("target is not null"), "src")
    between = inner.select("root", F.when(F.col("kind") == "api", F.col("key")).otherwise(F.col("src")).alias("src"), F.col("target").alias("dst"))
    edges = edges.unionByName(between).where("src <> dst").distinct()
    return nodes, edges, numbered(nodes)


def trace_backward(acts: DataFrame, typed: DataFrame, roots: DataFrame, max_depth: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, steps) of what leads to the roots, with the UI events of their files that trigger a function before the last level; the roots are no steps."""
    acts, typed = cut(acts), cut(typed)
    back = function_edges(acts).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = graph.reach(back, roots, max_depth)
    own = typed.select(F.col("id").alias("node"), F.col("name").alias("label"), "file", "start_line", "end_line", "type")
    inner = reached.where(F.col("depth") < max_depth)
    with_events, event_edges = _typed(inner, acts, typed, ["event"])
    nodes = reached.join(own, "node").unionByName(with_events.where(F.col("node").startswith("evt:")), allowMissingColumns=True)
    between = inner.join(back, F.col("node") == F.col("src")).select("root", F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = event_edges.unionByName(between).where("src <> dst").distinct()
    return nodes, edges, numbered(nodes.where("node <> root"))


def numbered(nodes: DataFrame) -> DataFrame:
    """Steps of nodes: one for each root, type, label and file, with step from 1 by depth and node, and layer."""
    first = nodes.groupBy("root", "type", "label", "file").agg(F.min(F.struct("depth", "node")).alias("at"), F.min_by("start_line", F.struct("depth", "node")).alias("start_line"), F.min_by("end_line", F.struct("depth", "node")).alias("end_line"))
    d = first.withColumn("step", F.row_number().over(Window.partitionBy("root").orderBy("at", "type", "label", "file")))
    return d.select("root", "step", "type", "label", "file", "start_line", "end_line", F.col("at.node").alias("node"), F.col("at.depth").alias("depth"), layer(F.col("file")).alias("layer"))


_WALK = "root string, what string, n int, type string, label string, file string, line int, a string, b string"


def walk(acts: DataFrame, typed: DataFrame, roots: DataFrame, max_depth: int = 8) -> DataFrame:
    """(root, what, n, type, label, file, line, a, b): nodes, edges and steps in the order of a depth-first walk.

    A function is entered when it is called; its API calls, calls, events and routes follow in their order. One
    that has been left isn't expanded again, and one on the way to itself isn't entered. what: node (a is its id),
    edge (from a to b) or step; n counts each from 1 in the order in which they come first.

    The order of a walk is a sequence, so each root is walked in one task, over what trace_forward reaches from it
    only; roots are walked side by side.
    """
    acts, typed = cut(acts), cut(typed)
    reached = graph.reach(function_edges(acts), roots, max_depth)
    own = reached.join(typed.select(F.col("id").alias("node"), "name", "file", F.col("start_line").alias("line"), "type"), "node")
    does = F.sort_array(F.collect_list(F.struct("phase", F.col("ord"), "kind", "key", "label", "file", "line", "target")))
    each = acts.groupBy(F.col("src").alias("node")).agg(F.to_json(does).alias("does"))
    rows = own.join(each, "node", "left").select(F.col("root").cast("string").alias("root"), F.col("node").cast("string").alias("node"), "name", "file", "line", "type", "does")

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_walked(key[0], d, max_depth), columns=[c.split()[0] for c in _WALK.split(", ")])

    return rows.groupBy("root").applyInPandas(run, _WALK)


def _walked(root: str, d: pd.DataFrame, max_depth: int) -> Iterator[tuple]:
    info = {r.node: r for r in d.itertuples()}
    does = {n: json.loads(r.does) if isinstance(r.does, str) else [] for n, r in info.items()}
    seen: dict[str, dict] = {"node": {}, "edge": {}, "step": {}}
    out: list[tuple] = []

    def tell(what: str, key: object, *rest: object) -> None:
        if key not in seen[what]:
            seen[what][key] = True
            out.append((root, what, len(seen[what]), *rest))

    def place(key: str, kind: str, label: str, file: str | None, line: int | None) -> None:
        tell("node", key, kind, label, file, line, key, None)
        tell("step", (kind, label, file), kind, label, file, line, key, None)

    def join(a: str | None, b: str) -> None:
        if a is not None and a != b:
            tell("edge", (a, b), None, None, None, None, a, b)

    left: set[str] = set()
    # A frame is a function on the way: its node, what it does from where, and who is on the way.
    frames: list[tuple[str, int]] = []

    def enter(node: str, caller: str | None, depth: int) -> None:
        if depth > max_depth or node not in info or any(n == node for n, _ in frames):
            return
        r = info[node]
        line = None if pd.isna(r.line) else int(r.line)
        tell("node", node, r.type, r.name, r.file, line, node, None)
        join(caller, node)
        tell("step", (r.type, r.name, r.file), r.type, r.name, r.file, line, node, None)
        if node not in left:
            frames.append((node, 0))

    enter(root, None, 0)
    while frames:
        node, at = frames[-1]
        if at == len(does[node]):
            frames.pop()
            left.add(node)
            continue
        frames[-1] = (node, at + 1)
        x = does[node][at]
        kind, key, target = x["kind"], x["key"], x.get("target")
        if kind == "call":
            enter(target, node, len(frames))
            continue
        place(key, kind, x.get("label"), x.get("file"), x.get("line"))
        join(*((key, node) if kind in ("event", "route") else (node, key)))
        if target is not None:
            enter(target, key, len(frames))
    return iter(out)
