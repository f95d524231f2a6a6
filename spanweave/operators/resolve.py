"""Resolution joins: names to functions, URLs to routes, calls to edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.functions.scalars import route_pattern, url_path
from spanweave.sources.files import attach_code

#: Receivers and names that are noise, and outside libraries that are worth a step.
SKIP_OBJECTS = ["console", "Math", "JSON", "Object", "Array", "Promise", "Date", "String", "Number", "process", "fs", "path", "util", "stream", "http", "https", "Buffer", "crypto"]
SKIP_NAMES = [
    "map", "filter", "reduce", "push", "pop", "slice", "splice", "split", "replace", "trim", "then", "catch", "finally", "name", "line", "file", "type", "path", "handler", "length", "size",
    "has", "get", "set", "add", "delete", "clear",
]
ALLOWED_EXTERNALS = ["axios", "fetch", "mongoose", "prisma"]
#: Most shapes of route patterns that are broadcast; more are joined by shuffling.
MOST_SHAPES = 10_000


def _segments(path: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(path, r"\\", "/"), "/"), "")


def _joined(parts: Column, start: Column | int, length: Column | int) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.array_join(F.slice(parts, lit(start), lit(length)), "/")


def _place_keys(path: Column, of_function: bool) -> Column:
    """array<struct<rank, key>> on which a function's file and a caller's file meet: 1 the file, 2 the tail, 3 the folder, 4 anything.

    Tails meet in their last two segments, or where one of the paths is only the last segment of the other.
    """
    p = _segments(path)
    n = F.size(p)
    key = lambda rank, k, cond=None: F.when(F.lit(True) if cond is None else cond, F.struct(F.lit(rank).alias("rank"), k.alias("key")))
    last = F.element_at(p, -1)
    short, long = ("b", "a") if of_function else ("a", "b")
    keys = [key(1, F.concat(F.lit("f:"), path)), key(2, F.concat(F.lit("t:"), _joined(p, F.greatest(n - 1, F.lit(1)), 2)), n >= 2), key(2, F.concat(F.lit(f"{long}:"), last)), key(2, F.concat(F.lit(f"{short}:"), last), n == 1), key(4, F.lit(""))]
    folders = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit(3).alias("rank"), F.concat(F.lit("d:"), _joined(p, 1, i)).alias("key")))
    own = F.array(F.element_at(folders, -1))
    none = F.array(F.struct(F.lit(4).alias("rank"), F.lit("").alias("key")))
    return F.when(path.isNull() | (n < 1), none).otherwise(F.concat(F.filter(F.array(*keys), lambda x: x.isNotNull()), folders if of_function else own))


def resolve_functions(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """refs(ref_id, name, caller_file) with function_id and rank of the best function, null if there is none.

    functions: (id, name, file, file_ord, row_ord). Ranks: 0 the only one of that name; 1 in the caller's file;
    2 with the caller's path tail; 3 in the caller's folder or below; 4 the first of that name; then, for names
    that no function has, those that end in .name: 5 the only one; 6 with the caller's tail; 7 the first.

    The first function of each name and file gives a few keys (its file, tail and folders), and the first of each
    name and key is found by an aggregation; a reference meets at most one row of a key. So a name that many
    functions share and many references use makes no pairs, and functions are shuffled before they get their keys.
    """
    f = functions.groupBy("name", "file").agg(F.min(F.struct("file_ord", "row_ord", "id")).alias("at"), F.count("*").alias("n"))
    # Each dotted suffix of a name, so that "a.b.c" is found by "c" and by "b.c".
    parts = F.split("name", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct((i > 1).alias("short"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("name")))
    named = f.select("at", "n", "file", F.explode(suffixes).alias("s")).select("at", "n", F.col("s.short").alias("short"), F.col("s.name").alias("name"), F.explode(_place_keys(F.col("file"), True)).alias("k"))
    firsts = named.groupBy("name", "short", F.col("k.rank").alias("place"), F.col("k.key").alias("key")).agg(F.min("at").alias("at"), F.sum("n").alias("n"))
    asked = refs.select("name", "caller_file").distinct().select("name", "caller_file", F.explode(_place_keys(F.col("caller_file"), False)).alias("k"))
    hit = asked.select("name", "caller_file", F.col("k.rank").alias("place"), F.col("k.key").alias("key")).join(firsts, ["name", "place", "key"])
    alone = (F.col("place") == 4) & (F.col("n") == 1)
    rank = F.when(~F.col("short"), F.when(alone, 0).otherwise(F.col("place"))).when(alone, 5).when(F.col("place") == 2, 6).when(F.col("place") == 4, 7)
    best = hit.withColumn("rank", rank).where("rank is not null").groupBy("name", "caller_file").agg(F.min(F.struct("rank", "at")).alias("b"))
    best = best.select(F.col("name").alias("_n"), F.col("caller_file").alias("_c"), F.col("b.at.id").alias("function_id"), F.col("b.rank").alias("rank"))
    return refs.join(best, (F.col("name") == F.col("_n")) & F.col("caller_file").eqNullSafe(F.col("_c")), "left").drop("_n", "_c")


def function_definition(asked: DataFrame, functions: DataFrame, files: DataFrame) -> DataFrame:
    """asked(ref_id, name, caller_file) with the definition found: function_id, file, start_line, end_line and code, null if none."""
    f = functions.select(F.col("id").alias("function_id"), "file", "start_line", "end_line")
    found = resolve_functions(asked, functions).drop("rank").join(f, "function_id", "left")
    return attach_code(found, files)


def functions_by_id(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """refs(function_id) with the function's name, file and lines, null if there is none."""
    return refs.join(functions.select(F.col("id").alias("function_id"), "name", "file", "start_line", "end_line"), "function_id", "left")


def known_names(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """The rows of refs(name) that some function has as its name or as the end of its dotted name."""
    parts = F.split("name", r"\.")
    names = functions.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("name"))
    return refs.join(names.distinct(), "name", "left_semi")


def relevant(name: Column, obj: Column, known: Column) -> Column:
    """Whether a call is worth following."""
    skip = name.isNull() | (name == "") | name.isin(SKIP_NAMES) | F.coalesce(obj.isin(SKIP_OBJECTS), F.lit(False))
    return ~skip & (known | F.coalesce(obj.isin(ALLOWED_EXTERNALS), F.lit(False)) | name.isin(ALLOWED_EXTERNALS))


def filter_flow(flow: DataFrame) -> DataFrame:
    """Steps without noise names or receivers; boundary steps stay, and numbers stay as they are."""
    label = F.col("label")
    name, obj = F.element_at(F.split(F.replace(label, F.lit("()"), F.lit("")), r"\."), -1), F.get(F.split(label, r"\."), F.lit(0))
    return flow.where(F.col("type").isin("api", "route", "event", "external") | F.coalesce(~name.isin(SKIP_NAMES) & ~obj.isin(SKIP_OBJECTS), F.lit(True)))


def match_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """calls(call_id, method, url) with route_id and rank of the best route, null if none.

    routes: (route_id, method, path, ord). Ranks: 0 method and path; 1 path; 2 a pattern with named segments
    whose method is the call's or ANY or ALL; 3 on the longest suffix of the path. dynamic: URLs match none.

    Distinct methods and paths are matched once. Exact paths and suffixes meet by equality. Patterns that have
    named segments at the same places are a shape, and a path meets a shape's patterns by all its literal segments
    at once; the first route of a shape, literals and method stands for all of them, so a route like /:a/:b that
    every path of its length fits makes one row a path. The expression is only checked for the pairs left.
    """
    c = calls.where(F.coalesce(F.length("url") > 0, F.lit(False)) & ~F.col("url").startswith("dynamic:")).select(F.upper("method").alias("asked"), url_path(F.col("url")).alias("clean")).distinct()
    r = routes.select("route_id", F.col("method").alias("r_method"), "path", "ord")
    same = F.coalesce(F.col("asked") == F.col("r_method"), F.lit(False))
    by_path = c.join(r, c.clean == r.path).withColumn("rank", F.when(same, 0).otherwise(1)).withColumn("level", F.lit(0))
    parts = F.split("path", "/")
    named = lambda x: F.contains(x, F.lit(":"))
    patterned = r.where(F.contains("path", F.lit(":"))).select("*", F.transform(parts, named).alias("shape"), F.array_join(F.filter(parts, lambda x: ~named(x)), "/").alias("literals"), route_pattern(F.col("path")).alias("pattern"))
    firsts = patterned.groupBy("shape", "literals", "pattern", "r_method").agg(F.min(F.struct("ord", "route_id")).alias("f")).select("shape", "literals", "pattern", "r_method", "f.ord", "f.route_id")
    shapes = patterned.select("shape", F.size("shape").alias("depth")).distinct()
    shapes = F.broadcast(shapes) if shapes.limit(MOST_SHAPES + 1).count() <= MOST_SHAPES else shapes
    segments = F.split("clean", "/")
    literal = F.array_join(F.transform(F.filter(F.arrays_zip(segments.alias("s"), F.col("shape").alias("n")), lambda x: ~x["n"]), lambda x: x["s"]), "/")
    shaped = c.withColumn("depth", F.size(segments)).join(shapes, "depth").withColumn("literals", literal)
    by_pattern = shaped.join(firsts, ["shape", "literals"]).where(F.rlike("clean", F.col("pattern")) & (F.col("asked").isNull() | same | F.col("r_method").isin("ANY", "ALL")))
    by_pattern = by_pattern.withColumn("rank", F.lit(2)).withColumn("level", F.lit(0))
    full = F.array_remove(segments, "")
    trials = F.transform(F.sequence(F.lit(1), F.size(full)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(full, i, F.size(full)), "/")))
    suffixes = c.where(F.size(full) > 0).select("asked", "clean", F.posexplode(trials).alias("level", "trial"))
    by_suffix = suffixes.join(r, suffixes.trial == r.path).withColumn("rank", F.lit(3))
    cols = ["asked", "clean", "rank", "level", "ord", "route_id"]
    best = by_path.select(*cols).unionByName(by_pattern.select(*cols)).unionByName(by_suffix.select(*cols)).groupBy("asked", "clean").agg(F.min(F.struct(*cols[2:])).alias("b"))
    best = best.select("asked", "clean", F.col("b.route_id").alias("route_id"), F.col("b.rank").alias("rank"))
    keyed = calls.withColumn("_asked", F.upper("method")).withColumn("_clean", F.when((F.length("url") > 0) & ~F.col("url").startswith("dynamic:"), url_path(F.col("url"))))
    return keyed.join(best, F.col("_asked").eqNullSafe(F.col("asked")) & (F.col("_clean") == F.col("clean")), "left").drop("_asked", "_clean", "asked", "clean")


def unmatched(calls: DataFrame, routes: DataFrame, key: str) -> DataFrame:
    """Calls whose key no route has."""
    return calls.join(routes.select(key).distinct(), key, "left_anti")


def link_api_calls(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_id, route_id) of calls(call_id, method, key) and routes(route_id, method, key): all routes on the longest suffix of the key that any route has.

    The method must be the call's or ALL; a key that is found whole never falls back.
    """
    parts = F.array_remove(F.split("key", "/"), "")
    levels = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    trials = calls.select("call_id", "method", F.posexplode(levels).alias("level", "key"))
    hit = trials.join(routes.select("route_id", F.col("method").alias("r_method"), "key"), "key")
    first = Window.partitionBy("call_id").orderBy("level")
    hit = hit.withColumn("_r", F.dense_rank().over(first)).where("_r = 1")
    return hit.where((F.upper("method") == F.col("r_method")) | (F.col("r_method") == "ALL")).select("call_id", "route_id").distinct()


def call_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller_id, callee_id), distinct: calls(call_id, from, name, file) with both ends resolved."""
    ends = [resolve_functions(calls.select(F.col("call_id").alias("ref_id"), F.col(c).alias("name"), F.col("file").alias("caller_file")), functions).select(F.col("ref_id").alias("call_id"), F.col("function_id").alias(n)) for c, n in (("from", "caller_id"), ("name", "callee_id"))]
    return ends[0].join(ends[1], "call_id").where("caller_id is not null and callee_id is not null").select("caller_id", "callee_id").distinct()


def attach_metrics(routes: DataFrame, metrics: DataFrame) -> DataFrame:
    """routes(method, path) with the metrics of METHOD:path; null where there are none."""
    return routes.withColumn("metric_key", F.concat_ws(":", F.upper("method"), "path")).join(metrics, "metric_key", "left")


def events_of(functions: DataFrame, events: DataFrame) -> DataFrame:
    """(function_id, event_id): UI events of the function's file that it handles or that call it inside."""
    inner = F.explode(F.array_distinct(F.filter(F.concat(F.array("handler"), F.coalesce("calls_inside", F.array().cast("array<string>"))), lambda x: x.isNotNull())))
    e = events.select("event_id", "file", inner.alias("name"))
    return functions.select(F.col("id").alias("function_id"), "file", "name").join(e, ["file", "name"]).select("function_id", "event_id").distinct()


def resolve_event_entries(entries: DataFrame, events: DataFrame, functions: DataFrame) -> DataFrame:
    """entries(event, element) with function_id: the handler's function, else that of the first call inside that resolves."""
    e = entries.join(events.select("event_id", "event", "element", "file", "handler", "calls_inside"), ["event", "element"])
    names = F.concat(F.array(F.when(~F.col("handler").isin("inline", "conditional", "dynamic"), F.col("handler"))), F.coalesce("calls_inside", F.array().cast("array<string>")))
    tried = e.select("event_id", F.col("file").alias("caller_file"), F.posexplode(names).alias("pos", "name")).where("name is not null").withColumn("ref_id", F.concat_ws("#", "event_id", "pos"))
    found = resolve_functions(tried, functions).where("function_id is not null").groupBy("event_id").agg(F.min_by("function_id", "pos").alias("function_id"))
    return e.select("event", "element", "event_id").join(found, "event_id", "left")


def calls_of(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """calls(file, from, ...) of each of functions(id, file, name), with function_id: by file and caller name."""
    f = functions.select(F.col("id").alias("function_id"), "file", F.col("name").alias("from"))
    return calls.join(f, ["file", "from"])


def routes_of(functions: DataFrame, routes: DataFrame) -> DataFrame:
    """(function_id, route_id): routes whose handler is a function's name, also a dotted one's last part."""
    handler = F.explode(F.array_distinct(F.array("handler", F.element_at(F.split("handler", r"\."), -1))))
    r = routes.where("handler is not null").select("route_id", handler.alias("name"))
    return functions.select(F.col("id").alias("function_id"), "name").join(r, "name").select("function_id", "route_id").distinct()


def events_by_handler(functions: DataFrame, events: DataFrame) -> DataFrame:
    """(function_id, event_id) of events whose handler_function_id is the function."""
    return events.where("handler_function_id is not null").select(F.col("handler_function_id").alias("function_id"), "event_id").join(functions.select(F.col("id").alias("function_id")), "function_id", "left_semi")


def link_functions(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """refs(ref_id, target) with function_id: the function of that id, else of file::name, else the first of the last part of its name.

    functions: (id, name, file, file_ord, row_ord). Each way is an equi-join on the first function of its key.
    """
    at = F.struct("file_ord", "row_ord", "id")
    short = F.element_at(F.split("name", r"\."), -1)
    keys = F.array(*[F.struct(F.lit(i).alias("rank"), k.alias("key")) for i, k in enumerate((F.col("id"), F.concat_ws("::", "file", "name"), short))])
    firsts = functions.select(F.explode(keys).alias("k"), at.alias("at")).groupBy(F.col("k.rank").alias("rank"), F.col("k.key").alias("key")).agg(F.min("at").alias("at"))
    last = F.element_at(F.split(F.element_at(F.split("target", "::"), -1), r"\."), -1)
    file_name = F.when(F.col("target").rlike("::.*::"), F.regexp_replace("target", "::[^:]*$", "")).otherwise(F.col("target"))
    bare = F.when(F.col("target").rlike("::.*::"), F.element_at(F.split(F.element_at(F.split("target", "::"), -2), r"\."), -1)).otherwise(last)
    tried = F.array(*[F.struct(F.lit(i).alias("rank"), k.alias("key")) for i, k in enumerate((F.col("target"), file_name, bare))])
    # Each distinct target is looked up once, however many references have it.
    hit = refs.select("target").where("target is not null").distinct().select("target", F.explode(tried).alias("k")).select("target", "k.*").join(firsts, ["rank", "key"])
    best = hit.groupBy("target").agg(F.min(F.struct("rank", "at")).alias("b")).select("target", F.col("b.at.id").alias("function_id"), F.col("b.rank").alias("rank"))
    return refs.join(best, "target", "left")


def pulses_on_nodes(pulses: DataFrame, nodes: DataFrame) -> DataFrame:
    """pulses(pulse_id, node_id, method, route) with node: the node of that live id, else of METHOD:route. nodes(node, live_id)."""
    by_id = nodes.select(F.col("live_id").alias("node_id"), F.col("node").alias("_by_id"))
    key = F.concat_ws(":", F.upper("method"), "route")
    by_route = nodes.select(F.col("live_id").alias("_key"), F.col("node").alias("_by_route"))
    d = pulses.withColumn("_key", key).join(by_id, "node_id", "left").join(by_route, "_key", "left")
    return d.withColumn("node", F.coalesce("_by_id", "_by_route")).drop("_key", "_by_id", "_by_route")
