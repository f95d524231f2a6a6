"""Extractors: functions, calls, API calls, routes and UI events of JS/TS files, as DataFrame operations on tokens and lines.

Functions, calls, API calls, routes and exports are found in the table of tokens (sources/tokens.py), whatever lines
they go over; imports, routers' names and UI events in lines. There is no syntax tree and there are no types: names
are what they are called, and a URL is what resolved_url makes of its expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.functions.scalars import content_hash, join_paths, merge_base_url, normalize_path, normalize_url, path_params, route_match_key
from spanweave.operators.checkpoints import cut
from spanweave.operators.pointers import closure, follow
from spanweave.operators.sweep import stab
from spanweave.sources.tokens import neighbours, next_sibling, segments, tokens

#: Calls that are noise (by receiver, and without one), words before a bracket that call nothing, router names to start with, route verbs.
NOISE_MEMBERS = {
    "console": ["log", "warn", "error", "info", "debug", "trace", "assert", "group", "groupEnd", "time", "timeEnd"],
    "Object": ["keys", "values", "entries", "assign", "freeze", "create", "defineProperty", "getOwnPropertyNames", "fromEntries"],
    "Array": ["isArray", "from", "of"],
    "JSON": ["stringify", "parse"],
    "Math": ["floor", "ceil", "round", "max", "min", "abs", "random", "sqrt", "pow", "log"],
    "Promise": ["resolve", "reject", "all", "race", "allSettled", "any"],
    "Number": ["isInteger", "isFinite", "isNaN", "parseInt", "parseFloat"],
    "String": ["fromCharCode", "fromCodePoint"],
}
NOISE_GLOBALS = [
    "toString", "valueOf", "hasOwnProperty", "isPrototypeOf", "propertyIsEnumerable", "push", "pop", "shift", "unshift", "splice", "slice", "concat", "join", "reverse", "sort", "flat",
    "flatMap", "trim", "trimStart", "trimEnd", "padStart", "padEnd", "split", "replace", "replaceAll", "includes", "startsWith", "endsWith", "indexOf", "lastIndexOf", "find", "findIndex",
    "filter", "map", "reduce", "reduceRight", "forEach", "some", "every", "keys", "values", "entries", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "requestAnimationFrame",
    "cancelAnimationFrame", "parseInt", "parseFloat", "isNaN", "isFinite", "encodeURI", "decodeURI", "encodeURIComponent", "decodeURIComponent", "require", "Symbol", "BigInt", "Boolean",
    "Number", "String",
]
KEYWORDS = [
    "if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import", "with", "do", "else", "void", "delete", "in", "of", "new", "class", "async", "get",
    "set", "static", "constructor",
]
ROUTER_NAMES = ["app", "router", "server", "fastify", "api", "r"]
VERBS = ["get", "post", "put", "patch", "delete", "head", "options", "use", "all"]

_ID = r"[A-Za-z_$][\w$]*"
_STRING = r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"""
_QUOTED = r"""["'`]([^"'`]*)["'`]"""


def without_comments(content: Column) -> Column:
    """The text with comments taken out and every line in its place."""
    parts = F.split(content, r"""(?<![\w'"`/*.])/\*""")
    after = lambda p: F.concat(F.regexp_replace(F.regexp_extract(p, r"(?s)^(.*?)(?:\*/|$)", 1), r"[^\n]", ""), F.regexp_replace(p, r"(?s)^.*?(?:\*/|\z)", ""))
    bare = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(after(p))), "")
    return F.regexp_replace(bare, r"(?m)(^|[\s;{}(,])//.*$", "$1")


def source_lines(files: DataFrame) -> DataFrame:
    """(file, line, code, bare, opened, closed, depth) of files(path, content): code without comments, bare also without strings; depth of braces after the line."""
    d = files.select(F.col("path").alias("file"), F.posexplode(F.split(without_comments(F.coalesce("content", F.lit(""))), "\n")).alias("_i", "code"))
    d = d.withColumn("line", F.col("_i") + 1).withColumn("bare", F.regexp_replace("code", _STRING, '""'))
    count = lambda ch: F.length("bare") - F.length(F.replace("bare", F.lit(ch), F.lit("")))
    d = d.withColumn("opened", count("{")).withColumn("closed", count("}"))
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("depth", F.sum(F.col("opened") - F.col("closed")).over(upto)).drop("_i")


def _ends(starts: DataFrame, lines: DataFrame) -> DataFrame:
    """starts(file, line) with end_line: the first line from there on that comes back to the depth before it.

    Starts and closings of a depth are ordered together, so each start takes the next closing; no pairs are made.
    """
    s = starts.join(lines.select("file", "line", "opened", "closed", "depth"), ["file", "line"])
    level = F.col("depth") - F.col("opened") + F.col("closed")
    s = s.withColumn("level", level)
    same = s.where((F.col("opened") == 0) | (F.col("depth") <= F.col("level"))).withColumn("end_line", F.col("line")).drop("opened", "closed", "depth", "level")
    more = s.where((F.col("opened") > 0) & (F.col("depth") > F.col("level"))).drop("opened", "closed", "depth")
    before = F.col("depth") - F.col("opened") + F.col("closed")
    closings = lines.where(F.col("depth") < before).select("file", "line", F.explode(F.sequence(F.col("depth"), before - 1)).alias("level")).withColumn("closing", F.col("line"))
    keys = [c for c in more.columns if c not in closings.columns]
    both = more.withColumn("closing", F.lit(None).cast("int")).unionByName(closings, allowMissingColumns=True)
    ahead = Window.partitionBy("file", "level").orderBy("line", F.col("closing").isNull()).rowsBetween(1, Window.unboundedFollowing)
    ended = both.withColumn("end_line", F.first("closing", ignorenulls=True).over(ahead)).where(F.col("closing").isNull())
    return same.unionByName(ended.select("file", "line", *keys, F.coalesce("end_line", "line").alias("end_line")))


#: What stands before a function that is a value.
_VALUE = ["=", "(", ",", ":", "return", "=>", "?", "&&", "||", "??", "[", "!", "new", "typeof", "await", "+", "yield", "void", "${", "..."]
_STATEMENT = ["const", "let", "var", "function", "class", "export", "import", "return", "if", "for", "while", "switch", "try", "throw"]


def code_tokens(files: DataFrame) -> DataFrame:
    """The tokens of files with their neighbours, written once for all extractors."""
    return cut(neighbours(tokens(files)))


def _named(start_line: Column, col: Column) -> list[Column]:
    """(name, type of a function that is assigned to it, exported) of a function by the tokens q1 ... q5 before it."""
    q = lambda i: F.col(f"q{i}")
    declares = lambda c: F.coalesce(c.isin("const", "let", "var", ","), F.lit(False))
    plain, typed = (q(1) == "=") & declares(q(3)), (q(1) == "=") & (q(3) == ":") & declares(q(5))
    exports = (q(1) == "=") & (q(3) == ".") & (q(4) == "exports")
    key = (q(1) == ":") & q(3).isin("{", ",")
    name = F.when(plain | exports | key, q(2)).when(typed, q(4)).otherwise(F.concat(F.lit("anonymous_L"), start_line, F.lit("_C"), col))
    kind = F.when(exports, "exportAssignment").when(key, "method")
    return [name.alias("name"), kind.alias("own_type"), F.coalesce(exports | (plain & (q(4) == "export")) | (q(1) == "default"), F.lit(False)).alias("is_exported"), F.coalesce(q(1) == "default", F.lit(False)).alias("is_default_export"), (~(plain | typed | exports | key)).alias("unnamed")]


def extract_functions(files: DataFrame, lines: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(id, content_hash, file, name, start_line, end_line, type, is_async, is_exported, is_default_export, parent_function, start_seq, end_seq).

    Declarations, function expressions and arrow functions (named by their variable, key or export, else by their
    place), methods, getters and setters; heads and bodies may go over lines. found: code_tokens(files).
    lines isn't read. A function's tokens go from start_seq to end_seq.
    """
    t = code_tokens(files) if found is None else found
    text, after = F.col("text"), F.col("after")
    term = (F.col("kind") == "punct") & text.isin(",", ";") | (text.isin(_STATEMENT) & (F.col("pl1") < F.col("line")))
    t = t.withColumn("term", next_sibling(term, F.struct(F.col("seq"), F.col("pl1").alias("line"))))
    body = F.when(F.col("n1") == "{", F.struct(F.col("n1_mate").alias("seq"), F.col("n1_mate_line").alias("line")))
    until = F.coalesce(body, F.when(F.col("term").isNotNull(), F.struct((F.col("term.seq") - 1).alias("seq"), F.col("term.line").alias("line"))), F.struct((F.col("close") - 1).alias("seq"), F.col("close_line").alias("line")))
    arrow = (text == "=>") & (F.col("kind") == "punct")
    t = t.withColumn("arrow_end", F.when(arrow, until))
    stops = (F.col("kind") == "punct") & text.isin("=>", ";", ",", "=", "{", "?")
    t = t.withColumn("next_stop", next_sibling(stops, F.struct(text.alias("text"), F.col("arrow_end").alias("end"))))
    t = t.withColumn("next_brace", next_sibling((text == "{") & (F.col("kind") == "punct"), F.struct(F.col("mate").alias("seq"), F.col("mate_line").alias("line"))))
    last = t.groupBy(F.col("file").alias("l_file")).agg(F.max("line").alias("last_line"), F.max("seq").alias("last_seq"))

    is_async = F.col("p1") == "async"
    shifted = [F.when(is_async, F.col(f"p{i + 1}")).otherwise(F.col(f"p{i}")).alias(f"q{i}") for i in range(1, 6)]
    opener = (text == "(") & ((after == "=>") | ((after == ":") & ~F.coalesce(F.col("p1") == "?", F.lit(False)))) & (F.col("next_stop.text") == "=>")
    single = (F.col("kind") == "name") & (F.col("n1") == "=>") & ~F.coalesce((F.col("p1") == ":") & (F.col("p2") == ")"), F.lit(False))
    function = (F.col("kind") == "name") & (text == "function") & ~F.coalesce(F.col("p1").isin(".", "?."), F.lit(False))
    own_name = F.when(F.col("n1") == "*", F.col("n2")).otherwise(F.col("n1"))
    d = t.where(opener | single | function).select("*", *shifted, is_async.alias("_async"), F.when(function, "function").otherwise("arrow").alias("form"))
    d = d.withColumn("end", F.when(F.col("form") == "function", F.col("next_brace")).otherwise(F.col("next_stop.end")))
    value = F.coalesce(F.col("q1").isin(_VALUE), F.lit(False)) | (own_name == "(")
    declared = (F.col("form") == "function") & ~value
    d = d.select("*", *_named(F.when(is_async, F.col("pl1")).otherwise(F.col("line")).cast("string"), F.when(is_async, F.col("pc1")).otherwise(F.col("col")).cast("string")))
    exported = F.coalesce((F.col("q1") == "export") | (F.col("q1") == "default"), F.lit(False))
    d = d.select(
        "file", F.when(declared, own_name).otherwise(F.col("name")).alias("name"), F.when(declared, "declaration").otherwise(F.coalesce("own_type", F.when(F.col("form") == "arrow", "arrow").otherwise("expression"))).alias("type"),
        (F.col("seq") - F.col("_async").cast("int")).alias("start_seq"), F.when(is_async, F.col("pl1")).otherwise(F.col("line")).alias("line"), "end", F.coalesce("_async", F.lit(False)).alias("is_async"),
        F.when(declared, exported).otherwise(F.col("is_exported")).alias("is_exported"), F.when(declared, F.coalesce(F.col("q1") == "default", F.lit(False))).otherwise(F.col("is_default_export")).alias("is_default_export"),
    )
    owner = F.when(F.col("p2") == "class", F.col("p1")).when((F.col("p2") == "extends") & (F.col("p4") == "class"), F.col("p3")).when((F.col("p4") == "extends") & (F.col("p6") == "class"), F.col("p5"))
    classes = t.where((text == "{") & owner.isNotNull()).select("file", F.col("seq").alias("parent"), owner.alias("owner"))
    head = (F.col("kind") == "name") & (F.col("n1") == "(") & F.col("n1_after").isin("{", ":") & ~text.isin([k for k in KEYWORDS if k not in ("constructor", "get", "set", "static", "async", "of")])
    called = F.coalesce(F.col("p1").isin("function", ".", "?.", "new", "=", "=>", "(", ":", "?", "return", "await", "&&", "||", "?") | ((F.col("p1") == "*") & (F.col("p2") == "function")), F.lit(False))
    m = t.where(head & ~called & F.col("parent").isNotNull() & ((F.col("n1_after") == "{") | (F.col("next_brace").isNotNull()))).join(classes, ["file", "parent"], "left")
    m = m.where(F.col("owner").isNotNull() | ((F.col("n1_after") == "{") & F.col("p1").isin("{", ",", "async", "get", "set", "*")))
    kind = F.when(F.col("p1") == "get", "getter").when(F.col("p1") == "set", "setter").when(F.col("owner").isNotNull(), "classMethod").otherwise("objectMethod")
    no = F.lit(False)
    m = m.where((F.col("owner").isNotNull()) | (text != "constructor")).select("file", F.concat_ws(".", "owner", "text").alias("name"), kind.alias("type"), F.col("seq").alias("start_seq"), "line", F.col("next_brace").alias("end"), F.coalesce(is_async, no).alias("is_async"), no.alias("is_exported"), no.alias("is_default_export"))
    named = d.unionByName(m).join(last, F.col("file") == F.col("l_file"))
    named = named.select("file", "name", F.col("line").alias("start_line"), F.coalesce("end.line", "last_line").alias("end_line"), "type", "is_async", "is_exported", "is_default_export", "start_seq", F.coalesce("end.seq", "last_seq").alias("end_seq"))
    # A place with a name is one function.
    first = Window.partitionBy("file", "name", "start_line").orderBy("start_seq")
    named = cut(named.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r"))
    outer = stab(named, named, "file", "start_seq", "start_seq", "end_seq", "name", strictly=True).drop("hit_start", "hit_end").withColumnRenamed("hit_name", "parent_function")
    return outer.withColumn("id", F.concat_ws("::", "file", "name", "start_line")).withColumn("content_hash", content_hash(F.col("file"), F.col("name"), F.col("start_line"), F.col("end_line")))


def within(rows: DataFrame, functions: DataFrame, strictly: bool = False) -> DataFrame:
    """rows(file, line) with caller: the innermost function around the line, or module; by one sweep of a file's lines."""
    hit = stab(rows, functions, "file", "line", "start_line", "end_line", "name", strictly=strictly).drop("hit_start", "hit_end")
    return hit.withColumn("caller", F.coalesce("hit_name", F.lit(None if strictly else "module"))).drop("hit_name")


def caller_of(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """rows(file, seq) with from: the innermost function around the token that has a name of its own, or module."""
    named = functions.where(~F.col("name").startswith("anonymous_L"))
    hit = stab(rows, named, "file", "seq", "start_seq", "end_seq", "name").drop("hit_start", "hit_end")
    return hit.withColumn("from", F.coalesce("hit_name", F.lit("module"))).drop("hit_name")


def _joined_path(folder: Column, relative: Column) -> Column:
    """A relative path from a folder, without its . and .. segments."""
    parts = F.filter(F.concat(F.split(folder, "/"), F.split(relative, "/")), lambda x: ~x.isin("", "."))
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolved_sources(d: DataFrame, files: DataFrame) -> DataFrame:
    """d(file, source) with is_local and resolved: the first of a local source as it is, with an extension, or an index file in it, that is among files."""
    folder = F.regexp_replace("file", "[^/]*$", "")
    d = d.withColumn("is_local", F.col("source").startswith(".")).withColumn("_base", F.when(F.col("source").startswith("."), _joined_path(folder, F.col("source"))))
    tried = ["", ".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.jsx", "/index.ts", "/index.tsx"]
    ways = d.select("_base").where("_base is not null").distinct().select("_base", F.posexplode(F.array(*[F.concat("_base", F.lit(t)) for t in tried])).alias("way", "path"))
    known = ways.join(files.select("path").distinct(), "path").groupBy("_base").agg(F.min_by("path", "way").alias("resolved"))
    return d.join(known, "_base", "left").drop("_base")


def extract_imports(files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(file, source, name, imported_as, type, is_local, resolved): names that import and require lines bind, with the file that a local source is.

    type: named, default, namespace or module; resolved: the first of the source as it is, with an extension, or an
    index file in it, that is among the files.
    """
    lines = cut(source_lines(files)) if lines is None else lines
    sides = [rf"^\s*import\s+(.+?)\s+from\s+{_QUOTED}", rf"^\s*(?:const|let|var)\s+(.+?)\s*=\s*require\(\s*{_QUOTED}\s*\)"]
    hit = [F.struct(F.regexp_extract("code", p, 1).alias("left"), F.regexp_extract("code", p, 2).alias("source")) for p in sides]
    d = lines.select("file", F.explode(F.array(*hit)).alias("h")).where("h.source <> ''").select("file", "h.left", "h.source")
    inner = F.filter(F.transform(F.split(F.regexp_extract("left", r"\{(.*)\}", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    pair = lambda x: F.struct(F.regexp_extract(x, rf"^({_ID})", 1).alias("name"), F.regexp_extract(x, rf"({_ID})$", 1).alias("imported_as"), F.lit("named").alias("type"))
    rest = F.trim(F.regexp_replace("left", r"\{.*\}|,", ""))
    bare = F.regexp_replace(rest, r"^\*\s+as\s+", "")
    kind = F.when(rest.startswith("*"), "namespace").when(rest == "", None).otherwise("default")
    single = F.array(F.struct(F.when(kind == "default", "default").otherwise(F.lit(None).cast("string")).alias("name"), bare.alias("imported_as"), kind.alias("type")))
    d = d.select("file", "source", F.explode(F.concat(F.transform(inner, pair), F.filter(single, lambda x: x["type"].isNotNull()))).alias("i")).select("file", "source", "i.*").where("imported_as <> ''")
    return resolved_sources(d, files)


def extract_exports(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(file, name, local, source, resolved): names that a file exports from another one, or of its own bindings (null source); name and local are * where all go on."""
    t = code_tokens(files) if found is None else found
    stars = t.where("kind = 'name' and text = 'export' and n1 = '*' and n2 = 'from'").select("file", F.lit("*").alias("name"), F.lit("*").alias("local"), F.col("n3").alias("source"))
    lists = t.withColumn("source", F.when(F.col("after") == "from", next_sibling(F.col("kind") == "string", F.col("text")))).where("text = '{' and p1 = 'export'")
    lists = lists.select("file", F.col("seq").alias("parent"), "source")
    e = segments(t, lists).join(lists, ["file", "parent"])
    named = e.select("file", F.element_at("toks", -1)["text"].alias("name"), F.get("toks", F.lit(0))["text"].alias("local"), "source")
    return resolved_sources(stars.unionByName(named), files).select("file", "name", "local", "source", "resolved")


def exported_functions(functions: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(file, name, id): the function that each name stands for in a file, its own or through any number of re-exports.

    A file's own function comes first, then a name in an export list, then the nearest file whose names go on
    through export *. Chains are followed by pointer doubling; one that runs in a circle stands for nothing.
    """
    short = F.element_at(F.split("name", r"\."), -1)
    own = functions.select("file", F.explode(F.array_distinct(F.array("name", short))).alias("name"), F.struct("start_seq" if "start_seq" in functions.columns else "start_line", "id").alias("at"))
    default = functions.where("is_default_export").select("file", F.lit("default").alias("name"), F.struct("start_seq" if "start_seq" in functions.columns else "start_line", "id").alias("at"))
    own = cut(own.unionByName(default).groupBy("file", "name").agg(F.max("at")["id"].alias("id")))
    bound = imports.where("resolved is not null and name is not null").select("file", F.col("imported_as").alias("local"), F.struct(F.col("resolved").alias("file"), "name").alias("by"))
    listed = exports.where("name <> '*'").join(bound, ["file", "local"], "left")
    to = F.when(F.col("source").isNotNull(), F.struct(F.col("resolved").alias("file"), F.col("local").alias("name"))).otherwise(F.coalesce("by", F.struct("file", F.col("local").alias("name"))))
    listed = cut(listed.select("file", "name", to.alias("next")).where("next.file is not null and not (file = next.file and name = next.name)"))
    star = exports.where("name = '*' and resolved is not null and resolved <> file").select(F.col("file").alias("src"), F.col("resolved").alias("dst")).distinct()
    onward = closure(star)
    names = own.select("file", "name").unionByName(listed.select("file", "name")).distinct().where("name <> 'default' and not name like 'anonymous\\_L%'")
    spread = onward.join(names.withColumnRenamed("file", "dst"), "dst").select(F.col("src").alias("file"), "name", F.struct(F.col("dst").alias("file"), "name").alias("next"), (F.col("distance") + 1).alias("rank"))
    ways = listed.withColumn("rank", F.lit(1).cast("long")).unionByName(spread).join(own, ["file", "name"], "left_anti")
    chosen = ways.groupBy("file", "name").agg(F.min(F.struct("rank", "next"))["next"].alias("next"))
    node = lambda f, n: F.struct(F.col(f).alias("file"), F.col(n).alias("name"))
    pointers = chosen.select(node("file", "name").alias("node"), "next", F.lit(None).cast("string").alias("target")).unionByName(own.select(node("file", "name").alias("node"), F.lit(None).cast("struct<file:string,name:string>").alias("next"), F.col("id").alias("target")))
    return follow(pointers).select("node.file", "node.name", F.col("target").alias("id")).where("id is not null")


def with_callees(calls: DataFrame, functions: DataFrame, imports: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """calls(file, name, object) with callee_function_id and is_external, by symbols: a function of the file, else the one that an import of the name, or of the object, leads to, also through re-exports.

    is_external: the name or object comes from an import that isn't local.
    """
    if exports is None:
        exports = imports.sparkSession.createDataFrame([], "file string, name string, local string, source string, resolved string")
    known = cut(exported_functions(functions, imports, exports))
    own = known.join(functions.select("file", "id"), ["file", "id"], "left_semi").select("file", "name", F.col("id").alias("_own"))
    bound = imports.groupBy("file", F.col("imported_as").alias("_bound")).agg(F.first("resolved").alias("_to"), F.first("name").alias("_as"), F.first("is_local").alias("_local"))
    keyed = calls.withColumn("_bound", F.coalesce("object", "name")).join(bound, ["file", "_bound"], "left")
    wanted = F.when(F.col("object").isNull() & F.col("_as").isNotNull(), F.col("_as")).otherwise(F.col("name"))
    there = known.select(F.col("file").alias("_to"), F.col("name").alias("_wanted"), F.col("id").alias("_there"))
    by_name = known.select(F.col("file").alias("_to"), "name", F.col("id").alias("_named"))  # a default import whose file exports a function of that name
    found = keyed.withColumn("_wanted", wanted).join(there, ["_to", "_wanted"], "left").join(by_name, ["_to", "name"], "left").join(own, ["file", "name"], "left")
    local = F.when(F.col("object").isNull() | (F.col("object") == "this"), F.col("_own"))
    fallback = F.when(F.col("object").isNull() & (F.col("_as") == "default"), F.col("_named"))
    return found.withColumn("callee_function_id", F.coalesce(local, "_there", fallback)).withColumn("is_external", F.coalesce(~F.col("_local"), F.lit(False))).drop("_bound", "_to", "_as", "_local", "_wanted", "_there", "_named", "_own")


def _call_sites(t: DataFrame) -> DataFrame:
    """The brackets of calls, with name, object (this or a name right before it), first line and whether new stands before."""
    member = F.col("p2").isin(".", "?.")
    single = member & (F.col("pk3") == "name") & ~F.coalesce(F.col("p4").isin(".", "?."), F.lit(False))
    obj = F.when(single, F.col("p3"))
    made = F.when(member, F.when(obj.isNotNull(), F.col("p4") == "new")).otherwise(F.col("p2") == "new")
    site = (F.col("text") == "(") & (F.col("kind") == "punct") & (F.col("pk1") == "name")
    return t.where(site).select(
        "file", "seq", "parent", "mate", F.col("mate_line").alias("end_line"), F.col("p1").alias("name"), obj.alias("object"), F.coalesce(member, F.lit(False)).alias("member"), F.coalesce(made, F.lit(False)).alias("made"),
        F.when(obj.isNotNull(), F.col("pl3")).otherwise(F.col("pl1")).alias("line"), "col", *[f"p{i}" for i in range(2, 7)], "after",
    )


def extract_calls(files: DataFrame, functions: DataFrame, lines: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(file, start_line, end_line, pos, callee, name, object, type, is_callback, from): calls and constructors that aren't noise, with the named function around them.

    A call may go over lines. Its object is this or the name right before its own; a longer chain has none. An
    identifier that is an argument of a call is a call of its own (callback), noise apart. pos: the column.
    """
    t = code_tokens(files) if found is None else found
    sites = _call_sites(t)
    method = F.coalesce(F.col("p2").isin("function", "*"), F.lit(False)) & ~F.col("member")
    c = sites.where(~method & ~F.col("name").isin([k for k in KEYWORDS if k not in ("get", "set", "of")]) | F.col("member"))
    heads = functions.where(F.col("type").isin("classMethod", "objectMethod", "getter", "setter")).select("file", (F.col("start_seq") + 1).alias("seq"))
    c = c.join(heads, ["file", "seq"], "left_anti")
    kind = F.when(F.col("made"), "constructor").when(F.col("member"), "member").otherwise("direct")
    direct = c.select("file", "seq", "line", "end_line", "col", "name", "object", kind.alias("type"), F.lit(False).alias("is_callback"))
    argument = (F.col("kind") == "name") & F.col("p1").isin("(", ",") & F.col("n1").isin(",", ")")
    handed = t.where(argument).join(c.select("file", F.col("seq").alias("parent")), ["file", "parent"], "left_semi")
    handed = handed.select("file", "seq", "line", F.col("line").alias("end_line"), "col", F.col("text").alias("name"), F.lit(None).cast("string").alias("object"), F.lit("callback").alias("type"), F.lit(True).alias("is_callback"))
    c = direct.unionByName(handed).withColumn("callee", F.concat_ws(".", "object", "name"))
    noise = F.coalesce(F.col("object").isNull() & F.col("name").isin(NOISE_GLOBALS + [k for k in KEYWORDS if k not in ("get", "set", "of")] + ["null", "undefined", "true", "false", "this"]), F.lit(False))
    noise = noise & ((F.col("type") != "member") | F.col("name").isin(NOISE_GLOBALS))
    for obj, members in NOISE_MEMBERS.items():
        noise = noise | F.coalesce((F.col("object") == obj) & F.col("name").isin(members), F.lit(False))
    d = caller_of(c.where(~noise), functions)
    first = Window.partitionBy("file", "callee", "from", "line").orderBy("seq")
    d = d.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return d.select("file", F.col("line").alias("start_line"), "end_line", F.col("col").alias("pos"), "callee", "name", "object", "type", "is_callback", "from")


def http_clients(sites: DataFrame, options: DataFrame) -> DataFrame:
    """(file, name, seq, base_url): names assigned from the create of a known client, which is axios or one of them, with their base URLs.

    A client's parent is the last one of that name created before it (an as-of join within the file); its base URL
    is merged into its own. Clients are resolved from axios on, a round for each level of inheritance.
    """
    name = F.when(F.col("p4") == "=", F.col("p5")).when((F.col("p4") == "await") & (F.col("p5") == "="), F.col("p6"))
    made = sites.where((F.col("name") == "create") & F.col("object").isNotNull() & name.isNotNull()).select("file", "seq", name.alias("name"), F.col("object").alias("maker"))
    base = options.where("key = 'baseURL' and idx = 0").select("file", F.col("call").alias("seq"), F.col("text").alias("own"))
    made = cut(as_of(made.join(base, ["file", "seq"], "left"), made.select("file", "seq", "name", F.col("seq").alias("parent_seq")), "maker", "parent_seq"))
    known = cut(made.where("parent_seq is null and maker = 'axios'").select("file", "name", "seq", F.nullif("own", F.lit("")).alias("base_url")))
    while True:
        above = known.select("file", F.col("seq").alias("parent_seq"), F.col("base_url").alias("above"))
        more = made.join(above, ["file", "parent_seq"]).join(known.select("file", "seq"), ["file", "seq"], "left_anti")
        more = cut(more.select("file", "name", "seq", F.when(F.coalesce("own", F.lit("")) != "", merge_base_url(F.col("above"), F.col("own"))).otherwise(F.col("above")).alias("base_url")))
        if more.isEmpty():
            return known
        known = cut(known.unionByName(more))


def as_of(uses: DataFrame, definitions: DataFrame, by: str, value: str) -> DataFrame:
    """uses(file, seq, by) with value of the last of definitions(file, seq, name, value) of that name before it in its file.

    Both are sorted together by file, name and place; a use takes what it follows, so no pairs are made.
    """
    u = uses.withColumn("_def", F.lit(False)).withColumn("name_", F.col(by))
    d = definitions.select("file", "seq", F.col("name").alias("name_"), F.struct(F.col(value)).alias("_v"), F.lit(True).alias("_def"))
    before = Window.partitionBy("file", "name_").orderBy("seq", F.col("_def").cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    both = u.unionByName(d, allowMissingColumns=True).withColumn("_found", F.last("_v", ignorenulls=True).over(before)).where("not _def")
    return both.select(*uses.columns, F.col("_found")[value].alias(value))


def resolved_url(toks: Column) -> Column:
    """(url, is_dynamic, static_prefix) of an expression's tokens: a literal as it is, else dynamic: and what is known of it.

    Of a template the holes are :param; an identifier is its name. Of a sum of two its literal parts, of a longer
    one the last; anything else is unknown.
    """
    loose = ["?", "||", "&&", "??", "==", "===", "!=", "!==", "=", "=>", "<", ">", "<=", ">=", ":", "in", "instanceof"]
    plus = F.filter(toks, lambda x: (x["text"] == "+") & (x["kind"] == "punct"))
    others = F.exists(toks, lambda x: (x["kind"] != "string") & (x["kind"] != "template") & x["text"].isin(loose))
    side = lambda keep: F.filter(toks, keep)
    first = side(lambda x: x["seq"] < F.coalesce(F.get(plus, F.lit(0))["seq"], F.lit(1 << 30)))
    last = side(lambda x: x["seq"] > F.coalesce(F.element_at(plus, -1)["seq"], F.lit(-1)))
    head = lambda p: F.get(p, F.lit(0))
    alone = lambda p: (F.size(p) == 1) | ((F.size(p) == 2) & (head(p)["kind"] == "template"))
    literal = lambda p: F.when(alone(p) & ((head(p)["kind"] == "string") | ((head(p)["kind"] == "template") & ~head(p)["text"].contains("${}"))), head(p)["text"])
    holes = F.when(alone(toks) & (head(toks)["kind"] == "template"), head(toks)["text"])
    name = F.when(alone(toks) & (head(toks)["kind"] == "name"), head(toks)["text"])
    summed = F.concat(F.when(F.size(plus) == 1, F.coalesce(literal(first), F.lit(""))).otherwise(F.lit("")), F.coalesce(literal(last), F.lit(":param")))
    dynamic = F.when(F.size(plus) > 0, F.when(others, "unknown").otherwise(summed)).otherwise(F.coalesce(F.replace(holes, F.lit("${}"), F.lit(":param")), name, F.lit("unknown")))
    fixed = F.when(F.size(plus) == 0, literal(toks))
    prefix = F.coalesce(fixed, F.when((F.size(plus) == 1) & ~others, literal(first)), F.nullif(F.regexp_extract(holes, r"^(.*?)\$\{", 1), F.lit("")))
    return F.struct(F.coalesce(fixed, F.concat(F.lit("dynamic:"), dynamic)).alias("url"), fixed.isNull().alias("is_dynamic"), prefix.alias("static_prefix"))


def _options(t: DataFrame, arguments: DataFrame) -> DataFrame:
    """(file, call, idx, key, toks, text): the entries of object literals that are arguments of calls; text of those that are a string."""
    braces = arguments.where((F.get("toks", F.lit(0))["text"] == "{") & (F.size("toks") == 2)).select("file", F.col("parent").alias("call"), F.col("idx").alias("arg"), F.get("toks", F.lit(0))["seq"].alias("parent"))
    e = segments(t, braces).join(braces, ["file", "parent"]).where(F.get("toks", F.lit(1))["text"] == ":")
    rest = F.slice("toks", 3, F.greatest(F.size("toks") - 2, F.lit(0)))
    only = F.when((F.size(rest) == 1) & (F.get(rest, F.lit(0))["kind"] == "string"), F.get(rest, F.lit(0))["text"])
    return e.select("file", "call", F.col("arg").alias("idx"), F.get("toks", F.lit(0))["text"].alias("key"), rest.alias("toks"), only.alias("text"))


def extract_api_calls(files: DataFrame, functions: DataFrame, lines: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(file, start_line, end_line, lib, method, method_is_dynamic, url, normalized_url, route_match_key, base_url, static_prefix, is_dynamic, from): fetch, axios and client instances.

    fetch(url, {method}), client(url), client({url, method}) and client.verb(url), over any number of lines; URLs as
    resolved_url has them, below the base URL of the client that the name stands for at that place.
    """
    t = code_tokens(files) if found is None else found
    sites = cut(_call_sites(t))
    verbs = [v for v in VERBS if v not in ("use", "all")] + ["request"]
    creates = sites.where("name = 'create' and object is not null")
    fetches = sites.where("name = 'fetch' and not member").withColumn("client", F.lit(None).cast("string"))
    plain = sites.where("not member and not made and name <> 'fetch'").withColumn("client", F.col("name"))
    members = sites.where(F.col("object").isNotNull() & F.lower("name").isin(verbs)).withColumn("client", F.col("object"))
    named = sites.where("name = 'create'").select("file", F.coalesce(F.when(F.col("p4") == "=", F.col("p5")), F.col("p6")).alias("client")).unionByName(sites.select("file").distinct().withColumn("client", F.lit("axios"))).distinct()
    uses = cut(fetches.unionByName(plain.unionByName(members).join(named, ["file", "client"], "left_semi").select(*fetches.columns)))
    arguments = cut(segments(t, uses.unionByName(creates, allowMissingColumns=True).select("file", F.col("seq").alias("parent"))))
    options = cut(_options(t, arguments))
    clients = http_clients(sites, options)
    d = as_of(uses, clients.select("file", "seq", "name", F.struct("base_url").alias("at")), "client", "at")
    d = d.where((F.col("name") == "fetch") & ~F.col("member") | (F.col("client") == "axios") | F.col("at").isNotNull())
    first = arguments.where("idx = 0").select("file", F.col("parent").alias("seq"), "toks")
    given = options.where("key = 'url' and idx = 0").select("file", F.col("call").alias("seq"), F.col("toks").alias("url_toks"))
    how = options.where("key = 'method'").select("file", F.col("call").alias("seq"), "idx", F.upper("text").alias("option"), F.lit(True).alias("has_option"))
    bare = F.col("client").isNotNull() & ~F.col("member")
    d = d.withColumn("idx", F.when(bare, F.lit(0)).otherwise(F.lit(1)).cast("long")).join(first, ["file", "seq"]).join(given, ["file", "seq"], "left").join(how, ["file", "seq", "idx"], "left")
    object_ = F.get("toks", F.lit(0))["text"] == "{"
    d = d.withColumn("u", resolved_url(F.when(bare & object_, F.col("url_toks")).otherwise(F.col("toks")))).where(~(bare & object_) | F.col("url_toks").isNotNull())
    d = d.where(~bare | object_ | ~F.col("u.is_dynamic"))
    from_option = F.when(F.col("has_option"), F.coalesce("option", F.when(bare, F.lit("GET")).otherwise(F.lit("DYNAMIC"))))
    method = F.when(F.col("client").isNotNull() & F.col("member"), F.upper("name")).otherwise(F.coalesce(from_option, F.lit("GET")))
    lib = F.when(F.col("client").isNull(), "fetch").when(F.col("client") == "axios", "axios").otherwise("axiosInstance")
    base_url = F.when(F.col("client").isNotNull(), F.col("at.base_url"))
    d = d.select("file", "seq", "line", "end_line", lib.alias("lib"), method.alias("method"), (method == "DYNAMIC").alias("method_is_dynamic"), merge_base_url(base_url, F.col("u.url")).alias("url"), base_url.alias("base_url"), "u.static_prefix", "u.is_dynamic")
    d = d.withColumn("normalized_url", normalize_url(F.col("url"))).withColumn("route_match_key", route_match_key(F.col("normalized_url")))
    d = caller_of(d, functions).withColumnRenamed("line", "start_line")
    once = Window.partitionBy("file", "method", "normalized_url", "from", "start_line").orderBy("seq")
    return d.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r", "seq")


def router_names(lines: DataFrame) -> DataFrame:
    """(file, router): the names to start with, and names assigned from x.Router(), x.register() or a call of a known one, until no more are found."""
    made = lines.select("file", F.regexp_extract("bare", rf"({_ID})\s*=\s*(?:await\s+)?((?:{_ID}\.)?{_ID})\s*\(", 1).alias("router"), F.regexp_extract("bare", rf"{_ID}\s*=\s*(?:await\s+)?((?:{_ID}\.)?{_ID})\s*\(", 1).alias("maker")).where("router <> ''")
    known = lines.select("file").distinct().select("file", F.explode(F.array(*map(F.lit, ROUTER_NAMES))).alias("router"))
    known = cut(known.unionByName(made.where(F.col("maker").rlike(r"(^|\.)Router$|\.register$")).select("file", "router")).distinct())
    while True:
        more = made.join(known.select("file", F.col("router").alias("maker")), ["file", "maker"]).select("file", "router").distinct()
        more = cut(more.join(known, ["file", "router"], "left_anti"))
        if more.isEmpty():
            return known
        known = cut(known.unionByName(more))


def extract_routes(files: DataFrame, functions: DataFrame, lines: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(id, file, start_line, router, method, path, raw_path, base_path, handler, middleware, params): verbs on routers below their mount prefixes, and exported verbs of file-convention routes.

    A route may go over lines; its handlers are names, calls (by what is called) or inline.
    """
    lines = cut(source_lines(files)) if lines is None else lines
    t = code_tokens(files) if found is None else found
    sites = _call_sites(t).where(F.col("name").isin(VERBS) & F.col("object").isNotNull()).withColumn("router", F.col("object")).join(router_names(lines), ["file", "router"], "left_semi")
    args = segments(t, sites.select("file", F.col("seq").alias("parent"))).withColumn("u", resolved_url(F.col("toks")))
    head = F.get("toks", F.lit(0))
    dotted = F.array_join(F.transform("toks", lambda x: x["text"]), "")
    called = F.array_join(F.transform(F.slice("toks", 1, F.greatest(F.size("toks") - 2, F.lit(0))), lambda x: x["text"]), "")
    chain = rf"^{_ID}(\.{_ID})*$"
    named = F.when(dotted.rlike(chain) & (head["kind"] == "name"), dotted).when((F.element_at("toks", -1)["text"] == ")") & called.rlike(chain), called).otherwise("inline")
    args = args.groupBy("file", F.col("parent").alias("seq")).agg(F.max(F.when((F.col("idx") == 0) & ~F.col("u.is_dynamic"), F.col("u.url"))).alias("raw_path"), F.transform(F.sort_array(F.collect_list(F.when(F.col("idx") > 0, F.struct("idx", named.alias("a"))))), lambda x: x["a"]).alias("_a"))
    d = cut(sites.withColumnRenamed("name", "verb").join(args, ["file", "seq"]).where("raw_path is not null").select("file", "line", "router", "verb", "raw_path", "_a"))
    mounts = d.where("verb = 'use'").select("file", F.element_at(F.filter("_a", lambda a: a.rlike(rf"^{_ID}$") & (a != "inline")), -1).alias("router"), F.col("raw_path").alias("base_path")).where("router is not null").distinct()
    d = d.join(mounts, ["file", "router"], "left").withColumn("path", join_paths(F.col("base_path"), F.col("raw_path")))
    d = d.withColumn("handler", F.when(F.size("_a") > 0, F.element_at("_a", -1))).withColumn("middleware", F.slice("_a", 1, F.greatest(F.size("_a") - 1, F.lit(0)))).withColumn("method", F.upper("verb"))
    cols = ["file", F.col("line").alias("start_line"), "router", "method", "path", "raw_path", "base_path", "handler", "middleware"]
    exported = functions.where("is_exported and upper(name) in ('GET','POST','PUT','PATCH','DELETE','HEAD','OPTIONS')").where(F.col("file").rlike(r"/(api|app)/|(^|/)route\.[jt]sx?$"))
    folder = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), "file"), r".*/(pages|app)(?=/)", ""), r"/route\.[jt]sx?$", ""), r"\.[jt]sx?$", "")
    by_file = exported.select("file", "start_line", F.lit("files").alias("router"), F.upper("name").alias("method"), normalize_path(folder).alias("path"), folder.alias("raw_path"), F.lit(None).cast("string").alias("base_path"), F.col("name").alias("handler"), F.array().cast("array<string>").alias("middleware"))
    out = d.select(*cols).unionByName(by_file)
    return out.withColumn("id", F.concat_ws("::", "file", "method", "path")).withColumn("params", path_params(F.col("path")))


def extract_events(files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(file, start_line, pos, event, element, handler, calls_inside, is_dynamic, is_conditional): JSX on* attributes on one line."""
    lines = cut(source_lines(files)) if lines is None else lines
    attribute = r"<([A-Za-z][\w.]*)[^<]*?\s(on[A-Z]\w*)=\{((?:[^{}]|\{[^{}]*\})*)\}"
    found = F.regexp_extract_all("code", F.lit(attribute), F.lit(0))
    d = lines.select("file", F.col("line").alias("start_line"), F.posexplode(found).alias("pos", "_x"))
    part = lambda i: F.regexp_extract("_x", attribute, i)
    d = d.select("file", "start_line", "pos", part(1).alias("element"), part(2).alias("event"), F.trim(part(3)).alias("e"))
    inner = F.filter(F.regexp_extract_all("e", F.lit(rf"({_ID}(?:\.{_ID})*)\s*\("), F.lit(1)), lambda c: ~c.isin(KEYWORDS))
    inner = F.transform(inner, lambda c: F.element_at(F.split(c, r"\."), -1))
    arrow, plain, either = F.col("e").rlike(r"=>|\bfunction\b"), F.col("e").rlike(rf"^{_ID}(\.{_ID})?$"), rf"^[^?]+\?\s*((?:{_ID}\.)*({_ID}))\s*:\s*((?:{_ID}\.)*({_ID}))$"
    both = F.array(F.regexp_extract("e", either, 2), F.regexp_extract("e", either, 4))
    computed, conditional = F.col("e").rlike(rf"^{_ID}\[.*\]$"), F.col("e").rlike(either)
    calls = F.when(arrow, inner).when(conditional, both).otherwise(F.array().cast("array<string>"))
    handler = F.when(plain, F.col("e")).when(computed, "dynamic").when(arrow & (F.size(inner) == 1), F.get(inner, F.lit(0))).when(arrow & (F.size(inner) > 1), "inline").when(conditional, "conditional")
    return d.select("file", "start_line", "pos", "event", "element", handler.alias("handler"), calls.alias("calls_inside"), computed.alias("is_dynamic"), conditional.alias("is_conditional"))


#: The extractors by category; each takes (files, functions, lines, tokens). More can be added.
EXTRACTORS = {
    "functions": lambda files, functions, lines, found: functions,
    "imports": lambda files, functions, lines, found: extract_imports(files, lines),
    "exports": lambda files, functions, lines, found: extract_exports(files, found),
    "calls": extract_calls,
    "api_calls": extract_api_calls,
    "routes": extract_routes,
    "ui_events": lambda files, functions, lines, found: extract_events(files, lines),
}


def extract_all(files: DataFrame) -> dict[str, DataFrame]:
    """The fact tables of a source tree by category; lines, tokens and functions are found once for all."""
    lines, found = cut(source_lines(files)), code_tokens(files)
    functions = cut(extract_functions(files, lines, found))
    return {name: run(files, functions, lines, found) for name, run in EXTRACTORS.items()}


def per_file(extract_file: Callable[[str, str], Iterable[tuple]], schema: str) -> Callable[..., DataFrame]:
    """An extractor of a function from (path, content) to rows of schema, which has no column file or error.

    It gives (file, schema, error): a file at which the function fails gives one row with the error and no others.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    found = [(path, *r, None) for r in extract_file(path, content or "")]
                except Exception as e:
                    found = [(path, *[None] * len(names), f"{type(e).__name__}: {e}"[:500])]
                yield pd.DataFrame(found, columns=["file", *names, "error"])

    return lambda files, functions, lines, found: files.select("path", "content").mapInPandas(rows, f"file string, {schema}, error string")


def extract_alone(files: DataFrame, extractors: dict[str, Callable[..., DataFrame]] | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables, errors(file, error)) by extractor: one that fails, as a whole (a null file) or at a file, leaves the others alone."""
    lines, found = cut(source_lines(files)), code_tokens(files)
    functions = cut(extract_functions(files, lines, found))
    tables, errors = {}, {}
    for name, run in (EXTRACTORS if extractors is None else extractors).items():
        try:
            d = run(files, functions, lines, found)
        except Exception as e:
            errors[name] = files.sparkSession.createDataFrame([(None, f"{type(e).__name__}: {e}"[:500])], "file string, error string")
            continue
        if "error" in d.columns:
            d = cut(d)
            errors[name], d = d.where("error is not null").select("file", "error"), d.where("error is null").drop("error")
        tables[name] = d
    return tables, errors


def extractor_counts(tables: dict[str, DataFrame], errors: dict[str, DataFrame] | None = None) -> DataFrame:
    """(extractor, rows, errors): how many rows each gave, and how many errors; one that gave no table has 0 rows."""
    out = None
    for name in [*tables, *(n for n in errors or {} if n not in tables)]:
        bad = (errors or {}).get(name)
        d = tables[name] if name in tables else bad.limit(0)
        one = d.agg(F.count("*").alias("rows")).select(F.lit(name).alias("extractor"), "rows")
        one = one.join(F.broadcast(bad.agg(F.count("*").alias("errors")))) if bad is not None else one.withColumn("errors", F.lit(0).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out
