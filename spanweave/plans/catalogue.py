"""Every query of the library on the driver's tables, and its SQL.

The tables hold no source code, so each query gives a table a role: events are spans, page paths are routes and
calls, parts are functions, parts that follow each other in an order call each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.functions import scalars as S
from spanweave.functions.answers import answer_parts
from spanweave.operators import facts, graph, linker, pointers, resolve, spans, stats, sweep, trace
from spanweave.plans.incremental import refresh
from spanweave.session import table, tasks_of
from spanweave.sources.extract import as_of
from spanweave.sources.files import covering, line_slice, lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Roles.


def _spans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id", "ts", F.col("user_id").cast("string").alias("trace_id"), F.col("event_type").alias("name"), F.lit("get").alias("method"), F.concat(F.lit("/"), "event_type").alias("route"),
        F.col("value").alias("duration_ms"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.get_json_object("props", "$.k").alias("k"),
    )


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", S.url_path(F.col("url")).alias("path"))


def _template(path: F.Column) -> F.Column:
    return F.regexp_replace(path, "/[0-9]+", "/:id")


def _routes(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d).select("page_id", _template(F.col("path")).alias("path"), F.when(F.col("page_id") % 7 == 0, "ANY").otherwise("GET").alias("method"))
    return facts.first_wins(p, ["path", "method"], ["page_id"]).select(F.concat_ws("::", "method", "path").alias("route_id"), "method", "path", F.col("page_id").alias("ord"))


_ROUTES_SQL = r"""
p AS (SELECT page_id, url, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) END AS path FROM pages),
t AS (SELECT page_id, regexp_replace(path, '/[0-9]+', '/:id', 'g') AS path, CASE WHEN page_id % 7 = 0 THEN 'ANY' ELSE 'GET' END AS method FROM p),
r AS (SELECT method || '::' || path AS route_id, method, path, min(page_id) AS ord FROM t GROUP BY method, path)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    nxt = F.lead("src").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "src"))
    return x.withColumn("dst", nxt).where("dst is not null").select("src", "dst").distinct()


_EDGES_SQL = "e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"


def _root(spark: SparkSession, node: int = 1) -> DataFrame:
    return spark.createDataFrame([(node,)], "root long")


def _functions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws(".", F.split("p_type", " ")[0], "p_brand").alias("name"), F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/"), F.col("p_size").cast("string"), F.lit(".js")).alias("file"), F.lit(0).alias("file_ord"), F.col("p_partkey").alias("row_ord"))


_FUNCTIONS_SQL = "f AS (SELECT p_partkey AS id, string_split(p_type, ' ')[1] || '.' || p_brand AS name, 'src/' || lower(p_brand) || '/' || p_size || '.js' AS file, p_partkey AS row_ord FROM part)"


# Spans and telemetry.


@query("""SELECT *, CASE WHEN average_ms > 1000 THEN 'CRITICAL' WHEN average_ms > 500 THEN 'WARNING' ELSE 'HEALTHY' END AS status
FROM (SELECT 'GET:/' || event_type AS metric_key, count(*) AS hits, sum(round(value * 1000)::BIGINT)::BIGINT / count(*) / 1000 AS average_ms,
             arg_max(value, (ts, event_id)) AS last_ms, arg_max(user_id, (ts, event_id))::VARCHAR AS latest_trace FROM events GROUP BY event_type)""")
def route_metrics(spark, d):
    return spans.route_metrics(_spans(spark, d), ["ts", "event_id"])


@query("""SELECT event_id, event_type AS name, count(*) OVER w AS hits, (sum(round(value * 100)::BIGINT) OVER w)::BIGINT / count(*) OVER w AS mean_cents
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_route_metrics(spark, d):
    return spans.running_metrics(_spans(spark, d), "name", "duration_ms", ["ts", "event_id"]).select("event_id", "name", "hits", "mean_cents")


@query("""SELECT user_id::VARCHAR AS trace_id, coalesce(arg_min(event_type, (ts, event_id)) FILTER (WHERE event_id % 5 = 0), arg_min(event_type, (ts, event_id))) AS name,
coalesce(arg_min(epoch_us(ts), (ts, event_id)) FILTER (WHERE event_id % 5 = 0), arg_min(epoch_us(ts), (ts, event_id))) AS start, count(*) AS span_count FROM events GROUP BY user_id""")
def trace_summary(spark, d):
    s = _spans(spark, d).withColumn("parent_span_id", F.when(F.col("event_id") % 5 != 0, "p")).withColumn("start", F.unix_micros(F.col("ts").cast("timestamp")))
    return spans.trace_summaries(s, ["ts", "event_id"])


@query("SELECT event_id, ts::DATE::VARCHAR AS day, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY ts::DATE)) / 1000 AS offset_ms FROM events")
def waterfall_offsets(spark, d):
    s = _spans(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return spans.waterfall(s, "day", "us", 1000).select("event_id", "day", "offset_ms")


@query("""SELECT event_id, offset_ms + 100 * (row_number() OVER (PARTITION BY day ORDER BY offset_ms, event_id) - 1) AS delay_ms
FROM (SELECT event_id, ts::DATE::VARCHAR AS day, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY ts::DATE)) / 1000 AS offset_ms FROM events)""")
def pulse_schedule(spark, d):
    s = _spans(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return spans.pulse_delays(spans.waterfall(s, "day", "us", 1000), "day", ["event_id"]).select("event_id", "delay_ms")


@query("""WITH f AS (SELECT user_id, min((ts, event_id)) AS first FROM events GROUP BY user_id), k AS (SELECT user_id FROM f ORDER BY first DESC LIMIT 100)
SELECT event_id, user_id::VARCHAR AS trace_id FROM events JOIN k USING (user_id)""")
def trace_fifo_cap(spark, d):
    return spans.keep_latest_traces(_spans(spark, d), ["ts", "event_id"], 100).select("event_id", "trace_id")


@query("""SELECT ts::DATE::VARCHAR AS day, arg_min(user_id, (ts, event_id))::VARCHAR AS trace_id, arg_min(CASE WHEN k % 2 = 0 THEN event_type ELSE 'get /' || event_type END, (ts, event_id)) AS root_name,
arg_min(k % 2 <> 0, (ts, event_id)) AS is_route FROM (SELECT *, (props->>'k')::INT AS k FROM events) WHERE event_type <> 'click' GROUP BY 1""")
def root_candidate(spark, d):
    even = F.col("k").cast("int") % 2 == 0
    s = _spans(spark, d).where("name <> 'click'").withColumns({"file": F.when(even, F.lit("a.js")), "line": F.when(even, F.lit("3")), "function": F.lit(None).cast("string")})
    return spans.root_candidates(s, "day", ["ts", "event_id"]).select("day", "trace_id", "root_name", "is_route")


@query("SELECT event_id, props->>'k' AS k FROM events")
def attr_fold(spark, d):
    pair = lambda v: F.struct(F.lit("k").alias("key"), F.struct(v.alias("stringValue"), F.lit(None).cast("string").alias("intValue"), F.lit(None).cast("boolean").alias("boolValue")).alias("value"))
    s = _spans(spark, d).withColumn("attributes", F.array(pair(F.lit("0")), pair(F.col("k"))))
    return s.select("event_id", spans.attributes_map(F.col("attributes"))["k"].alias("k"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN event_id::VARCHAR ELSE event_type || ':' || (props->>'k') END AS live_id FROM events")
def live_node_id(spark, d):
    return _spans(spark, d).select("event_id", S.live_node_id(F.when(F.col("name") != "view", F.col("name")), F.col("k"), F.col("event_id").cast("string")).alias("live_id"))


# Scalars.


@query(f"""WITH {_ROUTES_SQL}
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'route' WHEN 1 THEN 'event' ELSE 'function' END AS type, CASE WHEN page_id % 3 = 0 THEN 'GET' END AS method,
CASE WHEN page_id % 3 = 0 THEN path END AS path, CASE WHEN page_id % 3 = 1 THEN 'onClick' END AS event, CASE WHEN page_id % 3 = 1 THEN 'b' || page_id END AS element, CASE WHEN page_id % 3 = 2 THEN 'fn' || page_id END AS name FROM p""")
def entry_classify(spark, d):
    i = F.col("page_id")
    text = F.when(i % 3 == 0, F.concat(F.lit(" get  "), "path")).when(i % 3 == 1, F.concat(F.lit("onClick:b"), i)).otherwise(F.concat(F.lit("fn"), i))
    return _paths(spark, d).select("page_id", S.classify_entry(text).alias("e")).select("page_id", "e.*")


@query(f"""WITH {_ROUTES_SQL}
SELECT page_id, regexp_replace(regexp_replace(lower(trim(url || '//')), '/+$', ''), '/{{2,}}', '/', 'g') AS normalized,
regexp_replace(regexp_replace(regexp_replace(lower(trim(path)), '/+$', ''), '/{{2,}}', '/', 'g'), '/[0-9]+', '/:param', 'g') AS match_key FROM p""")
def url_normalize(spark, d):
    key = S.route_match_key(F.coalesce(S.normalize_url(_template(F.col("path"))), F.lit("")))
    return _paths(spark, d).select("page_id", S.normalize_url(F.concat("url", F.lit("//"))).alias("normalized"), F.coalesce(key, F.lit("")).alias("match_key"))


@query(f"""WITH {_ROUTES_SQL}, s AS (SELECT page_id, i, string_split(path, '/')[i] AS seg FROM t, unnest(range(1, len(string_split(path, '/')) + 1)) AS u(i))
SELECT page_id, seg[2:] AS name, seg AS segment, (i - 1)::INT AS segment_index FROM s WHERE starts_with(seg, ':')""")
def route_params(spark, d):
    return _paths(spark, d).select("page_id", F.inline(S.path_params(_template(F.col("path")))))


@query(f"WITH {_ROUTES_SQL} SELECT page_id, path, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM p")
def url_path_host(spark, d):
    return _paths(spark, d).select("page_id", "path", S.url_host(F.col("url")).alias("host"))


@query(f"""WITH {_ROUTES_SQL} SELECT page_id, CASE WHEN regexp_matches(lower(path), 'frontend|client|ui|pages|components|views|\\.jsx$') THEN 'frontend' ELSE 'backend' END AS layer FROM p""")
def layer_classify(spark, d):
    return _paths(spark, d).select("page_id", S.layer(F.col("path")).alias("layer"))


@query("SELECT doc_id, substr(sha1(source || '::' || lang || '::' || doc_id || '::' || n_chars), 1, 12) AS content_hash, source || '::' || substr(text, 1, 200) AS cache_key FROM documents")
def content_hash(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", S.content_hash(F.col("source"), F.col("lang"), F.col("doc_id"), F.col("n_chars")).alias("content_hash"), S.cache_key(F.col("source"), F.col("text")).alias("cache_key"))


@query("""SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines,
CASE WHEN len(string_split(text, chr(10))) >= 2 THEN array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) END AS code FROM documents""")
def code_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(lines(F.col("text"))).alias("n_lines"), line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("code"))


_REPO_SQL = """raws AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.github.com' || path || '?x#y' WHEN 1 THEN 'git@github.com:' || substr(path, 2) || '.git' WHEN 2 THEN url ELSE 'github.com' || path END AS raw,
 list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
named AS (SELECT page_id, raw, parts[1] || CASE WHEN page_id % 4 = 1 AND len(parts) = 1 THEN '.git' ELSE '' END AS owner, regexp_replace(parts[2], '[.]git$', '', 'i') AS repo FROM raws),
judged AS (SELECT *, page_id % 4 <> 2 AND regexp_matches(owner, '^[A-Za-z0-9_.-]+$') AND regexp_matches(repo, '^[A-Za-z0-9_.-]+$') AS good FROM named)"""


@query(f"WITH {_ROUTES_SQL}, {_REPO_SQL} SELECT page_id, raw, CASE WHEN good THEN owner END AS owner, CASE WHEN good THEN repo END AS repo FROM judged")
def repo_url_parse(spark, d):
    """Pages' paths as repositories in the ways that a repository is written, every fourth on another host."""
    n, path = F.col("page_id") % 4, F.col("path")
    raw = F.when(n == 0, F.concat(F.lit("https://www.github.com"), path, F.lit("?x#y"))).when(n == 1, F.concat(F.lit("git@github.com:"), F.expr("substring(path, 2)"), F.lit(".git"))).when(n == 2, F.col("url")).otherwise(F.concat(F.lit("github.com"), path))
    return _paths(spark, d).withColumn("raw", raw).withColumn("r", S.parse_repo_url(F.col("raw"))).select("page_id", "raw", "r.owner", "r.repo")


# Places in code: a user's events in the order of their ids are a file's lines.


_PLACES_SQL = "f AS (SELECT user_id, event_id AS a, event_id + 40 + event_id % 700 AS z FROM events WHERE event_type = 'purchase')"


def _places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("file"), F.col("event_id").alias("line")), e.where("event_type = 'purchase'").select(F.col("user_id").alias("file"), F.col("event_id").alias("start_line"), (F.col("event_id") + 40 + F.col("event_id") % 700).alias("end_line"))


@query(f"WITH {_PLACES_SQL} SELECT e.user_id AS file, event_id AS line, max(a)::BIGINT AS start_line FROM events e LEFT JOIN f ON e.user_id = f.user_id AND event_id BETWEEN a AND z GROUP BY ALL")
def innermost_interval(spark, d):
    points, intervals = _places(spark, d)
    return sweep.stab(points, intervals, "file", "line", "start_line", "end_line", F.lit(None)).select("file", "line", F.col("hit_start").alias("start_line"))


@query(f"WITH {_PLACES_SQL} SELECT e.user_id AS file, event_id AS line, min(a)::INT AS start_line, arg_min(z, a)::INT AS end_line FROM events e LEFT JOIN f ON e.user_id = f.user_id AND event_id BETWEEN a AND z GROUP BY ALL")
def covering_element(spark, d):
    points, intervals = _places(spark, d)
    return covering(intervals, points)


@query("""SELECT c.event_id, p.event_id AS definition FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.event_id > p.event_id""")
def last_definition(spark, d):
    """The last assignment before each use of a name."""
    e = table(spark, d, "events").select(F.lit("one").alias("file"), F.col("event_id").alias("seq"), F.col("user_id").alias("name"), F.col("event_id").alias("definition"), "event_type")
    uses, definitions = e.where("event_type = 'click'").select("file", "seq", "name"), e.where("event_type = 'purchase'").select("file", "seq", "name", "definition")
    return as_of(uses, definitions, "name", "definition").select(F.col("seq").alias("event_id"), "definition")


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), c AS (SELECT c_custkey, CASE WHEN c_acctbal > 8000 THEN NULL ELSE c_custkey * 31 % n + 1 END AS next FROM customer, n),
w(src, here) AS (SELECT c_custkey, c_custkey FROM c UNION SELECT src, next FROM w JOIN c ON here = c_custkey WHERE next IS NOT NULL)
SELECT c.c_custkey AS node, t.here AS target FROM c LEFT JOIN (SELECT src, here FROM w JOIN c ON here = c_custkey WHERE next IS NULL) t ON t.src = c.c_custkey""")
def alias_targets(spark, d):
    """Chains of aliases, some in circles: a customer stands for another one until one has enough on their account."""
    c = table(spark, d, "customer")
    n = F.broadcast(c.agg(F.count("*").alias("n")))
    end = F.col("c_acctbal") > 8000
    chain = c.join(n).select(F.col("c_custkey").alias("node"), F.when(~end, F.col("c_custkey") * 31 % F.col("n") + 1).alias("next"), F.when(end, F.col("c_custkey")).alias("target"))
    return pointers.follow(chain)


# Facts.


@query("""SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_collector(spark, d):
    return facts.first_wins(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source", "n_chars"], ["doc_id"])


@query("SELECT event_id, 'missing k' AS reason FROM events WHERE event_type = 'click'")
def schema_errors(spark, d):
    s = _spans(spark, d).withColumn("k", F.when(F.col("name") != "click", F.col("k")))
    return facts.split_valid(s, ["name", "k"])[1].select("event_id", "reason")


@query(f"WITH {_ROUTES_SQL} SELECT path, min(page_id) AS page_id FROM t GROUP BY path")
def route_index_first_wins(spark, d):
    return facts.first_wins(_paths(spark, d).select(_template(F.col("path")).alias("path"), "page_id"), ["path"], ["page_id"])


@query(f"WITH {_ROUTES_SQL} SELECT path, page_id, rn::INT AS rn FROM (SELECT path, page_id, row_number() OVER (PARTITION BY path ORDER BY page_id) AS rn FROM t) WHERE rn > 1")
def route_duplicates(spark, d):
    return facts.later_rows(_paths(spark, d).select(_template(F.col("path")).alias("path"), "page_id"), ["path"], ["page_id"])


@query("SELECT conv_id AS key, array_to_string(list(role ORDER BY turn), ',') AS turns FROM conversations GROUP BY conv_id")
def grouped_in_order(spark, d):
    g = facts.grouped(table(spark, d, "conversations"), "conv_id", "role", ["turn"])
    return g.select(F.col("conv_id").alias("key"), F.array_join(F.col("values").cast("array<string>"), ",").alias("turns"))


@query("SELECT source AS file, lang AS category, count(*) AS n FROM documents GROUP BY source, lang")
def fact_summary(spark, d):
    doc = table(spark, d, "documents").withColumnRenamed("source", "file")
    return facts.summary({k: doc.where(F.col("lang") == k) for k in ("en", "fr", "de", "es")})


# Resolution.


_BEST_SQL = """m AS (SELECT q.name, caller, id, row_ord, CASE WHEN n = 1 THEN 0 WHEN file = caller THEN 1 WHEN ends_with(file, caller) OR ends_with(caller, file) OR split_part(file, '/', 2) || '/' || split_part(file, '/', 3) = split_part(caller, '/', 2) || '/' || split_part(caller, '/', 3) THEN 2
  WHEN split_part(file, '/', 2) = split_part(caller, '/', 2) THEN 3 ELSE 4 END AS rank FROM q JOIN (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM f) USING (name)
  UNION ALL SELECT q.name, caller, id, row_ord, CASE WHEN n = 1 THEN 5 WHEN file = caller THEN 6 ELSE 7 END FROM q JOIN (SELECT id, file, row_ord, string_split(name, '.')[2] AS name, count(*) OVER (PARTITION BY string_split(name, '.')[2]) AS n FROM f) s USING (name)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, caller ORDER BY rank, row_ord) AS k FROM m) WHERE k = 1)"""


@query(f"""WITH {_FUNCTIONS_SQL}, a AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ref_id, (CASE l_linenumber % 2 WHEN 0 THEN string_split(p_type, ' ')[1] || '.' ELSE '' END) || p_brand AS name,
  'src/' || lower(p_brand) || '/' || (p_size + l_linenumber % 3) || '.js' AS caller FROM lineitem JOIN part ON l_partkey = p_partkey), q AS (SELECT DISTINCT name, caller FROM a), {_BEST_SQL}
SELECT ref_id, b.id AS function_id, b.rank::INT AS rank FROM a LEFT JOIN best b USING (name, caller)""")
def resolve_ranked(spark, d):
    return resolve.resolve_functions(_references(spark, d), _functions(spark, d)).select("ref_id", "function_id", "rank")


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Order lines are made distinct by their keys, before they have texts, and each distinct part has one row for even and one for odd lines."""
    lines = table(spark, d, "lineitem")
    tasks, keys = tasks_of(lines), ["l_orderkey", "l_linenumber", "l_partkey"]
    lines = lines.select(*keys).where("l_partkey is not null").repartition(tasks, "l_partkey").distinct().withColumn("even", F.coalesce(F.col("l_linenumber") % 2 == 0, F.lit(False)))
    names = F.explode(F.array(F.struct(F.lit(True).alias("of_even"), F.concat(F.split("p_type", " ")[0], F.lit("."), "p_brand").alias("name")), F.struct(F.lit(False).alias("of_even"), F.col("p_brand").alias("name"))))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size", names.alias("x")).select("l_partkey", "x.of_even", "x.name", "p_brand", "p_size").repartition(tasks, "l_partkey").distinct()
    caller = F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/"), (F.col("p_size") + F.col("l_linenumber") % 3).cast("string"), F.lit(".js"))
    # The join is by the part alone, so that both sides stay where they are.
    return lines.join(parts.hint("shuffle_hash"), "l_partkey").where(F.when(F.col("even"), F.col("of_even")).otherwise(~F.col("of_even"))).select(F.concat_ws("-", *keys).alias("ref_id"), "name", caller.alias("caller_file"))


@query(SQL["resolve_ranked"])
def resolve_refreshed(spark, d):
    """What was resolved without the files of size 7, renewed when they come: as if all were resolved at once."""
    refs, functions = _references(spark, d), _functions(spark, d)
    added = F.col("file").endswith("/7.js")
    old = functions.where(~added)
    changed = functions.where(added).select("file").distinct()
    return refresh(resolve.resolve_functions(refs, old), refs, old, functions, changed, tasks_of(table(spark, d, "lineitem"))).select("ref_id", "function_id", "rank")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25")
def known_function_semi(spark, d):
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), "l_partkey").alias("name"))
    known = table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("m.p"), "p_partkey").alias("name"))
    return resolve.known_names(refs, known).select("l_orderkey", "l_linenumber")


@query(f"""WITH {_ROUTES_SQL},
m AS (SELECT page_id, route_id, ord, CASE WHEN r.method = 'GET' THEN 0 ELSE 1 END AS rank, 0 AS level FROM p JOIN r ON p.path = r.path
  UNION ALL SELECT page_id, route_id, ord, 2, 0 FROM p JOIN r ON contains(r.path, ':') AND regexp_matches(p.path, '^' || regexp_replace(r.path, ':[^/ ]+', '([^/]+)', 'g') || '$')
  UNION ALL SELECT page_id, route_id, ord, 3, i FROM (SELECT page_id, i - 1 AS i, '/' || array_to_string(s[i:], '/') AS trial FROM (SELECT page_id, list_filter(string_split(path, '/'), lambda y: y <> '') AS s FROM p), unnest(range(1, len(s) + 1)) AS u(i)) x JOIN r ON x.trial = r.path)
SELECT p.page_id AS call_id, b.route_id, b.rank::INT AS rank FROM p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank, level, ord) AS k FROM m) b ON p.page_id = b.page_id AND b.k = 1""")
def route_match_ranked(spark, d):
    calls = _paths(spark, d).select(F.col("page_id").alias("call_id"), F.lit("GET").alias("method"), "url")
    return resolve.match_routes(calls, _routes(spark, d)).select("call_id", "route_id", "rank")


@query(f"""WITH {_ROUTES_SQL}, k AS (SELECT DISTINCT path FROM t WHERE page_id % 2 = 0) SELECT page_id FROM p WHERE page_id % 2 = 1 AND path NOT IN (SELECT path FROM k)""")
def api_unresolved(spark, d):
    p = _paths(spark, d)
    return resolve.unmatched(p.where("page_id % 2 = 1"), p.where("page_id % 2 = 0").select(_template(F.col("path")).alias("path")), "path").select("page_id")


@query(f"""WITH {_ROUTES_SQL}, l AS (SELECT page_id, i, '/' || array_to_string(s[i:], '/') AS key FROM (SELECT page_id, list_filter(string_split('/api' || path, '/'), lambda y: y <> '') AS s FROM t), unnest(range(1, len(s) + 1)) AS u(i)),
h AS (SELECT page_id, i, route_id, r.method, min(i) OVER (PARTITION BY page_id) AS first FROM l JOIN r ON l.key = r.path) SELECT DISTINCT page_id AS call_id, route_id FROM h WHERE i = first AND method = 'GET'""")
def link_api_calls(spark, d):
    calls = _paths(spark, d).select(F.col("page_id").alias("call_id"), F.lit("get").alias("method"), F.concat(F.lit("/api"), _template(F.col("path"))).alias("key"))
    return resolve.link_api_calls(calls, _routes(spark, d).withColumnRenamed("path", "key"))


@query("""SELECT metric_key, coalesce(hits, 0) AS hits FROM (SELECT 'GET:/' || x AS metric_key, x FROM (VALUES ('click'), ('view'), ('none')) AS t(x)) LEFT JOIN (SELECT event_type AS x, count(*) AS hits FROM events GROUP BY 1) USING (x)""")
def metrics_join(spark, d):
    routes = spark.createDataFrame([("get", f"/{x}") for x in ("click", "view", "none")], "method string, path string")
    return resolve.attach_metrics(routes, spans.route_metrics(_spans(spark, d), ["ts", "event_id"])).select("metric_key", F.coalesce("hits", F.lit(0)).alias("hits"))


@query(f"""WITH {_FUNCTIONS_SQL}, x AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem),
c AS (SELECT DISTINCT a.name AS caller_name, string_split(b.name, '.')[2] AS callee_name, a.file AS caller FROM x JOIN f a ON x.a = a.id JOIN f b ON x.b = b.id),
q AS (SELECT caller_name AS name, caller FROM c UNION SELECT callee_name, caller FROM c), {_BEST_SQL}
SELECT DISTINCT s.id AS caller_id, t.id AS callee_id FROM c JOIN best s ON s.name = c.caller_name AND s.caller = c.caller JOIN best t ON t.name = c.callee_name AND t.caller = c.caller""")
def call_edges(spark, d):
    f, lines = _functions(spark, d), table(spark, d, "lineitem")
    x = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a")).repartition(tasks_of(lines), "l_orderkey")
    x = x.withColumn("b", F.lead("a").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "a"))).where("b is not null")
    ends = [f.select(F.col("id").alias(k), F.col("name").alias(f"{k}_name"), F.col("file").alias(f"{k}_file")) for k in ("a", "b")]
    c = x.join(ends[0], "a").join(ends[1], "b")
    calls = c.select(F.col("a_name").alias("from"), F.element_at(F.split("b_name", r"\."), -1).alias("name"), F.col("a_file").alias("file")).distinct()
    return resolve.call_edges(calls.withColumn("call_id", F.concat_ws("|", "from", "name", "file")), f)


@query("""SELECT event_id, event_type AS name, (event_type NOT IN ('map', 'click')) AND event_type IN ('view', 'purchase') AS relevant FROM events""")
def relevance_gate(spark, d):
    s = _spans(spark, d).withColumn("call", F.when(F.col("name") == "click", "map").otherwise(F.col("name")))
    return s.select("event_id", "name", resolve.relevant(F.col("call"), F.lit(None).cast("string"), F.col("name").isin("view", "purchase", "click")).alias("relevant"))


@query("SELECT event_id FROM events WHERE event_type = 'view' OR event_type NOT IN ('click')")
def flow_filter(spark, d):
    s = _spans(spark, d).withColumn("type", F.when(F.col("name") == "view", "api").otherwise("function")).withColumn("label", F.when(F.col("name").isin("click", "view"), "list.map()").otherwise(F.col("name")))
    return resolve.filter_flow(s).select("event_id")


@query("SELECT DISTINCT a.conv_id AS function_id, b.conv_id || '-' || b.turn AS event_id FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn = 0 AND b.role = 'user'")
def event_handler_join(spark, d):
    c = table(spark, d, "conversations")
    functions = c.where("turn = 0").select(F.col("conv_id").alias("id"), F.col("conv_id").alias("file"), F.lit("user").alias("name"))
    events = c.select(F.concat_ws("-", "conv_id", "turn").alias("event_id"), F.col("conv_id").alias("file"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("handler"), F.array(F.col("role"), F.lit("other")).alias("calls_inside"))
    return resolve.events_of(functions, events)


@query("""WITH n AS (SELECT event_type || ':' || k AS live_id, min(event_id) AS node FROM (SELECT *, props->>'k' AS k FROM events WHERE event_id % 3 = 0) GROUP BY 1),
r AS (SELECT 'GET:/' || event_type AS live_id, min(event_id) + 1000000 AS node FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT event_id AS pulse_id, coalesce(n.node, r.node, -1) AS node FROM (SELECT *, event_type || ':' || (props->>'k') AS a, 'GET:/' || event_type AS b FROM events) e LEFT JOIN n ON e.a = n.live_id LEFT JOIN r ON e.b = r.live_id""")
def pulse_node_join(spark, d):
    s = _spans(spark, d).withColumn("node_id", F.concat_ws(":", "name", "k")).withColumnRenamed("event_id", "pulse_id")
    by_id = s.where("pulse_id % 3 = 0").groupBy(F.col("node_id").alias("live_id")).agg(F.min("pulse_id").alias("node"))
    by_route = s.where("name in ('view', 'click')").groupBy(F.concat(F.lit("GET:"), "route").alias("live_id")).agg((F.min("pulse_id") + 1000000).alias("node"))
    return resolve.pulses_on_nodes(s, by_id.unionByName(by_route)).select("pulse_id", F.coalesce("node", F.lit(-1)).alias("node"))


@query("SELECT source || ':' || lang AS key, source AS file, min(n_chars) AS line FROM documents GROUP BY source, lang")
def ast_map(spark, d):
    doc = table(spark, d, "documents")
    return facts.ast_map(doc.select(F.col("source").alias("file"), F.col("lang").alias("name"), F.col("n_chars").alias("start_line")))


@query("SELECT 'files' AS what, count(*) AS n FROM documents UNION ALL SELECT 'functions', count(*) FROM part UNION ALL SELECT 'routes', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")
def index_summary(spark, d):
    return facts.index_summary(*[table(spark, d, t) for t in ("documents", "part", "pages", "events")])


# Graphs.

_REACH = "g AS (SELECT DISTINCT 1::BIGINT AS node, 0 AS depth UNION SELECT e.{dst}, depth + 1 FROM g JOIN e ON g.node = e.{src} WHERE depth < {n}), m AS (SELECT node, min(depth) AS depth FROM g GROUP BY node)"


_STEP = "g{i} AS (SELECT node, min(depth) AS depth FROM (SELECT node, depth FROM g{j} UNION ALL SELECT e.{dst}, depth + 1 FROM g{j} JOIN e ON g{j}.node = e.{src} WHERE depth = {j}) GROUP BY node)"


def _levels_sql(src: str, dst: str, n: int) -> str:
    """A frontier a level: each node once, at its smallest distance from node 1."""
    return ", ".join(["g0 AS (SELECT 1::BIGINT AS node, 0 AS depth)", *[_STEP.format(i=i, j=i - 1, src=src, dst=dst) for i in range(1, n + 1)]])


@query(f"WITH {_EDGES_SQL}, {_levels_sql('src', 'dst', 8)} SELECT node, depth FROM g8")
def trace_forward_set(spark, d):
    return graph.trace_forward(_edges(spark, d), _root(spark), 8)[0].select("node", "depth")


@query(f"WITH {_EDGES_SQL}, {_levels_sql('dst', 'src', 4)} SELECT e.src, e.dst FROM e JOIN g4 m ON e.dst = m.node WHERE depth < 4 AND src <> dst")
def trace_backward_bfs(spark, d):
    return graph.trace_backward(_edges(spark, d), _root(spark), 4)[1].select("src", "dst")


@query(f"WITH RECURSIVE {_EDGES_SQL}, {_REACH.format(src='src', dst='dst', n=2)} SELECT e.src, e.dst FROM e WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)")
def reachable_subgraph(spark, d):
    e = _edges(spark, d)
    return graph.induced(graph.reach(e, _root(spark), 2), e).select("src", "dst")


def _small_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(_edges(spark, d), _root(spark), 2).select("node", F.col("depth").alias("level"))


@query("""WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), s AS (SELECT s_suppkey FROM supplier JOIN n ON s_nationkey = n_nationkey), m AS (SELECT count(*) AS n FROM supplier)
SELECT 'r1' AS node, 0 AS level UNION ALL SELECT 'n' || n_nationkey, 1 FROM n UNION ALL SELECT 's' || s_suppkey, 2 FROM s
UNION ALL SELECT 'c' || c_custkey, 3 FROM customer, m WHERE c_custkey % n + 1 IN (SELECT s_suppkey FROM s)""")
def graph_levels(spark, d):
    key = lambda p, c: F.concat(F.lit(p), c)
    suppliers = table(spark, d, "supplier")
    n = suppliers.agg(F.count("*").alias("n"))
    down = table(spark, d, "nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    # Nothing leads from the root to these two kinds; they lead into it.
    into = suppliers.select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"))
    further = table(spark, d, "customer").join(F.broadcast(n)).select(key("c", "c_custkey").alias("src"), key("s", F.col("c_custkey") % F.col("n") + 1).alias("dst"))
    return graph.levels(down.unionByName(into).unionByName(further), spark.createDataFrame([("r1",)], "root string"))


@query(f"""WITH RECURSIVE {_EDGES_SQL}, {_REACH.format(src='src', dst='dst', n=2)}, r AS (SELECT depth, count(*) AS n FROM m GROUP BY depth), w AS (SELECT max(n * 260 - 40) AS widest, max(depth) AS deepest FROM r)
SELECT node, depth AS level, (widest - (n * 260 - 40)) / 2 + (row_number() OVER (PARTITION BY depth ORDER BY node) - 1) * 260 AS x, (depth * 142)::BIGINT AS y, greatest(800, widest + 112)::BIGINT AS width, ((deepest + 1) * 142 - 72 + 132)::BIGINT AS height
FROM m JOIN r USING (depth), w""")
def graph_layout(spark, d):
    return graph.layout(_small_levels(spark, d))


@query("""WITH n AS (SELECT n_regionkey AS r, n_nationkey AS n FROM nation), c AS (SELECT r, n, min(c_custkey) OVER (PARTITION BY n) AS first, c_custkey FROM n JOIN customer ON c_nationkey = n),
h AS (SELECT r, n % 3 AS h, min(n) AS n FROM n GROUP BY ALL), e AS (SELECT r, min((n, h)) AS x FROM h GROUP BY r)
SELECT r::BIGINT AS root, r || '>' || (100 + n) || '>' || (1000 + c_custkey) AS path FROM c
UNION ALL SELECT r, r || '>' || (100 + x[1]) || '>' || (500 + x[2]) || '>900' FROM e""")
def path_enumeration(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    edge = lambda t, a, b: t.select(a.cast("long").alias("src"), b.cast("long").alias("dst"))
    nation = F.col("n_nationkey") + 100
    hub = F.col("n_nationkey") % 3 + 500
    edges = edge(n, F.col("n_regionkey"), nation).unionByName(edge(c, F.col("c_nationkey") + 100, F.col("c_custkey") + 1000))
    # Diamonds over three hubs to one end, and a way back from each nation.
    edges = edges.unionByName(edge(n, nation, hub)).unionByName(edge(n, hub, F.lit(900))).unionByName(edge(n, nation, F.col("n_regionkey")))
    roots = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("root"))
    return graph.paths(edges, roots, 5).select("root", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def _tree(spark: SparkSession, d: str) -> linker.Linked:
    """Parts as functions, order lines as calls, orders as routes, events as UI events, customers as API calls, suppliers as imports."""
    p, x, o, e, c, s = (table(spark, d, t) for t in ("part", "lineitem", "orders", "events", "customer", "supplier"))
    text = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string") if not isinstance(k, str) else F.col(k).cast("string"))
    functions = p.select(text("p", "p_partkey").alias("id"), text("name", F.col("p_partkey") % 50).alias("name"), text("f", F.col("p_partkey") % 7).alias("file"), F.lit(0).alias("file_ord"), F.col("p_partkey").alias("row_ord"))
    calls = x.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("call_id"), text("f", F.col("l_partkey") % 7).alias("file"), text("name", F.col("l_suppkey") % 60).alias("from"), F.when(F.col("l_linenumber") % 3 > 0, text("p", "l_partkey")).otherwise(F.lit("none")).alias("callee_id")).distinct()
    routes = o.select(text("r", "o_orderkey").alias("route_id"), F.lit("GET").alias("method"), text("/o/", "o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, text("p", F.col("o_orderkey") % 100 + 1)).alias("handler_id"))
    events = e.select(text("e", "event_id").alias("event_id"), F.when(F.col("event_id") % 4 == 0, text("p", F.col("event_id") % 100 + 1)).alias("handler_id"), F.array(text("p", F.col("user_id") % 300 + 1), F.lit("none")).alias("call_ids"))
    api = c.select(text("a", "c_custkey").alias("api_id"), F.when(F.col("c_custkey") % 5 == 0, "POST").otherwise("get").alias("method"), text("/api/o/", "c_custkey").alias("key"), text("f", F.col("c_custkey") % 7).alias("file"), text("name", F.col("c_custkey") % 50).alias("from"))
    return linker.link(functions, calls, routes, events, api, s.select(text("f", "s_suppkey").alias("file"), F.when(F.col("s_suppkey") % 2 == 0, text("f", F.col("s_suppkey") + 1)).alias("resolved")))


_TREE_SQL = """
f AS (SELECT p_partkey AS k, 'p' || p_partkey AS id, 'name' || p_partkey % 50 AS name, 'f' || p_partkey % 7 AS file FROM part), last AS (SELECT file, name, 'p' || max(k) AS id FROM f GROUP BY file, name),
c AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'f' || l_partkey % 7 AS file, 'name' || l_suppkey % 60 AS name, CASE WHEN l_linenumber % 3 > 0 THEN 'p' || l_partkey ELSE 'none' END AS callee FROM lineitem),
cf AS (SELECT c.*, f.id AS target, last.id AS caller FROM c LEFT JOIN f ON c.callee = f.id LEFT JOIN last ON c.file = last.file AND c.name = last.name),
a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'POST' ELSE 'GET' END AS method, 'f' || c_custkey % 7 AS file, 'name' || c_custkey % 50 AS name FROM customer),
ar AS (SELECT k, o_orderkey FROM a LEFT JOIN orders ON o_orderkey = k AND method = 'GET'),
edges AS (SELECT coalesce(caller, file || '::' || name) AS src, target AS dst, 'calls' AS type FROM cf WHERE target IS NOT NULL
  UNION ALL SELECT 'r' || o_orderkey, f.id, 'handles' FROM orders JOIN f ON f.id = 'p' || (o_orderkey % 100 + 1) WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 'e' || event_id, f.id, 'handles' FROM events JOIN f ON f.id = 'p' || (event_id % 100 + 1) WHERE event_id % 4 = 0
  UNION ALL SELECT 'e' || event_id, f.id, 'calls' FROM events JOIN f ON f.id = 'p' || (user_id % 300 + 1)
  UNION ALL SELECT 'a' || k, 'r' || o_orderkey, 'requests' FROM ar WHERE o_orderkey IS NOT NULL
  UNION ALL SELECT last.id, 'a' || k, 'calls' FROM a JOIN last USING (file, name)
  UNION ALL SELECT 'file::f' || s_suppkey, 'file::f' || (s_suppkey + 1), 'imports' FROM supplier WHERE s_suppkey % 2 = 0)"""


@query(f"""WITH {_TREE_SQL} SELECT (SELECT count(*) FROM f) AS total_functions, (SELECT count(*) FROM c) AS total_calls, (SELECT count(*) FROM events) AS total_events, (SELECT count(*) FROM orders) AS total_routes, (SELECT count(*) FROM a) AS total_api_calls,
(SELECT count(*) FROM cf WHERE target IS NOT NULL) AS resolved_calls, (SELECT count(*) FROM cf WHERE target IS NULL) AS unresolved_calls, (SELECT count(*) FROM ar WHERE o_orderkey IS NOT NULL) AS resolved_api_calls, (SELECT count(*) FROM ar WHERE o_orderkey IS NULL) AS unresolved_api_calls""")
def linker_stats(spark, d):
    return _tree(spark, d).stats


@query(f"WITH {_TREE_SQL} SELECT src, dst, type FROM edges")
def linker_graph(spark, d):
    return _tree(spark, d).edges


@query(f"WITH {_TREE_SQL} SELECT type, count(*) AS n FROM (SELECT id, 'function' AS type FROM f UNION ALL SELECT 'r' || o_orderkey, 'route' FROM orders UNION ALL SELECT 'e' || event_id, 'event' FROM events UNION ALL SELECT 'a' || k, 'apiCall' FROM a UNION SELECT unnest([src, dst]), 'file' FROM edges WHERE type = 'imports') GROUP BY type")
def linker_nodes(spark, d):
    return _tree(spark, d).nodes.groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS call_id FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 3 = 0)""")
def linker_unresolved(spark, d):
    return _tree(spark, d).unresolved_calls.select("call_id")


@query(f"""WITH {_TREE_SQL}, n AS (SELECT id, 'function' AS type FROM f UNION ALL SELECT 'r' || o_orderkey, 'route' FROM orders UNION ALL SELECT 'e' || event_id, 'event' FROM events
UNION ALL SELECT 'a' || k, 'apiCall' FROM a UNION SELECT unnest([src, dst]), 'file' FROM edges WHERE type = 'imports')
SELECT src, s.type AS src_type, dst, t.type AS dst_type, edges.type FROM edges LEFT JOIN n s ON src = s.id LEFT JOIN n t ON dst = t.id""")
def linker_union_graph(spark, d):
    """Edges of all kinds with their ends' kinds; a caller that is no function of its file has none."""
    linked = _tree(spark, d)
    end = lambda c: linked.nodes.select(F.col("id").alias(c), F.col("type").alias(f"{c}_type"))
    return linked.edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left").select("src", "src_type", "dst", "dst_type", "type")


@query(f"""WITH {_EDGES_SQL}, n AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS num FROM part)
SELECT 'node' AS what, node AS a, num AS b FROM n UNION ALL SELECT 'edge', s.num, t.num FROM e JOIN n s ON e.src = s.node JOIN n t ON e.dst = t.node""")
def numeric_ids(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("ord"))
    numbered, edges = graph.numeric_graph(nodes, _edges(spark, d))
    return numbered.select(F.lit("node").alias("what"), F.col("node").alias("a"), F.col("num").alias("b")).unionByName(edges.select(F.lit("edge").alias("what"), F.col("src_num").alias("a"), F.col("dst_num").alias("b")))


@query("""WITH t AS (SELECT n_regionkey AS r, n_nationkey AS n, s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey),
w AS (SELECT r_regionkey AS r, -1 AS n, -1 AS s, 0 AS x, 'r' || r_regionkey AS label, 'function' AS type FROM region UNION ALL SELECT DISTINCT r, n, -1, 0, 'n' || n, 'route' FROM t
  UNION ALL SELECT r, n, s, 0, 's' || s, 'function' FROM t WHERE s IS NOT NULL UNION ALL SELECT r, n, s, 1, 's' || s || '.send()', 'external' FROM t WHERE s % 2 = 0)
SELECT 'r' || r AS root, (row_number() OVER (PARTITION BY r ORDER BY n, s, x))::INT AS step, type, label FROM w""")
def trace_forward_exact(spark, d):
    key = lambda p, c: F.concat(F.lit(p), c)
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    ids = table(spark, d, "region").select(key("r", "r_regionkey").alias("id"), F.lit("function").alias("type")).unionByName(n.select(key("n", "n_nationkey").alias("id"), F.lit("route").alias("type"))).unionByName(s.select(key("s", "s_suppkey").alias("id"), F.lit("function").alias("type")))
    typed = ids.select("id", F.col("id").alias("name"), F.lit("a.js").alias("file"), F.lit(1).alias("start_line"), "type")
    act = lambda t, src, ord_, kind, to: t.select(src.alias("src"), F.lit(1).alias("phase"), F.lpad(ord_.cast("string"), 12, "0").alias("ord"), F.lit(kind).alias("kind"), to.alias("key"), to.alias("label"), F.lit("a.js").alias("file"), F.lit(1).alias("line"), F.when(F.lit(kind == "call"), to).alias("target"))
    nation, supplier = key("n", "n_nationkey"), key("s", "s_suppkey")
    acts = act(n, key("r", "n_regionkey"), F.col("n_nationkey"), "call", nation).unionByName(act(s, key("n", "s_nationkey"), F.col("s_suppkey"), "call", supplier)).unionByName(act(s.where("s_suppkey % 2 = 0"), supplier, F.col("s_suppkey"), "external", F.concat(supplier, F.lit(".send()"))))
    return trace.walk(acts, typed, typed.where("id like 'r%'").select(F.col("id").alias("root"))).where("what = 'step'").select("root", F.col("n").alias("step"), "type", "label")


def _loops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(acts, typed functions): regions call nations, these their suppliers and a shared helper; suppliers call their region again, and API calls with shared handlers."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    key = lambda p, c: F.concat(F.lit(p), c)
    region, nation, supplier, helper = key("r", "n_regionkey"), key("n", "n_nationkey"), key("s", "s_suppkey"), F.lit("h")
    handler = key("g", F.col("s_suppkey") % 4)
    at = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")

    def act(t: DataFrame, src: F.Column, phase: int, ord_: F.Column, kind: str, label: F.Column, prefix: str = "", target: F.Column | None = None) -> DataFrame:
        to = label if kind == "call" else F.lit(None).cast("string") if target is None else target
        return t.select(src.alias("src"), F.lit(phase).alias("phase"), ord_.alias("ord"), F.lit(kind).alias("kind"), key(prefix, label).alias("key"), label.alias("label"), F.lit("a.js").alias("file"), F.lit(1).alias("line"), to.alias("target"))

    of_region = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [
        act(n, region, 1, at("n_nationkey"), "call", nation),
        act(s, key("n", "s_nationkey"), 1, at("s_suppkey"), "call", supplier),
        act(n, nation, 1, F.lit("~"), "call", helper),
        act(n, nation, 2, F.lit("0"), "event", F.concat(F.lit("click on <"), nation, F.lit(">")), "evt:"),
        act(n, helper, 1, F.lit("0"), "external", F.lit("h.log()"), "ext:").distinct(),
        act(s.where("s_suppkey % 3 = 0"), supplier, 0, F.lit("0"), "api", key("GET /s/", F.col("s_suppkey") % 4), "api:", handler),
        act(of_region, supplier, 1, F.lit("0"), "call", region),
        act(s.where("s_suppkey % 2 = 0"), supplier, 1, F.lit("1"), "external", F.concat(supplier, F.lit(".send()")), "ext:"),
    ]
    acts = parts[0]
    for p in parts[1:]:
        acts = acts.unionByName(p)
    ids = [n.select(region.alias("id")), n.select(nation.alias("id")), s.select(supplier.alias("id")), s.select(handler.alias("id")), n.select(helper.alias("id"))]
    all_ids = ids[0]
    for i in ids[1:]:
        all_ids = all_ids.unionByName(i)
    return acts, all_ids.distinct().select("id", F.col("id").alias("name"), F.lit("a.js").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("function").alias("type"))


# What a walk meets, in its order (i, ph, k, x): the node that is placed and the edge to tell.
_LOOPS_SQL = """n AS (SELECT 'r' || n_regionkey AS r, 'n' || n_nationkey AS n, n_nationkey AS i FROM nation),
s AS (SELECT r, n, i, 's' || s_suppkey AS s, s_suppkey AS k, 'api:GET /s/' || s_suppkey % 4 AS api, 'g' || s_suppkey % 4 AS g FROM supplier JOIN n ON s_nationkey = i),
w AS (SELECT DISTINCT r, -1 AS i, 0 AS ph, 0 AS k, 0 AS x, 'function' AS type, r AS label, r AS node, 0 AS depth, NULL AS a, NULL AS b FROM n
  UNION ALL SELECT r, i, 0, 0, 0, 'function', n, n, 1, r, n FROM n
  UNION ALL SELECT r, i, 1, k, 0, 'function', s, s, 2, n, s FROM s
  UNION ALL SELECT r, i, 1, k, 1, 'api', api[5:], api, 2, s, api FROM s WHERE k % 3 = 0
  UNION ALL SELECT r, i, 1, k, 2, 'function', g, g, 3, api, g FROM s WHERE k % 3 = 0
  UNION ALL SELECT r, i, 1, k, 3, 'external', s || '.send()', 'ext:' || s || '.send()', 2, s, 'ext:' || s || '.send()' FROM s WHERE k % 2 = 0
  UNION ALL SELECT r, i, 2, 0, 0, 'function', 'h', 'h', 2, n, 'h' FROM n
  UNION ALL SELECT r, i, 2, 0, 1, 'external', 'h.log()', 'ext:h.log()', 2, 'h', 'ext:h.log()' FROM n
  UNION ALL SELECT r, i, 3, 0, 0, 'event', 'click on <' || n || '>', 'evt:click on <' || n || '>', 1, 'evt:click on <' || n || '>', n FROM n)"""


@query(f"""WITH {_LOOPS_SQL}, e AS (SELECT r, what, type, label, a, b, min((i, ph, k, x)) AS place FROM (SELECT r, i, ph, k, x, 'node' AS what, type, label, node AS a, NULL AS b FROM w
UNION ALL SELECT r, i, ph, k, x, 'step', type, label, node, NULL FROM w UNION ALL SELECT r, i, ph, k, x, 'edge', NULL, NULL, a, b FROM w WHERE a IS NOT NULL) GROUP BY ALL)
SELECT r AS root, what, (row_number() OVER (PARTITION BY r, what ORDER BY place))::INT AS n, type, label, a, b FROM e""")
def trace_walk_loops(spark, d):
    """Nodes, edges and steps in a walk's order where functions are shared and call back: who is on the way isn't entered again, who was left isn't expanded again."""
    acts, typed = _loops(spark, d)
    return trace.walk(acts, typed, typed.where("id like 'r%'").select(F.col("id").alias("root"))).select("root", "what", "n", "type", "label", "a", "b")


@query(f"""WITH {_LOOPS_SQL} SELECT r AS root, 'node' AS what, type, node AS a, NULL AS b, min(depth)::INT AS depth FROM w GROUP BY ALL
UNION ALL SELECT DISTINCT r, 'edge', NULL, a, b, NULL::INT FROM (SELECT r, a, b FROM w WHERE a IS NOT NULL UNION ALL SELECT r, s, r FROM s)""")
def trace_forward_typed(spark, d):
    """The same as sets: nodes at their smallest distance, edges with those that lead back."""
    acts, typed = _loops(spark, d)
    nodes, edges, _ = trace.trace_forward(acts, typed, typed.where("id like 'r%'").select(F.col("id").alias("root")))
    none = lambda t: F.lit(None).cast(t)
    nodes = nodes.select("root", F.lit("node").alias("what"), "type", F.col("node").alias("a"), none("string").alias("b"), F.col("depth").cast("int").alias("depth"))
    return nodes.unionByName(edges.select("root", F.lit("edge").alias("what"), none("string").alias("type"), F.col("src").alias("a"), F.col("dst").alias("b"), none("int").alias("depth")))


@query(f"""WITH {_LOOPS_SQL}, c AS (SELECT DISTINCT g, s, n, r FROM s WHERE k % 3 = 0), o AS (SELECT DISTINCT c.g, s.s, s.r FROM c JOIN s USING (r) WHERE NOT EXISTS (SELECT 1 FROM c AS own WHERE own.g = c.g AND own.s = s.s)),
m AS (SELECT DISTINCT g AS root, g AS node, 0 AS depth FROM c UNION SELECT g, s, 1 FROM c UNION SELECT g, n, 2 FROM c UNION SELECT g, r, 3 FROM c UNION SELECT g, s, 4 FROM o UNION SELECT g, 'evt:click on <' || n || '>', 2 FROM c)
SELECT root, 'node' AS what, node AS a, NULL AS b, depth FROM m
UNION ALL SELECT DISTINCT root, 'edge', a, b, NULL::INT FROM (SELECT g AS root, s AS a, g AS b FROM c UNION SELECT g, n, s FROM c UNION SELECT g, r, n FROM c
  UNION SELECT g, 'evt:click on <' || n || '>', n FROM c UNION SELECT c.g, s.s, c.r FROM c JOIN s USING (r))""")
def trace_backward_typed(spark, d):
    """What leads to the handlers of API calls within four levels, round the callbacks, with the UI events on the way."""
    acts, typed = _loops(spark, d)
    called = acts.where("kind = 'api'").select(F.col("target").alias("root")).distinct()
    nodes, edges, _ = trace.trace_backward(acts, typed, called)
    none = lambda t: F.lit(None).cast(t)
    nodes = nodes.select("root", F.lit("node").alias("what"), F.col("node").alias("a"), none("string").alias("b"), F.col("depth").cast("int").alias("depth"))
    return nodes.unionByName(edges.select("root", F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), none("int").alias("depth")))


# Statistics.


def _steps(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size") % 5
    kind = F.when(n == 0, "api").when(n == 1, "external").when(n == 2, "event").when(n == 3, "route").otherwise("function")
    file = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("src/"), F.when(F.col("p_partkey") % 2 == 0, "ui/").otherwise("db/"), "p_brand"))
    return table(spark, d, "part").select(kind.alias("type"), file.alias("file"), S.layer(file).alias("layer"))


_STEPS_SQL = "s AS (SELECT CASE p_size % 5 WHEN 0 THEN 'api' WHEN 1 THEN 'external' WHEN 2 THEN 'event' WHEN 3 THEN 'route' ELSE 'function' END AS type, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'src/' || CASE WHEN p_partkey % 2 = 0 THEN 'ui/' ELSE 'db/' END || p_brand END AS file FROM part)"


@query(f"WITH {_STEPS_SQL} SELECT count(*) AS steps, count(DISTINCT file) AS unique_files, count(*) FILTER (WHERE type = 'function') AS functions, count(*) FILTER (WHERE type = 'api') AS api_calls, count(*) FILTER (WHERE type = 'external') AS \"external\", count(*) FILTER (WHERE type = 'event') AS events, count(*) FILTER (WHERE type = 'route') AS routes FROM s")
def flow_stats_forward(spark, d):
    return stats.forward_stats(_steps(spark, d))


@query(f"WITH {_STEPS_SQL} SELECT count(*) FILTER (WHERE type = 'function') AS total_callers, count(DISTINCT file) AS unique_files, count(*) FILTER (WHERE type = 'event') AS events FROM s")
def flow_stats_backward(spark, d):
    return stats.backward_stats(_steps(spark, d))


@query(f"""WITH {_STEPS_SQL}, c AS (SELECT count(*) AS t, count(*) FILTER (WHERE contains(coalesce(file, ''), 'ui')) AS f, count(*) FILTER (WHERE type IN ('api', 'external')) AS a, count(*) FILTER (WHERE type IN ('event', 'route')) AS e FROM s)
SELECT card, n, floor(100 * n / greatest(1, t) + 0.5)::BIGINT AS percent FROM c, LATERAL (VALUES ('total', t), ('frontend', f), ('backend', t - f), ('api', a), ('entry', e)) AS v(card, n)""")
def stat_cards(spark, d):
    return stats.stat_cards(_steps(spark, d))


@query(f"WITH {_EDGES_SQL} SELECT count(*) AS connections, (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e)) AS nodes FROM e")
def distinct_connections(spark, d):
    return stats.connection_counts(_edges(spark, d))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'user ' || user_id WHEN 'signup' THEN 'signed up' WHEN 'purchase' THEN 'bought by ' || user_id
WHEN 'click' THEN 'Unable to reach summarization service. Please try again.' ELSE 'Summary unavailable.' END AS purpose,
CASE event_type WHEN 'purchase' THEN (props->>'k') || '|{"k":' || (props->>'k') || '}' WHEN 'error' THEN '' WHEN 'signup' THEN '' WHEN 'click' THEN '' ELSE props->>'k' END AS details,
CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS n_calls FROM events""")
def answer_shapes(spark, d):
    """Events as answers: errors, texts, objects with either list, objects without a text, and broken bodies."""
    k = F.get_json_object("props", "$.k")
    shapes = {
        "error": F.format_string('{"success": false, "error": "user %d"}', "user_id"),
        "signup": F.lit('{"success": true, "explanation": "signed up"}'),
        "purchase": F.format_string('{"success": 1, "explanation": {"purpose": "bought by %d", "steps": [%s, {"k": %s}], "details": ["-"], "calls": ["pay"]}}', "user_id", k, k),
        "click": F.lit('{"success": '),
    }
    body = F.format_string('{"success": true, "explanation": {"purpose": 1, "details": ["%s"], "calls": "none"}}', k)
    for name, shape in shapes.items():
        body = F.when(F.col("event_type") == name, shape).otherwise(body)
    e = table(spark, d, "events").select("event_id", answer_parts(body).alias("a"))
    return e.select("event_id", "a.purpose", F.array_join("a.details", "|").alias("details"), F.size("a.calls").alias("n_calls"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
