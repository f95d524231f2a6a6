import json

from pyspark.sql import functions as F

from spanweave.functions import scalars as S
from spanweave.operators import explain, facts, graph, resolve, spans
from spanweave.sources import files
from spanweave.streaming import session as st


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(c.alias("x")).head()["x"]


def test_x3_urls(spark):
    n = lambda u: one(spark, S.normalize_url(F.col("u")), u=u)
    assert [n(u) for u in ("HTTP://A//b/", " /x/ ", "dynamic: /A//:id/", "", None)] == ["http:/a/b", "/x", "dynamic:/a/:id", None, None]
    assert one(spark, S.route_match_key(F.col("u")), u="dynamic:/a/:user_id/b/:x") == "/a/:param/b/:param"
    m = lambda b, p: one(spark, S.merge_base_url(F.col("b"), F.col("p")), b=b, p=p)
    assert [m("http://h/api", "users"), m("b", "/p"), m(None, "p"), m("b", "")] == ["http:/h/api/users", "/p", "p", "b"]


def test_x4_paths(spark):
    j = lambda a, b: one(spark, S.join_paths(F.col("a"), F.col("b")), a=a, b=b)
    assert [j("/API/", "/Users/"), j("/", "/x"), j("/a", ""), j("dynamic:a", "/b"), j(None, None)] == ["/api/users", "/x", "/a", "dynamic:a/b", "/"]
    p = one(spark, S.path_params(F.col("a")), a="/u/:id/[slug]")
    assert [(x["name"], x["segment"], x["segment_index"]) for x in p] == [("id", ":id", 2), ("slug", "[slug]", 3)]


def test_p1_entries(spark):
    c = lambda t: one(spark, S.classify_entry(F.col("t")), t=t)
    assert (c("POST /api/login")["type"], c("get /users/:id")["method"]) == ("route", "GET")
    assert (c("onClick:LoginButton")["element"], c("onSubmit")["event"], c("onSubmit")["element"]) == ("LoginButton", "onSubmit", None)
    assert (c("onClickHandler")["type"], c("build")["name"]) == ("event", "build")


def test_p4_layer_and_p8_health(spark):
    layer = lambda f: one(spark, S.layer(F.col("f")), f=f)
    assert [layer(f) for f in ("a/x.jsx", "src/build/a.js", "db/a.js", None)] == ["frontend", "frontend", "backend", "backend"]
    h = lambda v: one(spark, S.health(F.col("v").cast("double")), v=v)
    assert [h("500"), h("500.1"), h("1000.1")] == ["HEALTHY", "WARNING", "CRITICAL"]


def test_clamp_depth():
    assert [S.clamp_depth(x) for x in (None, 0, -3, 5, 500)] == [8, 8, 8, 5, 100]


def test_s3_s4_archives(spark):
    a = lambda u: one(spark, S.archive_url(F.col("u"), F.lit(None).cast("string")), u=u)
    assert a("https://gitlab.com/o/r.git") == "https://gitlab.com/o/r/-/archive/master/r-master.zip"
    assert a("bitbucket.org/o/r") == "https://bitbucket.org/o/r/get/master.zip"
    assert a("https://github.com/o/gitlab-tools/") == "https://codeload.github.com/o/gitlab-tools/zip/refs/heads/main"
    p = lambda u: tuple(one(spark, S.split_repo_url(F.col("u"), F.lit("7")), u=u))
    assert [p(u) for u in ("https://H.org/a/b.git?x", "h.org/a", "h.org", "http://", None)] == [("h.org", "a", "b"), ("h.org", "a", "repo-7"), ("h.org", "unknown", "repo-7"), ("local", "local", "project-7"), ("local", "local", "project-7")]


def test_x6_collector(spark):
    calls = spark.createDataFrame(
        [("a.js", 0, "f", "id1", 1, 1), ("a.js", 1, "f", "id1", 9, 9), ("a.js", 2, "g", None, 2, 2), ("a.js", 3, "g", None, 2, 2), ("a.js", 4, None, None, 3, 3), ("b.js", 0, "f", "id1", 1, 1)],
        "file string, row_ord int, callee string, calleeFunctionId string, startLine int, endLine int",
    )
    good, bad = facts.collect_facts(calls, "calls")
    assert sorted((r["file"], r["row_ord"]) for r in good.collect()) == [("a.js", 0), ("a.js", 2), ("b.js", 0)]
    assert [r["reason"] for r in bad.collect()] == ["missing callee"]


def test_j1_ranks(spark):
    fs = spark.createDataFrame(
        [("1", "run", "src/a/x.js", 0, 0), ("2", "run", "src/b/y.js", 1, 0), ("3", "run", "lib/z.js", 2, 0), ("4", "only", "q.js", 3, 0), ("5", "Index.build", "i.js", 4, 0), ("6", "A.go", "m/a.js", 5, 0), ("7", "B.go", "m/b.js", 6, 0), ("8", "trap", "zz.js", 7, 0), ("9", "trap", "src/ab/x.js", 8, 0)],
        "id string, name string, file string, file_ord int, row_ord int",
    )
    refs = [("a", "only", "x.js"), ("b", "run", "src/b/y.js"), ("c", "run", "/abs/src/b/y.js"), ("d", "run", "src/b/other.js"), ("e", "run", None), ("f", "build", None), ("g", "go", "m/b.js"), ("h", "go", None), ("i", "none", None), ("j", "trap", "src/a/q.js")]
    got = {r["ref_id"]: (r["function_id"], r["rank"]) for r in resolve.resolve_functions(spark.createDataFrame(refs, "ref_id string, name string, caller_file string"), fs).collect()}
    assert got == {"a": ("4", 0), "b": ("2", 1), "c": ("2", 2), "d": ("2", 3), "e": ("1", 4), "f": ("5", 5), "g": ("7", 6), "h": ("6", 7), "i": (None, None), "j": ("8", 4)}


def test_j4_routes(spark):
    routes = spark.createDataFrame([("r1", "GET", "/users", 0), ("r2", "POST", "/users", 1), ("r3", "GET", "/users/:id", 2), ("r4", "ALL", "/x/:a/y", 3), ("r5", "GET", "/a.b/:c", 4)], "route_id string, method string, path string, ord int")
    calls = [(0, "POST", "/users"), (1, "DELETE", "/users"), (2, "GET", "/users/42"), (3, "POST", "/users/42"), (4, "PUT", "/x/1/y"), (5, None, "https://h/api/users"), (6, "GET", "dynamic:/users"), (7, "GET", "/acb/1"), (8, "GET", None)]
    got = {r["call_id"]: (r["route_id"], r["rank"]) for r in resolve.match_routes(spark.createDataFrame(calls, "call_id int, method string, url string"), routes).collect()}
    again = spark.createDataFrame([("w1", "ANY", "/:a/:b", 5), ("w2", "ANY", "/:c/:d", 6), ("w3", "GET", "/:a/y", 7)], "route_id string, method string, path string, ord int")
    asked = spark.createDataFrame([(0, "GET", "/p/q"), (1, "GET", "/p/y"), (2, "GET", "/p/y"), (3, "get", "https://h/p/y?x=1")], "call_id int, method string, url string")
    assert {r["call_id"]: r["route_id"] for r in resolve.match_routes(asked, again).collect()} == {0: "w1", 1: "w1", 2: "w1", 3: "w1"}
    assert got == {0: ("r2", 0), 1: ("r1", 1), 2: ("r3", 2), 3: (None, None), 4: ("r4", 2), 5: ("r1", 3), 6: (None, None), 7: (None, None), 8: (None, None)}


def test_p2_gate_and_p3_filter(spark):
    d = spark.createDataFrame([("log", "console", True), ("map", "arr", True), ("get", "axios", False), ("post", "axios", False), ("fetch", None, False), ("mine", None, True), ("other", None, False)], "name string, obj string, known boolean")
    got = {r["name"]: r["x"] for r in d.select("name", resolve.relevant(F.col("name"), F.col("obj"), F.col("known")).alias("x")).collect()}
    assert got == {"log": False, "map": False, "get": False, "post": True, "fetch": True, "mine": True, "other": False}


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("b", "c"), ("d", "c")], "src string, dst string")
    root = spark.createDataFrame([("a",)], "root string")
    nodes, edges = graph.trace_forward(e, root)
    assert {r["node"]: r["depth"] for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("a", "b"), ("b", "a"), ("b", "c")}
    nodes, _ = graph.trace_backward(e, spark.createDataFrame([("c",)], "root string"), 1)
    assert {r["node"] for r in nodes.collect()} == {"b", "c", "d"}
    assert {r["node"]: r["level"] for r in graph.levels(e, root).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert sorted(r["path"] for r in graph.paths(e, root).collect()) == [["a", "b", "c"]]
    # A diamond below a cycle, many times over: each end once, by the smallest of the shortest paths.
    wide = spark.createDataFrame([(f"{i}{k}", f"{i + 1}{j}") for i in range(9) for k in "xyz" for j in "xyz"] + [("a", "0x"), ("0x", "a"), ("a", "0y"), ("9x", "end")], "src string, dst string")
    assert sorted(r["path"] for r in graph.paths(wide, root).collect()) == [["a", "0x", *[f"{i}x" for i in range(1, 10)], "end"], ["a", "0x", *[f"{i}x" for i in range(1, 9)], "9y"], ["a", "0x", *[f"{i}x" for i in range(1, 9)], "9z"]]
    assert graph.reach(e.limit(0), root, 3).count() == 1


def test_code_and_files(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.js").write_text("1\n2\n3")
    (tmp_path / "src/t.d.ts").write_text("x")
    (tmp_path / "src/node_modules/b.js").write_text("x")
    tree = files.scan_tree(spark, str(tmp_path))
    assert [r["path"] for r in tree.collect()] == ["src/a.js"]
    nodes = spark.createDataFrame([("src/a.js", 2, None), ("src/a.js", 1, 2), ("src/a.js", 9, 9), ("none", 1, 1)], "file string, start_line int, end_line int")
    assert sorted((r["start_line"], r["end_line"], r["code"]) for r in files.attach_code(nodes, tree).where("file <> 'none'").collect()) == [(1, 2, "1\n2"), (2, None, "2\n3"), (9, 9, None)]
    s = spark.createDataFrame([("hello",)], "c string").select(files.splice(F.col("c"), F.lit(1), F.lit(3), F.lit("X")).alias("x"))
    assert s.head()["x"] == "hXlo"
    p = spark.createDataFrame([("/repo/a",), ("/repo-x/a",)], "p string").select(files.inside_root(F.col("p"), "/repo").alias("x"))
    assert [r["x"] for r in p.collect()] == [True, False]


def _body(*spans):
    return json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": list(spans)}]}]})


def _span(trace, name, start, end, **attributes):
    return {"traceId": trace, "spanId": f"{trace}-{name}", "name": name, "startTimeUnixNano": str(start), "endTimeUnixNano": str(end), "attributes": [{"key": k.replace("_", "."), "value": {"stringValue": v}} for k, v in attributes.items()]}


def test_otlp_stream(spark, tmp_path):
    big = 1 << 60
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text(_body(_span("t1", "middleware - cors", big, big + 5), _span("t1", "load", big + 2_000_000, big + 4_000_000, static_file="a.js", static_line="7"), _span("t1", "GET /x", big, big + 10_000_000, http_method="GET", http_route="/x", static_file="b.js", static_line="1")))
    s = st.Session()
    s.arm()
    got = {}
    q = st.start(st.json_bodies(spark, str(tmp_path / "in")), s, lambda kind, df: got.setdefault(kind, df.collect()), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r["node_id"], r["offset_ms"], r["duration_ms"]) for r in got["pulse_batch"]] == [("b.js:1", 0.0, 10.0), ("a.js:7", 2.0, 2.0)]
    assert s.roots[0]["root_name"] == "GET /x" and not s.armed and s.handled == "t1"
    assert [r["start_ns"] for r in got["spans"]][0] == big


def test_attributes_last_wins(spark):
    df = spark.createDataFrame([(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "t", "attributes": [{"key": "a", "value": {"stringValue": "1"}}, {"key": "a", "value": {"intValue": "2"}}, {"key": "d", "value": {"doubleValue": 1.5}}]}]}]}]}),)], "value string")
    assert spans.flatten_otlp(df).head()["attributes"] == {"a": "2", "d": None}


def test_explain_stub(spark):
    nodes = spark.createDataFrame([("f", "code"), ("f", "code"), ("", "x")], "label string, code string")
    got = explain.explain(nodes).collect()
    assert len(got) == 3 and {r["purpose"] for r in got} == {explain.FALLBACK["purpose"], None}
    assert explain.parse_answer('```json\n{"purpose": "p", "details": "d"}\n```') == {"purpose": "p", "details": "d"}


def test_links_by_key(spark):
    fs = spark.createDataFrame([("a.js::run::1", "run", "a.js", 0, 0), ("b.js::S.run::4", "S.run", "b.js", 1, 0)], "id string, name string, file string, file_ord int, row_ord int")
    refs = spark.createDataFrame([("1", "b.js::S.run::4"), ("2", "b.js::S.run"), ("3", "c.js::run::9"), ("4", "c.js::none::9")], "ref_id string, target string")
    got = {r["ref_id"]: (r["function_id"], r["rank"]) for r in resolve.link_functions(refs, fs).collect()}
    assert got == {"1": ("b.js::S.run::4", 0), "2": ("b.js::S.run::4", 1), "3": ("a.js::run::1", 2), "4": (None, None)}
    routes = spark.createDataFrame([("r1", "run"), ("r2", "ctrl.run"), ("r3", None)], "route_id string, handler string")
    assert {(r["function_id"], r["route_id"]) for r in resolve.routes_of(fs, routes).collect()} == {("a.js::run::1", "r1"), ("a.js::run::1", "r2")}
    calls = spark.createDataFrame([("a.js", "run", "x"), ("z.js", "run", "y")], "file string, from string, name string")
    assert [(r["function_id"], r["name"]) for r in resolve.calls_of(fs, calls).collect()] == [("a.js::run::1", "x")]
    edges = spark.createDataFrame([("e", "a", "handles"), ("a", "b", "calls"), ("b", "c", "imports")], "src string, dst string, type string")
    assert [r["path"] for r in graph.trace_ui_to_backend(edges, spark.createDataFrame([("e",)], "root string")).collect()] == [["e", "a", "b"]]


def test_ask_and_definition(spark):
    q = spark.createDataFrame([("f", "code", "why?"), ("f", "code", "why?"), ("f", "", "how?"), ("g", "x", "boom")], "label string, code string, question string")

    def client(prompt):
        if "boom" in prompt:
            raise ValueError
        return " since "

    got = sorted((r["label"], r["question"], r["answer"]) for r in explain.ask(q, client).collect())
    assert got == [("f", "how?", explain.MISSING), ("f", "why?", " since "), ("f", "why?", " since "), ("g", "boom", explain.NO_ANSWER)]
    fs = spark.createDataFrame([("1", "A.run", "a.js", 0, 0, 2, 3)], "id string, name string, file string, file_ord int, row_ord int, start_line int, end_line int")
    asked = spark.createDataFrame([("q", "run", None), ("z", "none", None)], "ref_id string, name string, caller_file string")
    tree = spark.createDataFrame([("a.js", "1\n2\n3")], "path string, content string")
    assert {r["ref_id"]: (r["file"], r["start_line"], r["code"]) for r in resolve.function_definition(asked, fs, tree).collect()} == {"q": ("a.js", 2, "2\n3"), "z": (None, None, None)}


def test_trace_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.json").write_text(_body(_span(f"t{i}", "load", 10 * i, 10 * i + 4_000_000, http_method="get", http_route="/x"), _span("t0", f"again{i}", 10 * i + 1, 10 * i + 2)))
    store = st.TraceStore(spark, str(tmp_path / "store"), cap=2)
    q = st.start(st.json_bodies(spark, str(tmp_path / "in")), st.Session(), lambda *a: None, str(tmp_path / "cp"), store=store)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    # Files come in order of their time; whichever came, the two last new traces are kept and every hit counts.
    kept = {r["trace_id"] for r in store.spans().collect()}
    assert len(kept) == 2 and store.summaries().count() == 2
    m = store.metrics().head()
    assert (m["metric_key"], m["hits"], m["average_ms"]) == ("GET:/x", 5, 4.0)
    small = store.compact(str(tmp_path / "small"))
    assert small.metrics().collect() == store.metrics().collect() and {r["trace_id"] for r in small.spans().collect()} == kept
    assert sorted(small.spans().select("trace_id", "span_id").collect()) == sorted(store.spans().select("trace_id", "span_id").collect())
    spans_again = spark.read.parquet(f"{store.path}/batch=0")
    store.add(spans_again.limit(0), 99)
    assert store.metrics().head()["hits"] == 5


def test_backward_layout(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("a", "x"), ("y", "z")], "src string, dst string")
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate("abcdxyz")], "node string, ord int")
    for root in ("a", "gone"):
        rows, edges = graph.backward_layout(nodes, e, spark.createDataFrame([(root,)], "root string"))
        got = {r["node"]: (r["level"], r["y"]) for r in rows.collect()}
        assert {k: v for k, (v, _) in got.items()} == {"a": 0, "x": 1, "b": 1, "d": 1, "c": 2}
        assert got["a"][1] > got["b"][1] > got["c"][1] == 0 and edges.count() == 4


def test_match_routes_by_shuffled_shapes(spark, monkeypatch):
    """More shapes than are broadcast give the same matches."""
    routes = spark.createDataFrame([("r1", "GET", "/a/:id", 1), ("r2", "POST", "/:x/b", 2), ("r3", "ANY", "/a/:id/c/:n", 3)], "route_id string, method string, path string, ord int")
    calls = spark.createDataFrame([("c1", "GET", "/a/7"), ("c2", "POST", "/q/b"), ("c3", "PUT", "/a/1/c/2"), ("c4", "GET", "/none")], "call_id string, method string, url string")
    want = {"c1": "r1", "c2": "r2", "c3": "r3", "c4": None}
    for most in (10_000, 0):
        monkeypatch.setattr(resolve, "MOST_SHAPES", most)
        assert {r["call_id"]: r["route_id"] for r in resolve.match_routes(calls, routes).collect()} == want


def test_running_metrics_over_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        data = [("hot" if i % 3 else None, i, None if i % 10 == 0 else i / 100) for i in range(500)]
        d = spans.running_metrics(spark.createDataFrame(data, "k string, at long, v double"), "k", "v", ["at"])
        got = {r["at"]: (r["hits"], r["mean_cents"]) for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, so_far = {}, {}
    for k, at, v in data:
        hits, cents = so_far.get(k, (0, None))
        hits, cents = hits + 1, cents if v is None else (cents or 0) + at
        so_far[k] = (hits, cents)
        want[at] = (hits, None if cents is None else cents / hits)
    assert got == want
    empty = spark.createDataFrame([], "k string, at long, v double")
    assert spans.running_metrics(empty, "k", "v", ["at"]).columns == ["k", "at", "v", "hits", "mean_cents"]
    assert spans.running_metrics(empty, "k", "v", ["at"]).count() == 0


def test_lookups(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "a", "handles"), ("c", "b", None)], "src string, dst string, type string")
    assert [tuple(r) for r in graph.outgoing(edges, "a").collect()] == [("a", "b", "calls")]
    assert sorted(r["src"] for r in graph.incoming(edges, "b").collect()) == ["a", "c"]
    assert graph.edges_of(edges, "handles").count() == 1
    of = spans.spans_of(spark.createDataFrame([("t", 1), ("t", 2), (None, 3)], "trace_id string, n int"), "t")
    assert sorted(r["n"] for r in of.collect()) == [1, 2]
