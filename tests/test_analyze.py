import collections
import json

from pyspark.sql import functions as F

from spanweave.operators import trace
from spanweave.operators.spans import route_metrics
from spanweave.plans.analyze import analyze, facts_of, linked_tree, trace_roots, typed_actions
from spanweave.streaming import session as st

TREE = {
    "ui/a.jsx": "import { send } from './send';\nimport axios from 'axios';\nexport function Page() {\n  return <button onClick={save}>x</button>;\n}\nexport function save() {\n  axios.get('/ping');\n  send(1);\n  later(done);\n}\nfunction done() {\n}\n",
    "ui/send.js": "export async function send(x) {\n  return fetch('/users', { method: 'POST' });\n}\n",
    "api/r.js": "const { insert } = require('../db/m');\nrouter.post('/users', create);\nfunction create(req) {\n  insert(req);\n  mongoose.connect(req);\n}\n",
    "db/m.js": "function insert(row) {\n  check(row);\n}\nfunction check(row) {\n  insert(row);\n}\nfunction idle() {\n}\nmodule.exports = { insert };\n",
}


def tree(spark):
    return spark.createDataFrame(list(TREE.items()), "path string, content string")


def entries(spark, *e):
    return spark.createDataFrame([(x, None) for x in e], "entry string, file_hint string")


def test_tree_to_flow(spark):
    facts = facts_of(tree(spark))
    ids = {r["name"]: r["id"] for r in facts.functions.collect()}
    assert set(ids) == {"Page", "save", "done", "send", "create", "insert", "check", "idle"}
    f = analyze(facts, entries(spark, "onClick:button"))
    nodes = {(r["label"], r["type"], r["depth"], r["file"]) for r in f.nodes.collect()}
    assert nodes == {
        ("save", "event", 0, "ui/a.jsx"), ("onClick on <button>", "event", 0, "ui/a.jsx"), ("GET /ping", "api", 0, "ui/a.jsx"), ("done", "function", 1, "ui/a.jsx"), ("send", "function", 1, "ui/send.js"), ("POST /users", "api", 1, "ui/send.js"), ("fetch()", "external", 1, "ui/send.js"),
        ("create", "route", 2, "api/r.js"), ("POST /users", "route", 2, "api/r.js"), ("mongoose.connect()", "external", 2, "api/r.js"), ("insert", "function", 3, "db/m.js"), ("check", "function", 4, "db/m.js"),
    }
    edges = {(r["src"], r["dst"]) for r in f.edges.collect()}
    assert {(ids["save"], ids["send"]), (ids["send"], "api:POST /users"), ("api:POST /users", ids["create"]), (ids["create"], ids["insert"]), (ids["check"], ids["insert"])} <= edges
    assert (ids["send"], ids["create"]) not in edges
    steps = f.steps.orderBy("step").collect()
    assert [r["step"] for r in steps] == sorted({r["step"] for r in steps}) and steps[0]["depth"] == 0
    count = f.stats.head()
    assert {k: count[k] for k in ("steps", "api_calls", "events", "routes", "external", "functions", "unique_files")} == {"steps": len(nodes), "api_calls": 2, "events": 2, "routes": 2, "external": 2, "functions": 4, "unique_files": 4}
    code = {r["label"]: r["code"] for r in f.nodes.collect()}
    assert code["check"] == "function check(row) {\n  insert(row);\n}"


def test_backward_with_events(spark):
    f = analyze(facts_of(tree(spark)), entries(spark, "send"), "backward", 4)
    got = {r["label"]: r["type"] for r in f.steps.collect()}
    assert got == {"save": "event", "onClick on <button>": "event"}
    assert f.stats.head()["events"] == 2


def test_metrics_on_routes(spark):
    spans = spark.createDataFrame([("post", "/users", 600.0, "t", 1)], "method string, route string, duration_ms double, trace_id string, ts int")
    f = analyze(facts_of(tree(spark)), entries(spark, "POST /users"), metrics=route_metrics(spans, ["ts"]))
    got = {r["node"]: r["status"] for r in f.nodes.where("hits is not null").collect()}
    assert list(got.values()) == ["WARNING"] and next(iter(got)).startswith("route:")


def brute_walk(acts, info, root, most):
    """The walk as a recursion: (nodes, edges, steps) in order."""
    nodes, edges, steps, done = [], [], [], set()
    add = lambda into, x: x in into or into.append(x)

    def enter(node, caller, way):
        if len(way) > most or node in way:
            return
        kind, name, file = info[node]
        add(nodes, node)
        if caller and caller != node:
            add(edges, (caller, node))
        add(steps, (kind, name, file))
        if node in done:
            return
        for a in sorted(acts[node], key=lambda a: (a["phase"], a["ord"], a["kind"], a["key"])):
            if a["kind"] == "call":
                enter(a["target"], node, [*way, node])
                continue
            add(nodes, a["key"])
            add(edges, (a["key"], node) if a["kind"] in ("event", "route") else (node, a["key"]))
            add(steps, (a["kind"], a["label"], a["file"]))
            if a["target"]:
                enter(a["target"], a["key"], [*way, node])
        done.add(node)

    enter(root, None, [])
    return nodes, edges, steps


def test_walk_matches_recursion(spark):
    acts, typed = typed_actions(facts_of(tree(spark)))
    by_src, info = collections.defaultdict(list), {r["id"]: (r["type"], r["name"], r["file"]) for r in typed.collect()}
    for r in acts.collect():
        by_src[r["src"]].append(r.asDict())
    for most in (8, 1):
        rows = trace.walk(acts, typed, typed.select(F.col("id").alias("root")), most).orderBy("root", "what", "n").collect()
        for root in info:
            own = [r for r in rows if r["root"] == root]
            got = ([r["a"] for r in own if r["what"] == "node"], [(r["a"], r["b"]) for r in own if r["what"] == "edge"], [(r["type"], r["label"], r["file"]) for r in own if r["what"] == "step"])
            assert got == brute_walk(by_src, info, root, most), (root, most)


def test_linked_tree(spark):
    g = linked_tree(tree(spark))
    ids = {r["name"]: r["id"] for r in facts_of(tree(spark)).functions.collect()}
    edges = {(r["src"], r["dst"], r["type"]) for r in g.edges.collect()}
    assert {("file::api/r.js", "file::db/m.js", "imports"), ("file::ui/a.jsx", "file::ui/send.js", "imports"), (ids["save"], ids["send"], "calls"), (ids["create"], ids["insert"], "calls")} <= edges
    assert {t for _, _, t in edges} == {"calls", "handles", "requests", "imports"}
    s = g.stats.head()
    assert s["total_functions"] == 8 and s["total_calls"] == s["resolved_calls"] + s["unresolved_calls"] and s["resolved_calls"] >= 5
    assert (s["total_api_calls"], s["resolved_api_calls"], s["unresolved_api_calls"], s["total_routes"], s["total_events"]) == (2, 1, 1, 1, 1)
    assert g.unresolved_calls.count() == s["unresolved_calls"] and g.unresolved_api_calls.count() == 1


def test_stream_sends_the_root_s_graph(spark, tmp_path):
    span = {"traceId": "t1", "spanId": "s", "name": "POST /users", "startTimeUnixNano": "1000000", "endTimeUnixNano": "3000000", "attributes": [{"key": k, "value": {"stringValue": v}} for k, v in (("http.method", "POST"), ("http.route", "/users"))]}
    for i, trace in enumerate(("t1", "t2")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span | {"traceId": trace}]}]}]}))
    for follow, kind in ((trace_roots(facts_of(tree(spark))), "graph"), (lambda *a: 1 / 0, "graph_error")):
        session, got = st.Session(), collections.defaultdict(list)
        session.arm()
        q = st.start(st.json_bodies(spark, str(tmp_path / "in")), session, lambda k, d, got=got: got[k].append(d.collect()), str(tmp_path / kind), follow)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert len(got["root"]) == 1 and len(got["spans"]) == 2 and not session.armed and len(got[kind]) == 1
        if kind == "graph":
            rows = [(r["kind"], json.loads(r["json"])) for r in got["graph"][0]]
            nodes = {x["label"]: x for k, x in rows if k == "node" and x["type"] != "external" and x["label"] != "POST /users"}
            assert set(nodes) == {"create", "insert", "check"} and nodes["create"]["live_id"] == "api/r.js:3"
            ids = sorted(x["id"] for k, x in rows if k == "node")
            links = {(x["src_num"], x["dst_num"]) for k, x in rows if k == "edge"}
            assert ids == list(range(len(ids))) and (nodes["create"]["id"], nodes["insert"]["id"]) in links
