from spanweave.sources import extract as X

SERVER = """// const hidden = () => gone();
const express = require('express');
const router = express.Router();
/* function alsoHidden() {
} */
export async function load(id) {
  if (id) { console.log("x {"); return api.find(id); }
  return helper(new Store(id));
}
const save = async (a, b) => {
  const inner = () => deep();
  await axios.post('/api/Users/', a);
  return fetch(`/api/users/${a.id}`, { method: 'PUT' });
};
class Index {
  build(x) {
    this.scan(x);
  }
  get size() { return count(); }
}
exports.run = function () { load(1); };
app.use('/api', router);
router.get('/users/:id', auth, users.show);
router.post('/users', (req, res) => save(req));
"""
PAGE = """export function Page() {
  return <div><button onClick={save} /><a onClick={() => go()}>x</a><Item onSelect={ok ? pick : drop} onHover={handlers[k]} /></div>;
}
"""


def facts(spark):
    files = spark.createDataFrame([("src/server.js", SERVER), ("src/page.jsx", PAGE), ("web/app/users/route.ts", "export async function GET() {\n}\n"), ("none.js", None)], "path string, content string")
    lines = X.source_lines(files).cache()
    return files, lines, X.extract_functions(files, lines).cache()


def test_functions(spark):
    _, _, f = facts(spark)
    got = {r["name"]: (r["start_line"], r["end_line"], r["type"], r["parent_function"]) for r in f.where("file = 'src/server.js'").collect()}
    assert got == {
        "load": (6, 9, "declaration", None), "save": (10, 14, "arrow", None), "inner": (11, 11, "arrow", "save"), "Index.build": (16, 18, "classMethod", None), "Index.size": (19, 19, "getter", None), "run": (21, 21, "exportAssignment", None),
        "anonymous_L24_C22": (24, 24, "arrow", None),
    }


def test_calls(spark):
    files, lines, f = facts(spark)
    got = {(r["callee"], r["type"], r["from"]) for r in X.extract_calls(files, f, lines).where("file = 'src/server.js'").collect()}
    assert {("api.find", "member", "load"), ("helper", "direct", "load"), ("Store", "constructor", "load"), ("deep", "direct", "inner"), ("this.scan", "member", "Index.build"), ("load", "direct", "run"), ("axios.post", "member", "save")} <= got
    assert not {c for c, _, _ in got} & {"console.log", "gone", "if", "require"}


def test_api_calls(spark):
    files, lines, f = facts(spark)
    got = sorted((r["lib"], r["method"], r["normalized_url"], r["route_match_key"], r["from"]) for r in X.extract_api_calls(files, f, lines).collect())
    assert got == [("axios", "POST", "/api/users", "/api/users", "save"), ("fetch", "PUT", "dynamic:/api/users/:param", "/api/users/:param", "save")]


def test_routes(spark):
    files, lines, f = facts(spark)
    got = {(r["method"], r["path"], r["handler"], tuple(r["middleware"])) for r in X.extract_routes(files, f, lines).collect()}
    assert {("GET", "/api/users/:id", "users.show", ("auth",)), ("POST", "/api/users", "inline", ()), ("GET", "/users", "GET", ())} <= got


def test_events(spark):
    files, lines, _ = facts(spark)
    got = {(r["event"], r["element"], r["handler"], tuple(r["calls_inside"])) for r in X.extract_events(files, lines).collect()}
    assert {("onClick", "button", "save", ()), ("onClick", "a", "go", ("go",)), ("onSelect", "Item", "conditional", ("pick", "drop"))} <= got


def test_imports_callees_and_callbacks(spark):
    main = "import run, { a as b, c } from './lib/x';\nimport * as all from '../up';\nconst { d } = require('./lib');\nimport ext from 'pkg';\nfunction go(list) {\n  b(1);\n  all.z();\n  list.each(own, 2);\n  d(ext.thing(q));\n}\nfunction own(x) { return c(x); }\n"
    files = spark.createDataFrame([("src/m.js", main), ("src/lib/x.js", "export function a() {\n}\nexport function c() {\n}\n"), ("up.ts", "export function z() {\n}\n"), ("src/lib/index.js", "function d() {\n}\n")], "path string, content string")
    lines = X.source_lines(files).cache()
    f = X.extract_functions(files, lines).cache()
    imports = X.extract_imports(files, lines)
    got = {(r["name"], r["imported_as"], r["type"], r["resolved"]) for r in imports.collect()}
    assert got == {("a", "b", "named", "src/lib/x.js"), ("c", "c", "named", "src/lib/x.js"), ("default", "run", "default", "src/lib/x.js"), (None, "all", "namespace", "up.ts"), ("d", "d", "named", "src/lib/index.js"), ("default", "ext", "default", None)}
    calls = X.with_callees(X.extract_calls(files, f, lines), f, imports).where("file = 'src/m.js'").collect()
    ids = {r["name"]: r["id"] for r in f.collect()}
    callee = {r["callee"]: (r["callee_function_id"], r["is_external"]) for r in calls}
    assert callee["b"] == (ids["a"], False) and callee["all.z"] == (ids["z"], False) and callee["d"] == (ids["d"], False) and callee["c"] == (ids["c"], False) and callee["ext.thing"] == (None, True) and callee["list.each"] == (None, False)
    assert {(r["callee"], r["from"]) for r in calls if r["is_callback"]} == {("own", "go"), ("q", "go"), ("x", "own")}
    assert {r["extractor"]: (r["rows"], r["errors"]) for r in X.extractor_counts({"functions": f, "imports": imports}, {"functions": f.limit(1)}).collect()} == {"functions": (6, 1), "imports": (6, 0)}


LOOSE = """import axios from 'axios';
const root = axios
  .create({
    baseURL: '/api',
  });
const v2 = root.create({ baseURL: 'v2' });
const late = unknown.create({ baseURL: '/no' });
export const send = async (
  a,
  { b } = {},
): Promise<void> => {
  await fetch(
    '/one/' + a.id,
    {
      method: 'post',
      body: `x${b ? `y${fetch(URL)}` : ''}`,
    },
  );
  v2
    .put(`items/${a.id}/x`, b);
  root('/plain'); root(computed()); late.get('/never');
  axios({ url: '/all/' + a + '/c', method: 'delete' });
  fetch(a ? '/x' : '/y', { method: verb });
};
app
  .get(
    '/things/:id',
    guard,
    check('a'),
    async function (req, res) {
      list.map((x) =>
        wrap(x)
      );
    },
  );
const text = "it's // no comment"; const re = /["'`]\\/(/g;
export default function () { tail(); }
const o = { key: async () => one(), plain(a) { two(a); }, 'a-b': function* () { three(); } };
class A extends B.C { static async run() { this.go(); } constructor() { init(); } }
"""


def loose(spark):
    files = spark.createDataFrame([("loose.ts", LOOSE), ("none.ts", None), ("odd.js", "`${ ( } ' \" / ) ] /*")], "path string, content string")
    found = X.code_tokens(files)
    return files, found, X.extract_functions(files, found=found).cache()


def test_functions_over_lines(spark):
    _, _, f = loose(spark)
    got = {r["name"]: (r["start_line"], r["end_line"], r["type"], r["is_async"], r["is_exported"], r["parent_function"]) for r in f.collect()}
    assert got == {
        "send": (8, 24, "arrow", True, True, None), "anonymous_L30_C4": (30, 34, "expression", True, False, None), "anonymous_L31_C15": (31, 32, "arrow", False, False, "anonymous_L30_C4"),
        "anonymous_L37_C15": (37, 37, "expression", False, True, None), "key": (38, 38, "method", True, False, None), "plain": (38, 38, "objectMethod", False, False, None), "a-b": (38, 38, "method", False, False, None),
        "A.run": (39, 39, "classMethod", True, False, None), "A.constructor": (39, 39, "classMethod", False, False, None),
    }


def test_calls_over_lines(spark):
    files, found, f = loose(spark)
    got = {(r["callee"], r["type"], r["from"], r["start_line"], r["end_line"]) for r in X.extract_calls(files, f, found=found).collect()}
    assert got >= {
        ("fetch", "direct", "send", 12, 18), ("fetch", "direct", "send", 16, 16), ("URL", "callback", "send", 16, 16), ("v2.put", "member", "send", 19, 20), ("b", "callback", "send", 20, 20), ("computed", "direct", "send", 21, 21),
        ("app.get", "member", "module", 25, 35), ("guard", "callback", "module", 28, 28), ("check", "direct", "module", 29, 29), ("wrap", "direct", "module", 32, 32), ("x", "callback", "module", 32, 32),
        ("tail", "direct", "module", 37, 37), ("one", "direct", "key", 38, 38), ("two", "direct", "plain", 38, 38), ("this.go", "member", "A.run", 39, 39), ("init", "direct", "A.constructor", 39, 39),
    }
    assert not {c for c, *_ in got} & {"run", "A.run", "constructor", "plain", "async", "req"}


def test_api_calls_and_their_clients(spark):
    files, found, f = loose(spark)
    got = {(r["start_line"], r["lib"], r["method"], r["url"], r["base_url"], r["static_prefix"], r["is_dynamic"]) for r in X.extract_api_calls(files, f, found=found).collect()}
    assert got == {
        (12, "fetch", "POST", "dynamic:/one/:param", None, "/one/", True), (16, "fetch", "GET", "dynamic:URL", None, None, True), (23, "fetch", "DYNAMIC", "dynamic:unknown", None, None, True),
        (19, "axiosInstance", "PUT", "/api/v2/dynamic:items/:param/x", "/api/v2", "items/", True), (21, "axiosInstance", "GET", "/plain", "/api", "/plain", False), (22, "axios", "DELETE", "dynamic:/c", None, None, True),
    }


def test_client_as_of_its_use(spark):
    code = "let c = axios.create({ baseURL: '/a' });\nc.get('x');\nc = axios.create({ baseURL: '/b' });\nc.get('x');\nd.get('/early');\nconst d = c.create({});\nd.get('y');\n"
    files = spark.createDataFrame([("c.js", code), ("d.js", "c.get('z');\n")], "path string, content string")
    found = X.code_tokens(files)
    got = {(r["start_line"], r["url"]) for r in X.extract_api_calls(files, X.extract_functions(files, found=found), found=found).collect()}
    assert got == {(2, "/a/x"), (4, "/b/x"), (7, "/b/y")}


def test_routes_over_lines(spark):
    files, found, f = loose(spark)
    got = [(r["method"], r["path"], r["handler"], r["middleware"], r["start_line"]) for r in X.extract_routes(files, f, found=found).where("router = 'app'").collect()]
    assert got == [("GET", "/things/:id", "inline", ["guard", "check"], 25)]


def test_callees_through_re_exports(spark):
    code = {
        "main.js": "import { go, lost, both } from './a';\nimport * as all from './a';\nimport run from './e';\ngo();\nlost();\nboth();\nall.deep();\nrun();\n",
        "a.js": "export { start as go } from './b';\nexport { lost } from './c';\nexport * from './d';\nexport { both } from './e';\n",
        "b.js": "import { begin } from './lib/f';\nexport { begin as start };\n",
        "c.js": "export { lost } from './a';\n",  # a circle
        "d.js": "export * from './e';\nexport * from './a';\n",  # another one
        "e.js": "export function deep() {\n}\nexport function both() {\n}\nexport default function main() {\n}\n",
        "lib/f.js": "export function begin() {\n}\nexport function both() {\n}\n",
    }
    files = spark.createDataFrame(list(code.items()), "path string, content string")
    t = X.extract_all(files)
    calls = X.with_callees(t["calls"], t["functions"], t["imports"], t["exports"]).where("file = 'main.js'").collect()
    assert {r["callee"]: r["callee_function_id"] for r in calls} == {"go": "lib/f.js::begin::1", "lost": None, "both": "e.js::both::3", "all.deep": "e.js::deep::1", "run": "e.js::main::5"}


def test_sweep_against_all_pairs(spark):
    import random

    from spanweave.operators.sweep import stab

    rnd = random.Random(4)
    intervals = [(g, a, a + rnd.randrange(12), f"n{i}") for i in range(120) for g, a in [(rnd.choice("ab"), rnd.randrange(60))]]
    points = [(rnd.choice("abc"), rnd.randrange(75), i) for i in range(150)] + [("a", None, 150), (None, 3, 151)]
    p, v = spark.createDataFrame(points, "g string, at int, id int"), spark.createDataFrame(intervals, "g string, a int, z int, name string")
    for inner in (True, False):
        for strictly in (False, True):
            got = {r["id"]: (r["hit_start"], r["hit_end"]) for r in stab(p, v, "g", "at", "a", "z", "name", inner, strictly).collect()}
            for g, at, i in points:
                hit = [(a, z) for h, a, z, _ in intervals if h == g and at is not None and (a < at if strictly else a <= at) and at <= z]
                want = (max(hit, key=lambda x: (x[0], -x[1])) if inner else min(hit, key=lambda x: (x[0], -x[1]))) if hit else (None, None)
                assert got[i] == want, (inner, strictly, g, at)


def test_sweep_of_a_long_file(spark):
    """100,000 lines in 20,000 functions of one file, each in an outer one of 1,000 lines."""
    from spanweave.sources.files import covering

    f = spark.range(20_000).selectExpr("'big.js' as file", "cast(id * 5 + 1 as int) as start_line", "cast(id * 5 + 4 as int) as end_line", "concat('f', id) as name")
    outer = spark.range(100).selectExpr("'big.js' as file", "cast(id * 1000 as int) as start_line", "cast(id * 1000 + 999 as int) as end_line", "concat('o', id) as name")
    rows = spark.range(100_000).selectExpr("'big.js' as file", "cast(id as int) as line")
    got = X.within(rows, f.unionByName(outer))
    assert got.where("caller <> case when line % 5 = 0 then concat('o', line div 1000) else concat('f', line div 5) end").count() == 0 and got.count() == 100_000
    assert covering(f.unionByName(outer), rows).where("start_line = line div 1000 * 1000 and end_line = start_line + 999").count() == 100_000


def test_chains_and_circles(spark):
    from spanweave.operators.pointers import closure, follow

    rows = [(i, i + 1, None) for i in range(500)] + [(500, None, "end"), (600, 601, None), (601, 600, None), (700, 999, None)]
    got = {r["node"]: r["target"] for r in follow(spark.createDataFrame(rows, "node int, next int, target string")).collect()}
    assert got == {**dict.fromkeys(range(501), "end"), 600: None, 601: None, 700: None}
    pairs = {tuple(r) for r in closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src int, dst int")).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 3, 1), (2, 1, 2), (2, 4, 2), (3, 1, 1), (3, 2, 2), (3, 4, 1)}


def test_extractors_fail_alone(spark):
    files = spark.createDataFrame([("a.js", "go();\n"), ("b.js", "bad"), ("c.js", None)], "path string, content string")

    def words(path, content):
        if content == "bad":
            raise ValueError("no such code")
        return [(w, len(w)) for w in content.split()]

    def broken(*a):
        raise KeyError("whole")

    tables, errors = X.extract_alone(files, {**X.EXTRACTORS, "words": X.per_file(words, "word string, size int"), "broken": broken})
    assert set(tables) == {*X.EXTRACTORS, "words"} and [tuple(r) for r in tables["words"].collect()] == [("a.js", "go();", 5)]
    assert {(n, r["file"], r["error"]) for n, d in errors.items() for r in d.collect()} == {("words", "b.js", "ValueError: no such code"), ("broken", None, "KeyError: 'whole'")}
    counts = {r["extractor"]: (r["rows"], r["errors"]) for r in X.extractor_counts(tables, errors).collect()}
    assert counts["calls"] == (1, 0) and counts["words"] == (1, 1) and counts["broken"] == (0, 1)


def test_facts_through_the_collector(spark):
    from spanweave.operators.facts import collect_all

    files = spark.createDataFrame([("a.js", "function f() { g(1); g(2); fetch('/x'); }\nfunction f() {}\nfetch('');\n")], "path string, content string")
    t = X.extract_all(files)
    t["calls"] = X.with_callees(t["calls"], t["functions"], t["imports"], t["exports"])
    none = t["routes"].limit(0).unionByName(spark.createDataFrame([("a.js", "GET")], "file string, method string"), allowMissingColumns=True)
    facts, errors = collect_all({**t, "routes": none})
    assert {k: d.count() for k, d in facts.items()} == {"functions": 2, "imports": 0, "exports": 0, "calls": 3, "api_calls": 1, "routes": 0, "ui_events": 0}
    assert {(r["category"], r["file"], r["reason"]) for r in errors.collect()} == {("routes", "a.js", "missing path"), ("api_calls", "a.js", "missing url")}
