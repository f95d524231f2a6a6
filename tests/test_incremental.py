"""An index that is updated equals one built anew, and resolves no more than it must."""

from spanweave.plans.incremental import CallIndex

TREE = {f"src/m{i}.js": f"function f{i}() {{\n  f{(i + 1) % 8}();\n  shared();\n}}\n" for i in range(8)} | {"src/lib/s.js": "function shared() {\n  leaf();\n}\n", "top.js": "function leaf() {\n}\nfunction other() {\n  leaf();\n}\n"}


def rows(index):
    return sorted((r["ref_id"], r["function_id"] or "", -1 if r["rank"] is None else r["rank"]) for r in index.resolved.collect()), sorted(map(tuple, index.edges().collect())), sorted(r["id"] for r in index.functions.collect())


def test_updates_equal_full_builds(spark, tmp_path):
    tree = lambda d: spark.createDataFrame(list(d.items()), "path string, content string")
    index, now = CallIndex.build(tree(TREE), f"{tmp_path}/0"), dict(TREE)
    assert index.resolved.where("recomputed").count() == index.resolved.count() == 18
    steps = [
        ({}, [], 0),  # nothing changed
        ({"src/m3.js": "function f3() {\n\n  f4();\n}\n"}, [], 2),  # its own call and m2's of f3
        ({"lib2/leaf.js": "export const leaf = () => null;\n"}, [], 2),  # a second leaf: both calls of it
        ({}, ["src/lib/s.js"], 7),  # the calls of shared lose it
        ({"src/lib/s.js": None, "src/m0.js": "function f0() {\n  missing();\n}\n"}, ["top.js"], None),
    ]
    for n, (edits, gone, recomputed) in enumerate(steps, 1):
        now = {k: v for k, v in {**now, **edits}.items() if k not in gone}
        index = index.update(tree(now), f"{tmp_path}/{n}")
        assert rows(index) == rows(CallIndex.build(tree(now), f"{tmp_path}/full{n}")), n
        if recomputed is not None:
            assert index.resolved.where("recomputed").count() == recomputed, n
