"""Plans whose tasks stay small as tables grow, and the odd rows that they must still get right."""

import duckdb
from oracle import rows

from spanweave.operators.resolve import resolve_functions
from spanweave.plans import catalogue
from spanweave.session import ROWS_A_TASK, tasks_of


def test_functions_are_reduced_before_they_get_keys(spark):
    functions = spark.range(1000).selectExpr("id", "if(id < 0, 'b', 'a.f') AS name", "concat('src/m', id % 2, '/x.js') AS file", "0 AS file_ord", "id AS row_ord")
    refs = spark.createDataFrame([("1", "f", "src/m1/x.js"), ("2", "a.f", "src/m1/y.js"), ("3", "a.f", None), ("4", "g", "src/m1/x.js")], "ref_id string, name string, caller_file string")
    found = resolve_functions(refs, functions)
    assert {r["ref_id"]: (r["function_id"], r["rank"]) for r in found.collect()} == {"1": (1, 6), "2": (1, 3), "3": (0, 4), "4": (None, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Each explosion of the functions lies above an aggregation of them, so a task's sort holds names and files, not functions.
    assert "count(1)" in plan and plan.index("explode(transform(sequence") < plan.index("count(1)")


def test_references_with_repeated_lines_and_parts(spark, tmp_path):
    d = str(tmp_path)
    lines = [(o, n, p) for o in range(40) for n in range(1, 5) for p in (1, 2, 3) if (o + n + p) % 2] * 2 + [(50, 1, None), (51, 2, 9)]
    parts = [(1, "B#1", "STEEL X", 7), (1, "B#1", "STEEL X", 7), (1, "B#1", "BRASS Y", 7), (2, "B#2", "TIN Z", 7), (3, "B#2", "TIN Z", 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size long").write.parquet(f"{d}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    want = con.sql("""SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ref_id, (CASE l_linenumber % 2 WHEN 0 THEN string_split(p_type, ' ')[1] || '.' ELSE '' END) || p_brand AS name,
        'src/' || lower(p_brand) || '/' || (p_size + l_linenumber % 3) || '.js' AS caller_file FROM lineitem JOIN part ON l_partkey = p_partkey""")
    got = catalogue._references(spark, d)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_shuffles_grow_with_the_table(spark):
    assert tasks_of(spark.range(10)) == spark.sparkContext.defaultParallelism
    assert tasks_of(spark.range(20 * ROWS_A_TASK)) == 20


def test_targets_are_looked_up_once(spark):
    from spanweave.operators.resolve import link_functions

    functions = spark.createDataFrame([("p1", "a.f", "x.js", 0, 1), ("p2", "g", "y.js", 0, 2)], "id string, name string, file string, file_ord int, row_ord int")
    refs = spark.createDataFrame([("1", "p1"), ("1", "p2"), ("2", "p1"), ("3", None), ("4", "none"), ("5", "y.js::g"), ("6", "z.f")], "ref_id string, target string")
    found = link_functions(refs, functions)
    got = sorted((r["ref_id"], r["target"] or "", r["function_id"], r["rank"]) for r in found.collect())
    # Rows that share a ref_id each have their own target's function.
    assert got == [("1", "p1", "p1", 0), ("1", "p2", "p2", 0), ("2", "p1", "p1", 0), ("3", "", None, None), ("4", "none", None, None), ("5", "y.js::g", "p2", 1), ("6", "z.f", "p1", 2)]
