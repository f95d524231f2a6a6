"""Answers of unknown shape, and lines in a snippet."""

import json

from pyspark.sql import functions as F

from spanweave.functions.answers import FAILED, NO_SUMMARY, UNREACHABLE, answer_parts, relative_line


def test_answer_parts(spark):
    good = lambda x: {"success": True, "explanation": x}
    cases = [
        (good("plain"), True, ("plain", [], [])),
        (good(""), True, ("", [], [])),
        (good({"explanation": "a", "purpose": "b", "steps": ["s", 1], "details": ["d"]}), True, ("a", ["s", "1"], [])),
        (good({"explanation": {"x": 1}, "purpose": "b", "steps": "s", "details": ["d", {"k": [1]}], "calls": ["c"]}), True, ("b", ["d", '{"k":[1]}'], ["c"])),
        (good({"purpose": 3, "calls": None}), True, (NO_SUMMARY, [], [])),
        (good(None), True, (NO_SUMMARY, [], [])),
        (good(["x"]), True, (NO_SUMMARY, [], [])),
        ({"explanation": "no success"}, True, (FAILED, [], [])),
        ({"success": "", "error": "why"}, True, ("why", [], [])),
        ({"success": 0, "error": ""}, True, (FAILED, [], [])),
        ({"success": {}, "explanation": "an object is true"}, True, ("an object is true", [], [])),
        ({"success": 0.5, "explanation": "x"}, True, ("x", [], [])),
        (good({"purpose": "p", "steps": ["s"]}), False, (FAILED, [], [])),
        (good("x"), None, (FAILED, [], [])),
        (None, True, (FAILED, [], [])),
        ([1], True, (FAILED, [], [])),
    ]
    rows = [(i, json.dumps(body), ok) for i, (body, ok, _) in enumerate(cases)] + [(100, "{", True), (101, "", True), (102, None, True)]
    d = spark.createDataFrame(rows, "i int, body string, ok boolean")
    got = {r["i"]: (r["a"]["purpose"], r["a"]["details"], r["a"]["calls"]) for r in d.select("i", answer_parts(F.col("body"), F.col("ok")).alias("a")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)} | {i: (UNREACHABLE, [], []) for i in (100, 101, 102)}


def test_relative_line(spark):
    d = spark.createDataFrame([(12, 10), (10, 10), (3, 10)], "line int, start int")
    assert [r[0] for r in d.select(relative_line(F.col("line"), F.col("start"))).collect()] == [3, 1, 1]
