"""Fact tables: validation, first-wins dedup, ordered grouping and summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The columns without which a fact of a category is an error, and the columns that identify it in its file.
REQUIRED = {"functions": ["name", "start_line"], "calls": ["callee", "start_line"], "api_calls": ["url", "start_line"], "routes": ["method", "path"], "ui_events": ["event", "start_line"], "imports": ["source"]}
IDENTITY = {"functions": ["id"], "calls": ["callee_function_id", "callee", "start_line", "end_line"], "api_calls": ["method", "normalized_url", "start_line"], "routes": ["id"], "ui_events": ["event", "start_line"], "imports": ["source", "imported_as"]}


def first_wins(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def later_rows(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The rows that first_wins leaves out, with rn from 2."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn > 1")


def split_valid(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with every required column, other rows with reason)."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    d = df.withColumn("reason", F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))))
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


def collect_facts(df: DataFrame, category: str, order: list[str] = ["row_ord"]) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(valid rows, first of each identity in its file; errors). A row without start_line takes line. Names may be in camel case."""
    snake = {c: re.sub(r"(?<=[a-z])[A-Z]", lambda m: "_" + m.group().lower(), c) for c in df.columns}
    df = df.withColumnsRenamed(snake)
    if "line" in df.columns and "start_line" in df.columns:
        df = df.withColumn("start_line", F.coalesce("start_line", "line"))
    valid, errors = split_valid(df, REQUIRED[category])
    keys: list[str | Column] = [c for c in IDENTITY[category] if c in df.columns]
    if category == "calls" and "callee_function_id" in df.columns:  # a resolved callee is one fact of its file, whatever its place
        keys = [F.coalesce("callee_function_id", F.concat_ws(":", "callee", "start_line", "end_line"))]
    back = {v: k for k, v in snake.items()}
    return first_wins(valid, ["file", *keys], order).withColumnsRenamed(back), errors.withColumnsRenamed(back)


def collect_all(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables of valid facts, each once in its file; errors(category, file, entry, reason)) of the extractors' tables; other categories go through."""
    out, errors = dict(tables), None
    for category in REQUIRED:
        if category in tables:
            d = tables[category]
            place = [c for c in ("start_line", "pos", "start_seq") if c in d.columns]
            out[category], bad = collect_facts(d, category, [*place, *sorted(set(d.columns) & {"id", "name", "url", "source", "imported_as"})])
            bad = bad.select(F.lit(category).alias("category"), "file", F.to_json(F.struct(*d.columns)).alias("entry"), "reason")
            errors = bad if errors is None else errors.unionByName(bad)
    return out, errors


def summary(facts: dict[str, DataFrame]) -> DataFrame:
    """(file, category, n): facts of each file and category."""
    parts = [d.groupBy("file").agg(F.count("*").alias("n")).withColumn("category", F.lit(k)) for k, d in facts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("file", "category", "n")


def grouped(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, values): an array of the key's values in order."""
    v = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(key).agg(F.transform(v, lambda x: x["_v"]).alias("values"))


def ast_map(functions: DataFrame) -> DataFrame:
    """(key, file, line): where each file:name first stands; functions without file, name or start_line give no row. functions: (file, name, start_line)."""
    d = functions.where("file is not null and file <> '' and name is not null and name <> '' and start_line is not null")
    return d.groupBy(F.concat_ws(":", "file", "name").alias("key")).agg(F.first("file").alias("file"), F.min("start_line").alias("line"))


def located(spans: DataFrame, places: DataFrame) -> DataFrame:
    """spans(file, function) with line from places(key, line), null where the place isn't known."""
    return spans.withColumn("key", F.concat_ws(":", "file", "function")).join(places.select("key", "line"), "key", "left").drop("key")


def index_summary(files: DataFrame, functions: DataFrame, routes: DataFrame, events: DataFrame) -> DataFrame:
    """(what, n): the sizes of an index."""
    out = None
    for what, d in (("files", files), ("functions", functions), ("routes", routes), ("events", events)):
        one = d.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out
