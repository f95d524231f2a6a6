"""Source trees: scanning, lines, slices and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators.sweep import stab

#: Names that end a scan's way, and the extensions of source files.
IGNORED = ["node_modules", ".git", "dist", "build", "coverage", ".next", "out", "public", ".cache"]
EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_ord, content) of the source files below root, without ignored names and declaration files.

    file_ord orders the files: it is the path itself, which needs no global numbering.
    """
    root = root.rstrip("/")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(e[1:] for e in EXTENSIONS) + "}").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^/+", "/")
    relative = F.substr(path, F.lit(len(root) + 2))
    d = d.select(relative.alias("path"), relative.alias("file_ord"), F.decode("content", "UTF-8").alias("content"))
    return d.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))) & ~F.col("path").endswith(".d.ts"))


def lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def line_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1, both inclusive; to the last line if end is null; null where start is outside."""
    all_ = lines(content)
    last = F.coalesce(end, F.size(all_))
    inside = (start >= 1) & (start <= F.size(all_)) & (last >= start)
    return F.when(inside, F.array_join(F.slice(all_, F.when(inside, start).otherwise(1), F.when(inside, last - start + 1).otherwise(0)), "\n"))


def attach_code(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes(file, start_line, end_line) with the code of their lines."""
    return nodes.join(files.select(F.col("path").alias("file"), "content"), "file", "left").withColumn("code", line_slice(F.col("content"), F.col("start_line"), F.col("end_line"))).drop("content")


def splice(content: Column, start: Column, end: Column, new: Column) -> Column:
    """content with the characters from start to end (from 0, end exclusive) replaced."""
    return F.concat(F.substr(content, F.lit(1), start), new, F.substr(content, end + 1))


def inside_root(path: Column, root: str) -> Column:
    """Whether a path is the root or below it; a name that only begins like the root isn't."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def covering(elements: DataFrame, points: DataFrame) -> DataFrame:
    """points(file, line) with the outermost of elements(file, start_line, end_line) around the line, or the whole file (null ends); by one sweep."""
    hit = stab(points, elements, "file", "line", "start_line", "end_line", F.lit(None), innermost=False)
    return hit.withColumn("start_line", F.col("hit_start").cast("int")).withColumn("end_line", F.col("hit_end").cast("int")).drop("hit_start", "hit_end", "hit_name")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): a row for each node and edge, for a JSON sink."""
    a, b = (d.select(F.lit(k).alias("kind"), F.to_json(F.struct(*d.columns)).alias("json")) for k, d in (("node", nodes), ("edge", edges)))
    return a.unionByName(b)
