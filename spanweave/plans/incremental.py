"""Call resolution that is kept between runs: only changed files are read again, and only references that they touch are resolved again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators.checkpoints import cut
from spanweave.operators.linker import callers
from spanweave.operators.resolve import resolve_functions
from spanweave.session import tasks_of
from spanweave.sources.extract import code_tokens, extract_calls, extract_functions

_CALLS = ["ref_id", "file", "start_line", "pos", "callee", "name", "from"]
_FUNCTIONS = ["id", "name", "file", "start_line", "end_line"]


def _suffixes(name: Column) -> Column:
    """Every name that a reference can have for a function: the whole one and its dotted ends."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _placed(functions: DataFrame) -> DataFrame:
    return functions.select("id", "name", "file", F.col("file").alias("file_ord"), F.col("start_line").alias("row_ord"))


def refresh(before: DataFrame, refs: DataFrame, old: DataFrame, new: DataFrame, changed: DataFrame, tasks: int | None = None) -> DataFrame:
    """refs(ref_id, name, caller_file) with function_id, rank and recomputed, as resolve_functions over the new functions gives them.

    before: (ref_id, function_id, rank) of the last time; old, new: functions; changed(file): files edited, added or
    gone. A reference's result depends on its own place and on the functions that its name can mean. So those in
    changed files, and those whose name a function of a changed file has or had, are resolved again, against the
    functions of these names only; the others keep what they had. tasks: in how many tasks the others meet it.
    """
    moved = lambda d: d.join(changed, "file", "left_semi").select(F.explode(_suffixes(F.col("name"))).alias("name"))
    touched = cut(moved(old).unionByName(moved(new)).distinct())
    keyed = refs.withColumn("file", F.col("caller_file"))
    again = keyed.join(changed, "file", "left_semi").unionByName(keyed.join(changed, "file", "left_anti").join(touched, "name", "left_semi").select(*keyed.columns))
    again = cut(again.select(*refs.columns))
    asked = again.select("name").distinct()
    able = new.withColumn("_any", F.explode(_suffixes(F.col("name")))).join(asked.withColumnRenamed("name", "_any"), "_any", "left_semi").drop("_any").distinct()
    found = resolve_functions(again, able).withColumn("recomputed", F.lit(True))
    same = keyed.join(changed, "file", "left_anti").join(touched, "name", "left_anti").select(*refs.columns)
    had = before.select("ref_id", "function_id", "rank")
    if tasks:
        same, had = same.repartition(tasks, "ref_id"), had.repartition(tasks, "ref_id")
    same = same.join(had, "ref_id", "left")
    return found.unionByName(same.withColumn("recomputed", F.lit(False)))


@dataclass
class CallIndex:
    """The functions, calls and resolved callees of a source tree as tables in a shared folder; an update is a folder of its own."""

    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def functions(self) -> DataFrame:
        return self._table("functions")

    @property
    def resolved(self) -> DataFrame:
        """(ref_id, name, caller_file, function_id, rank, recomputed) of every call."""
        return self._table("resolved")

    def edges(self) -> DataFrame:
        """(src, dst): the function around a call and the one called."""
        d = self._table("calls").join(self.resolved.where("function_id is not null").select("ref_id", "function_id"), "ref_id")
        return callers(d, _placed(self.functions)).where("caller_id is not null").select(F.col("caller_id").alias("src"), F.col("function_id").alias("dst")).distinct()

    @staticmethod
    def build(files: DataFrame, into: str) -> CallIndex:
        """The index of files(path, content)."""
        return CallIndex(files.sparkSession, into)._write(files, None)

    def update(self, files: DataFrame, into: str) -> CallIndex:
        """The index of the files as they are now, equal to one built anew."""
        return CallIndex(self.spark, into)._write(files, self)

    def _write(self, files: DataFrame, last: CallIndex | None) -> CallIndex:
        save = lambda d, name: d.write.mode("overwrite").parquet(f"{self.path}/{name}")
        save(files.select(F.col("path").alias("file"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash")), "hashes")
        now = self._table("hashes")
        if last is None:
            changed = now.select("file")
        else:
            was = last._table("hashes").withColumnRenamed("hash", "was")
            changed = now.join(was, "file", "full").where(~F.col("hash").eqNullSafe(F.col("was"))).select("file")
        changed = cut(changed)
        read = cut(files.join(changed.select(F.col("file").alias("path")), "path", "left_semi"))
        found = code_tokens(read)
        functions = cut(extract_functions(read, found=found))
        calls = extract_calls(read, functions, found=found).withColumn("ref_id", F.concat_ws(":", "file", "start_line", "pos", "callee"))
        kept = lambda name, d, columns: d.select(*columns) if last is None else d.select(*columns).unionByName(last._table(name).join(changed, "file", "left_anti").select(*columns))
        save(kept("functions", functions, _FUNCTIONS), "functions")
        save(kept("calls", calls, _CALLS), "calls")
        refs = self._table("calls").select("ref_id", "name", F.col("file").alias("caller_file"))
        tasks = tasks_of(self._table("calls"))
        none = refs.limit(0).select("ref_id", F.lit(None).cast("string").alias("function_id"), F.lit(None).cast("int").alias("rank"))
        old = _placed(self.functions).limit(0) if last is None else _placed(last.functions)
        save(refresh(none if last is None else last.resolved, refs, old, _placed(self.functions), changed, tasks), "resolved")
        return self
