"""Points in intervals by one sorted sweep: no point meets all intervals of its group."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SWEEP = ["_group", "_pos", "_kind", "_end", "_rank", "_name"]


def _stabbed(inner: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of a group's intervals and points in order; open intervals wait in order of their starts.

    What has ended goes when it is met at the end that is asked for, so each interval comes and goes once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, open_ = None, deque()
        side, drop = (-1, open_.pop) if inner else (0, open_.popleft)
        for b in batches:
            rows, hits = [], []
            for i, (g, pos, kind, end, name) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_group", "_pos", "_kind", "_end", "_name")), strict=True)):
                if g != group:
                    group = g
                    open_.clear()
                if kind == 1:
                    open_.append((pos, end, name))
                    continue
                while open_ and open_[side][1] < pos:
                    drop()
                rows.append(i)
                hits.append(open_[side] if open_ else (None, None, None))
            if rows:
                kept = b.take(pa.array(rows))
                own = [kept.column(n) for n in kept.schema.names if n not in _SWEEP]
                start, end, name = zip(*hits, strict=True)
                yield pa.RecordBatch.from_arrays([*own, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(name, pa.string())], names=[*[n for n in kept.schema.names if n not in _SWEEP], "hit_start", "hit_end", "hit_name"])

    return run


def stab(points: DataFrame, intervals: DataFrame, group: str, at: str, start: str, end: str, name: str | Column, innermost: bool = True, strictly: bool = False) -> DataFrame:
    """points(group, at) with hit_start, hit_end and hit_name of the innermost, or outermost, of intervals(group, start, end, name) around at.

    Both ends belong to an interval, but its start doesn't where strictly. Innermost: the largest start, then the
    smallest end, then the largest name; outermost: the smallest start, then the largest end. A point in none has nulls.
    Intervals may cross. Both sides are sorted by group and place; a task holds the intervals that are open, no group.
    """
    none = lambda t: F.lit(None).cast(t)
    p = points.select("*", F.col(group).alias("_group"), F.col(at).cast("long").alias("_pos"), F.lit(0 if strictly else 2).alias("_kind"), none("long").alias("_end"), none("long").alias("_rank"), none("string").alias("_name"))
    value = F.col(name) if isinstance(name, str) else name
    empty = [none(t).alias(c) for c, t in points.dtypes]
    v = intervals.select(*empty, F.col(group).alias("_group"), F.col(start).cast("long").alias("_pos"), F.lit(1).alias("_kind"), F.col(end).cast("long").alias("_end"), (-F.col(end).cast("long")).alias("_rank"), value.cast("string").alias("_name"))
    both = p.unionByName(v).repartition("_group").sortWithinPartitions("_group", "_pos", "_kind", "_rank", "_name")
    shape = ", ".join([*(f"`{c}` {t}" for c, t in points.dtypes), "hit_start long, hit_end long, hit_name string"])
    return both.mapInArrow(_stabbed(innermost), shape)
