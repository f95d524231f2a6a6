"""Telemetry as keyed state of the stream itself: the latest traces, route metrics and the one-shot root survive restarts.

State lies in the query's checkpoint and is committed with its batch: a batch that fails and runs again starts from
the state before it and gives the same rows. The state store must be RocksDB (use_state_store).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from spanweave.functions.scalars import DEFAULT_DEPTH, health, is_noise


def use_state_store(spark: SparkSession) -> None:
    """The state store that these operators need, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _firsts(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first span of each trace in a task's batch, so that one task sees traces and no spans."""
    for f in frames:
        yield f.sort_values(["start_ns", "span_id"], kind="stable").drop_duplicates("trace_id")


class _Latest(StatefulProcessor):
    """cap trace ids by arrival, in one state: no more than cap ids, and cap new ones of a batch, are held."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "trace_id string", "arrived long")
        self.arrived = handle.getValueState("arrived", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = {k[0]: v[0] for k, v in self.kept.iterator()}
        first: dict[str, tuple[int, str]] = {}
        for f in rows:
            for trace, start, span in zip(f["trace_id"], f["start_ns"], f["span_id"], strict=True):
                if trace not in kept:
                    first[trace] = min(first.get(trace, (start, span)), (start, span))
        n = self.arrived.get()[0] if self.arrived.exists() else 0
        new = heapq.nlargest(self.cap, ((at, trace) for trace, at in first.items()))[::-1]
        skipped = len(first) - len(new)  # come and gone within the batch
        numbered = [(trace, n + skipped + i) for i, (_, trace) in enumerate(new, 1)]
        gone = sorted(kept, key=kept.get)[: max(0, len(kept) + len(first) - self.cap)]
        for trace in gone:
            self.kept.removeKey((trace,))
        for trace, at in numbered:
            self.kept.updateValue((trace,), (at,))
        self.arrived.update((n + len(first),))
        changes = [(t, False, n + len(first)) for t in gone] + [(t, True, at) for t, at in numbered]
        yield pd.DataFrame(changes, columns=["trace_id", "kept", "at"])

    def close(self) -> None:
        pass


def latest_traces(spans: DataFrame, cap: int = 1000) -> DataFrame:
    """A stream of (trace_id, kept, at): which traces come and go as the cap latest are kept, by the arrival of their first spans.

    Arrival goes by batch, then by start_ns and span_id. A trace that has gone is a new one when it goes on. Spans
    are reduced to a row a trace in their tasks; the one task with the state holds cap ids. Null ids take no part.
    """
    seen = spans.where("trace_id is not null").select("trace_id", F.coalesce("start_ns", F.lit(0).cast("long")).alias("start_ns"), F.coalesce("span_id", F.lit("")).alias("span_id"))
    firsts = seen.mapInPandas(_firsts, seen.schema).withColumn("_all", F.lit(0))
    return firsts.groupBy("_all").transformWithStateInPandas(_Latest(cap), "trace_id string, kept boolean, at long", "Update", "None")


def kept_now(changes: DataFrame) -> DataFrame:
    """(trace_id, at) of the traces that a table of latest_traces' rows leaves kept."""
    last = changes.groupBy("trace_id").agg(F.max_by("kept", "at").alias("kept"), F.max("at").alias("at"))
    return last.where("kept").drop("kept")


def _partial(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of each route in a task's batch, so that a hot route is a few rows of its state's task."""
    for f in frames:
        f = f.sort_values(["start_ns", "span_id"], kind="stable")
        g = f.groupby("metric_key", sort=False)
        out = g.agg(hits=("us", "size"), total_us=("us", "sum")).join(g.tail(1).set_index("metric_key").rename(columns={"us": "last_us"}))
        yield out.reset_index()[["metric_key", "hits", "total_us", "start_ns", "span_id", "last_us", "trace_id"]]


class _Totals(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "hits long, total_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hits, total = self.totals.get() if self.totals.exists() else (0, 0)
        last: tuple | None = None
        for f in rows:
            hits, total = hits + int(f["hits"].sum()), total + int(f["total_us"].sum())
            ends = zip(f["start_ns"], f["span_id"], f["last_us"], f["trace_id"], strict=True)
            last = max([*([last] if last else []), *ends], key=lambda x: x[:2])
        self.totals.update((hits, total))
        yield pd.DataFrame({"metric_key": [key[0]], "hits": [hits], "average_ms": [total / hits / 1000], "last_ms": [last[2] / 1000], "latest_trace": [last[3]]})

    def close(self) -> None:
        pass


def live_metrics(spans: DataFrame) -> DataFrame:
    """A stream of (metric_key, hits, average_ms, last_ms, latest_trace, status): each route's metrics whenever it is hit.

    As operators.spans.route_metrics over all spans so far, the last span by batch, then by start_ns and span_id.
    Spans without a method, a route or one of their times take no part.
    """
    us = F.round((F.col("end_ns") - F.col("start_ns")) / 1000).cast("long")
    hits = spans.where("method is not null and route is not null and start_ns is not null and end_ns is not null")
    hits = hits.select(F.concat_ws(":", F.upper("method"), "route").alias("metric_key"), us.alias("us"), "start_ns", F.coalesce("span_id", F.lit("")).alias("span_id"), "trace_id")
    sums = hits.mapInPandas(_partial, "metric_key string, hits long, total_us long, start_ns long, span_id string, last_us long, trace_id string")
    out = sums.groupBy("metric_key").transformWithStateInPandas(_Totals(), "metric_key string, hits long, average_ms double, last_ms double, latest_trace string", "Update", "None")
    return out.withColumn("status", health(F.col("average_ms")))


def _two_traces(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All commands, and the first possible roots of two traces: one of them may have been handled."""
    for f in frames:
        roots = f[f["command"].isna()].sort_values(["start_ns", "span_id"], kind="stable").drop_duplicates("trace_id").head(2)
        yield pd.concat([f[f["command"].notna()], roots]) if len(roots) else f[f["command"].notna()]


class _Root(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("waiting", "armed boolean, direction string, depth int, handled string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        armed, direction, depth, handled = self.state.get() if self.state.exists() else (False, "forward", DEFAULT_DEPTH, None)
        commands, found = [], None
        for f in rows:
            for r in f.itertuples(index=False):
                if r.command is not None and r.command == r.command:
                    commands.append(r)
                elif found is None or (r.start_ns, r.span_id) < (found[0].start_ns, found[0].span_id):
                    found = [r, *(x for x in found or [] if x.trace_id != r.trace_id)][:2]
                elif len(found) < 2 and r.trace_id != found[0].trace_id or len(found) == 2 and r.trace_id != found[0].trace_id and (r.start_ns, r.span_id) < (found[1].start_ns, found[1].span_id):
                    found = [found[0], r]
        for c in sorted(commands, key=lambda c: c.start_ns):
            armed, direction, depth, handled = (True, c.direction, int(c.depth), handled) if c.command == "arm" else (False, direction, depth, None)
        root = next((r for r in found or [] if r.trace_id != handled), None) if armed else None
        if root is not None:
            armed, handled = False, root.trace_id
        self.state.update((armed, direction, depth, handled))
        out = [] if root is None else [(root.root_name, bool(root.is_route), root.trace_id, root.file, root.line, direction, depth)]
        yield pd.DataFrame(out, columns=["root_name", "is_route", "trace_id", "file", "line", "direction", "depth"])

    def close(self) -> None:
        pass


def one_shot_roots(spans: DataFrame, commands: DataFrame) -> DataFrame:
    """A stream of (root_name, is_route, trace_id, file, line, direction, depth): one root after each command to wait for one.

    commands: a stream of (at long, command, direction, depth), arm or reset; those of a batch count before its spans,
    in the order of at. A root is the batch's first span that isn't noise and has a static place or a route, of a
    trace other than the one handled last; reset forgets that one. A batch that runs again gives the same root.
    """
    static = F.coalesce((F.col("file") != "") & ~F.col("line").cast("string").isin("", "0"), F.lit(False))
    route = F.coalesce(F.col("method").isNotNull() & (F.col("route") != "/*"), F.lit(False))
    name = F.when(static, F.coalesce("function", "name")).otherwise(F.concat_ws(" ", "method", "route"))
    none = lambda t: F.lit(None).cast(t)
    order = [F.coalesce("start_ns", F.lit(0).cast("long")).alias("start_ns"), F.coalesce("span_id", F.lit("")).alias("span_id")]
    able = spans.where(~F.coalesce(is_noise(F.col("name")), F.lit(False)) & (static | route) & F.col("trace_id").isNotNull())
    able = able.select(none("string").alias("command"), none("string").alias("direction"), none("int").alias("depth"), *order, "trace_id", name.alias("root_name"), (~static).alias("is_route"), "file", F.col("line").cast("string").alias("line"))
    told = commands.select("command", F.coalesce("direction", F.lit("forward")).alias("direction"), F.coalesce("depth", F.lit(DEFAULT_DEPTH)).cast("int").alias("depth"), F.col("at").alias("start_ns"), F.lit("").alias("span_id"), *[none(t).alias(c) for c, t in (("trace_id", "string"), ("root_name", "string"), ("is_route", "boolean"), ("file", "string"), ("line", "string"))])
    both = told.unionByName(able)
    few = both.mapInPandas(_two_traces, both.schema).withColumn("_all", F.lit(0))
    return few.groupBy("_all").transformWithStateInPandas(_Root(), "root_name string, is_route boolean, trace_id string, file string, line string, direction string, depth int", "Update", "None")


def latest_answers(answers: DataFrame, late: str = "10 minutes") -> DataFrame:
    """answers(request, client, asked_at, ...) of which each request's first copy within the watermark stays; see newest()."""
    return answers.withWatermark("asked_at", late).dropDuplicatesWithinWatermark(["client", "request"])


def newest(answers: DataFrame) -> DataFrame:
    """The answer to each client's latest request, whatever order answers came in: a late older one replaces nothing."""
    latest = Window.partitionBy("client").orderBy(F.desc("asked_at"), F.desc("request"))
    return answers.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
