"""Telemetry as a stream: micro-batches of OTLP JSON give metrics, one root and waterfall pulses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanweave.functions.scalars import DEFAULT_DEPTH, live_node_id
from spanweave.operators.graph import numeric_graph
from spanweave.operators.spans import flatten_otlp, keep_latest_traces, root_candidates, route_metrics, trace_summaries, waterfall, with_static
from spanweave.sources.files import graph_json

Sink = Callable[[str, DataFrame], None]
#: From a root (root_name, is_route, trace_id, file, line), a direction and a depth to (nodes, edges) of its flow.
Trace = Callable[[dict, str, int], tuple[DataFrame, DataFrame]]


def json_bodies(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of request bodies: each new file below path is a text of one body."""
    return spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).text(path)


class Log(Protocol):
    """Where a stream's messages are kept for clients, as clients.MessageLog does."""

    def sink(self, number: int, onward: Sink) -> Sink: ...

    def commit(self, number: int) -> None: ...


@dataclass
class Session:
    """State between micro-batches: whether a root is waited for, and the trace that was handled last."""

    direction: str = "forward"
    depth: int = DEFAULT_DEPTH
    armed: bool = False
    handled: str | None = None
    roots: list[dict] = field(default_factory=list)

    def arm(self, direction: str = "forward", depth: int = DEFAULT_DEPTH) -> None:
        self.direction, self.depth, self.armed = direction, depth, True

    def reset(self) -> None:
        self.armed, self.handled = False, None
        self.roots.clear()

    def detect(self, spans: DataFrame) -> dict | None:
        """The batch's root, if one is waited for: at most one row comes to the driver, then the session is disarmed."""
        if not self.armed:
            return None
        found = root_candidates(spans.withColumn("_batch", F.lit(1)), "_batch", ["start_ns", "span_id"], self.handled).drop("_batch").head()
        if found is None:
            return None
        root = found.asDict()
        self.armed, self.handled = False, root["trace_id"]
        self.roots.append(root)
        return root


def pulses(spans: DataFrame) -> DataFrame:
    """(node_id, name, duration_ms, offset_ms, method, route) of spans with a static place, by offset since the batch's first."""
    placed = spans.where(F.col("file").isNotNull() & F.col("line").isNotNull() & ~F.col("line").isin("", "0")).withColumn("_batch", F.lit(1))
    d = waterfall(placed, "_batch", "start_ns")
    return d.select(
        F.concat_ws(":", "file", "line").alias("node_id"), F.coalesce("function", "name").alias("name"), F.round((F.col("end_ns") - F.col("start_ns")) / 1_000_000, 2).alias("duration_ms"), "offset_ms", "method", "route"
    ).orderBy("offset_ms", "node_id")


@dataclass
class TraceStore:
    """Spans of a stream's batches as a table in a shared folder, of which the cap traces that arrived last are kept.

    A batch that is run again replaces itself. An evicted trace that goes on stays evicted until compact() has
    dropped its rows; after that its next span makes it a new one. Route metrics count every span ever stored, so
    compact() keeps what metrics need and drops the rest of evicted traces.
    """

    spark: SparkSession
    path: str
    cap: int = 1000

    def add(self, spans: DataFrame, batch: int) -> None:
        spans.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _all(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")

    def spans(self) -> DataFrame:
        """The spans of the traces kept, with the batch in which they came."""
        return keep_latest_traces(self._all().where("attributes is not null"), ["batch", "start_ns", "span_id"], self.cap)

    def summaries(self) -> DataFrame:
        return trace_summaries(self.spans().withColumn("start", F.col("start_ns")), ["batch", "start_ns", "span_id"])

    def metrics(self) -> DataFrame:
        ms = (F.col("end_ns") - F.col("start_ns")) / 1_000_000
        return route_metrics(self._all().withColumn("duration_ms", ms), ["batch", "start_ns", "span_id"])

    def compact(self, into: str) -> TraceStore:
        """A store in another folder: the traces kept whole; of other spans with a route what metrics need, without attributes."""
        kept = self.spans()
        rest = self._all().where("method is not null and route is not null").join(kept.select("trace_id").distinct(), "trace_id", "left_anti")
        needed = ["trace_id", "span_id", "method", "route", "start_ns", "end_ns", "batch"]
        kept.unionByName(rest.select(*needed), allowMissingColumns=True).write.partitionBy("batch").mode("overwrite").parquet(into)
        return TraceStore(self.spark, into, self.cap)


def live_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json) of a flow's nodes(node, depth, label, type, file, start_line) and edges(src, dst), numbered from 0 by distance and then by node.

    A node's live_id is what pulses have as node_id.
    """
    d = nodes.dropDuplicates(["node"])
    numbered, links = numeric_graph(d.select("node", F.col("depth").alias("ord")), edges.select("src", "dst").distinct())
    own = live_node_id(F.col("file"), F.col("start_line"), F.col("node"))
    return graph_json(d.join(numbered, "node").select(F.col("num").alias("id"), "label", "type", "file", "start_line", own.alias("live_id")), links)


def start(bodies: DataFrame, session: Session, sink: Sink, checkpoint: str, trace: Trace | None = None, store: TraceStore | None = None, prefix: str = "static", log: Log | None = None) -> StreamingQuery:
    """Run bodies(value) through a session; sink gets ("spans" | "root" | "graph" | "pulse_batch", DataFrame) of each batch.

    prefix: of the attributes with a span's place (prefix.file, prefix.line, prefix.function). Where a batch fails the
    session is as it was before, so that the batch's next run finds the same root.

    With trace, a detected root is followed by its flow's graph; where tracing fails, ("graph_error", its message) is
    sent, the stream goes on and the session stays disarmed. With store, each batch's spans are added to it.
    With log, the messages are kept there as well, and shown to its clients once the whole batch is done.
    """

    def follow(spark: SparkSession, root: dict, send: Sink) -> None:
        try:
            send("graph", live_graph(*trace(root, session.direction, session.depth)))
        except Exception as e:
            send("graph_error", spark.createDataFrame([(root["root_name"], str(e)[:500])], "root_name string, error string"))

    def batch(df: DataFrame, number: int) -> None:
        spans = with_static(flatten_otlp(df), prefix).persist()
        send = sink if log is None else log.sink(number, sink)
        before = (session.armed, session.handled, list(session.roots))
        try:
            if store is not None:
                store.add(spans, number)
            send("spans", spans)
            root = session.detect(spans)
            if root is not None:
                send("root", df.sparkSession.createDataFrame([(root["root_name"], root["is_route"], root["trace_id"])], "root_name string, is_route boolean, trace_id string"))
                if trace is not None:
                    follow(df.sparkSession, root, send)
            send("pulse_batch", pulses(spans))
            if log is not None:
                log.commit(number)
        except Exception:
            session.armed, session.handled, session.roots[:] = before
            raise
        finally:
            spans.unpersist()

    return bodies.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def streaming_metrics(spans: DataFrame) -> DataFrame:
    """Running hits and mean of each method and route of a stream of flat spans, for output mode update or complete."""
    ms = (F.col("end_ns") - F.col("start_ns")) / 1_000_000
    return spans.where("method is not null and route is not null").groupBy(F.concat_ws(":", F.upper("method"), "route").alias("metric_key")).agg(F.count("*").alias("hits"), F.avg(ms).alias("average_ms"))


def windowed_hits(spans: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Hits of each route in event-time windows; spans later than the watermark are left out."""
    timed = spans.withColumn("at", F.timestamp_micros((F.col("start_ns") / 1000).cast("long"))).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "route").agg(F.count("*").alias("hits"))
