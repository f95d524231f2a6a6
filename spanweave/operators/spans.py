"""Trace spans in batch: flattening, route metrics, trace summaries, waterfalls and root detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.functions.scalars import health, is_noise
from spanweave.operators.checkpoints import cut

SPANS = """resourceSpans array<struct<scopeSpans array<struct<spans array<struct<traceId string, spanId string, parentSpanId string, name string, startTimeUnixNano string, endTimeUnixNano string,
 attributes array<struct<key string, value struct<stringValue string, intValue string, boolValue boolean>>>>>>>>>"""


def attributes_map(attributes: Column) -> Column:
    """map<string, string> of key and value pairs; the last of a key wins, values of other kinds are null."""
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"))
    keys = F.array_distinct(F.transform(attributes, lambda a: a["key"]))
    last = lambda k: F.element_at(F.filter(attributes, lambda a: a["key"] == k), -1)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: value(last(k)["value"])))


def flatten_otlp(bodies: DataFrame, column: str = "value") -> DataFrame:
    """Flat spans of JSON bodies: (trace_id, span_id, parent_span_id, name, start_ns, end_ns, attributes)."""
    body = F.from_json(column, SPANS)
    s = bodies.select(F.explode(body["resourceSpans"]).alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("x"))
    return s.select(
        F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.nullif("x.parentSpanId", F.lit("")).alias("parent_span_id"), F.col("x.name").alias("name"),
        F.col("x.startTimeUnixNano").cast("long").alias("start_ns"), F.col("x.endTimeUnixNano").cast("long").alias("end_ns"), attributes_map(F.coalesce("x.attributes", F.array().cast("array<struct<key:string,value:struct<stringValue:string,intValue:string,boolValue:boolean>>>"))).alias("attributes"),
    )


def with_static(spans: DataFrame, prefix: str = "static") -> DataFrame:
    """spans with method, route, file, line and function taken from the attributes."""
    a = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("attributes", F.lit(n)), F.lit("")) for n in names])
    return spans.withColumns({"method": a("http.method"), "route": a("http.route", "http.target", "http.url"), "file": a(f"{prefix}.file"), "line": a(f"{prefix}.line"), "function": a(f"{prefix}.function")})


def route_metrics(spans: DataFrame, order: list[str]) -> DataFrame:
    """(metric_key, hits, average_ms, last_ms, latest_trace, status) of spans(method, route, duration_ms, trace_id).

    Durations are summed as whole microseconds, so that the mean doesn't depend on the order of addition.
    """
    at = F.struct(*order)
    key = F.concat_ws(":", F.upper("method"), "route")
    d = spans.where("method is not null and route is not null").groupBy(key.alias("metric_key")).agg(
        F.count("*").alias("hits"), (F.sum(F.round(F.col("duration_ms") * 1000).cast("long")) / F.count("*") / 1000).alias("average_ms"), F.max_by("duration_ms", at).alias("last_ms"), F.max_by("trace_id", at).alias("latest_trace")
    )
    return d.withColumn("status", health(F.col("average_ms")))


def running_metrics(spans: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """spans with hits and mean_cents so far in their key.

    Spans are sorted by key and order into ranges, of which a frequent key has many; what a key has in the ranges
    before is added to its running sums within one, so that no task holds a whole key. A null key is a key; a null
    value counts as a hit and adds nothing.
    """
    ranged = cut(spans.withColumn("_cents", F.round(F.col(value) * 100).cast("long")).repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.sum("_cents").alias("_s"))
    totals = totals.select("_k", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.sum("_s").over(before).alias("_s0"))
    w = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = ranged.withColumn("_n1", F.count("*").over(w)).withColumn("_s1", F.sum("_cents").over(w))
    d = d.join(totals, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    hits, cents = F.col("_n0") + F.col("_n1"), F.coalesce(F.col("_s0") + F.col("_s1"), "_s1", "_s0")
    return d.withColumn("hits", hits).withColumn("mean_cents", cents / hits).drop("_cents", "_part", "_k", "_p", "_n0", "_s0", "_n1", "_s1")


def trace_summaries(spans: DataFrame, order: list[str]) -> DataFrame:
    """(trace_id, name, start, span_count): named after the first span without a parent, else the first span."""
    at = F.struct(*order)
    root = F.when(F.col("parent_span_id").isNull(), at)
    first = lambda c: F.coalesce(F.min_by(c, root), F.min_by(c, at))
    return spans.groupBy("trace_id").agg(F.coalesce(first("name"), F.lit("Unknown")).alias("name"), first("start").alias("start"), F.count("*").alias("span_count"))


def spans_of(spans: DataFrame, trace_id: object) -> DataFrame:
    return spans.where(F.col("trace_id") == F.lit(trace_id))


def waterfall(spans: DataFrame, batch: str, start: str, unit: int = 1_000_000) -> DataFrame:
    """spans with offset_ms since the first start of their batch."""
    firsts = spans.groupBy(batch).agg(F.min(start).alias("_first"))
    return spans.join(firsts, batch).withColumn("offset_ms", (F.col(start) - F.col("_first")) / unit).drop("_first")


def pulse_delays(pulses: DataFrame, batch: str, order: list[str], gap_ms: int = 100) -> DataFrame:
    """pulses(offset_ms) with delay_ms: the offset and gap_ms for each pulse before it in its batch."""
    at = F.row_number().over(Window.partitionBy(batch).orderBy("offset_ms", *order)) - 1
    return pulses.withColumn("delay_ms", F.col("offset_ms") + gap_ms * at)


def keep_latest_traces(spans: DataFrame, order: list[str], cap: int = 1000) -> DataFrame:
    """Spans of the cap traces that arrived last, by each trace's first span."""
    first = spans.groupBy("trace_id").agg(F.min(F.struct(*order)).alias("_first"))
    return spans.join(F.broadcast(first.orderBy(F.desc("_first"), F.desc("trace_id")).limit(cap).select("trace_id")), "trace_id", "left_semi")


def root_candidates(spans: DataFrame, batch: str, order: list[str], handled: str | None = None) -> DataFrame:
    """The first span of each batch that can be a root: not noise, not of the handled trace, with file and line or with method and route."""
    static = F.col("file").isNotNull() & (F.col("file") != "") & F.col("line").isNotNull() & ~F.col("line").cast("string").isin("", "0")
    route = F.col("method").isNotNull() & F.col("route").isNotNull() & (F.col("route") != "/*")
    d = spans.where(~F.coalesce(is_noise(F.col("name")), F.lit(False)) & (static | route))
    if handled is not None:
        d = d.where(~F.col("trace_id").eqNullSafe(F.lit(handled)))
    name = F.when(static, F.coalesce("function", "name")).otherwise(F.concat_ws(" ", "method", "route"))
    return d.withColumn("root_name", name).withColumn("is_route", ~static).groupBy(batch).agg(F.min_by(F.struct("root_name", "is_route", "trace_id", "file", "line"), F.struct(*order)).alias("r")).select(batch, "r.*")
