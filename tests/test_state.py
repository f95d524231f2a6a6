"""State of streams: equal to batch results over all that arrived, across restarts and failed batches."""

import json

import pytest
from pyspark.sql import functions as F

from spanweave.operators.spans import flatten_otlp, keep_latest_traces, route_metrics, with_static
from spanweave.streaming import session as st
from spanweave.streaming import state

COMMANDS = "at long, command string, direction string, depth int"


def body(*spans):
    return json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": t, "spanId": s, "name": n, "startTimeUnixNano": str(a), "endTimeUnixNano": str(a + d), "attributes": [{"key": k, "value": {"stringValue": v}} for k, v in at.items()]} for t, s, n, a, d, at in spans]}]}]})


@pytest.fixture
def stored(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_state_store(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def spans_in(spark, folder):
    return with_static(flatten_otlp(st.json_bodies(spark, str(folder))))


def run(stream, folder, name):
    """Runs the stream over what is there and adds its rows to a table."""
    q = stream.writeStream.foreachBatch(lambda d, i: d.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/{name}/b={i}"))
    q = q.outputMode("update").option("checkpointLocation", f"{folder}/{name}-checkpoint").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_cap_and_metrics_across_restarts(stored, tmp_path):
    (tmp_path / "in").mkdir()
    web = lambda r: {"http.method": "get", "http.route": r}
    bodies = [
        [("t1", "a", "x", 10, 4_000_000, web("/x")), ("t2", "b", "y", 20, 700_000_000, web("/y")), ("t1", "c", "z", 30, 2_000_000, web("/x"))],
        [("t3", "d", "x", 5, 6_000_000, web("/x")), (None, "n", "x", 1, 1, {}), ("t4", "e", "no route", 7, 1, {})],
        [("t5", f"f{i}", "x", 100 + i, 1_000_000, web("/x")) for i in range(5)] + [("t4", "g", "x", 99, 1_000_000, {})],
    ]
    for i, spans in enumerate(bodies):
        (tmp_path / "in" / f"{i}.json").write_text(body(*spans))
        run(state.latest_traces(spans_in(stored, tmp_path / "in"), 3), tmp_path, "traces")  # a query of its own each time, from the checkpoint
        run(state.live_metrics(spans_in(stored, tmp_path / "in")), tmp_path, "metrics")
    kept = {r["trace_id"] for r in state.kept_now(stored.read.parquet(f"{tmp_path}/traces/b=*")).collect()}
    every = None
    for i in range(3):
        d = with_static(flatten_otlp(stored.read.option("wholetext", "true").text(f"{tmp_path}/in/{i}.json"))).withColumn("batch", F.lit(i))
        every = d if every is None else every.unionByName(d)
    order = ["batch", "start_ns", "span_id"]
    assert kept == {r["trace_id"] for r in keep_latest_traces(every.where("trace_id is not null"), order, 3).collect()} == {"t3", "t4", "t5"}
    rows = stored.read.parquet(f"{tmp_path}/metrics/b=*")
    last = {r["metric_key"]: r["m"].asDict() for r in rows.groupBy("metric_key").agg(F.max_by(F.struct("hits", "average_ms", "last_ms", "latest_trace", "status"), "batch").alias("m")).collect()}
    want = {r["metric_key"]: {k: r[k] for k in ("hits", "average_ms", "last_ms", "latest_trace", "status")} for r in route_metrics(every.withColumn("duration_ms", (F.col("end_ns") - F.col("start_ns")) / 1_000_000), order).collect()}
    assert last == want and rows.count() == 4


def test_more_new_traces_than_the_cap(stored, tmp_path):
    (tmp_path / "in").mkdir()
    for i, traces in enumerate((["a", "b"], ["c", "d", "e", "f"], ["a"])):
        (tmp_path / "in" / f"{i}.json").write_text(body(*[(t, t, "x", n, 1, {}) for n, t in enumerate(traces)]))
        run(state.latest_traces(spans_in(stored, tmp_path / "in"), 2), tmp_path, "traces")
    # c and d came and went within a batch; a, which had gone, is new again.
    rows = {(r["trace_id"], r["kept"], r["at"]) for r in stored.read.parquet(f"{tmp_path}/traces/b=*").collect()}
    assert rows == {("a", True, 1), ("b", True, 2), ("a", False, 6), ("b", False, 6), ("e", True, 5), ("f", True, 6), ("e", False, 7), ("a", True, 7)}
    assert {r["trace_id"] for r in state.kept_now(stored.read.parquet(f"{tmp_path}/traces/b=*")).collect()} == {"f", "a"}


def test_root_once_for_each_command(stored, tmp_path):
    for d in ("in", "told"):
        (tmp_path / d).mkdir()
    place = lambda n: {"static.file": "a.js", "static.line": str(n), "static.function": f"f{n}"}
    stream = lambda: state.one_shot_roots(spans_in(stored, tmp_path / "in"), stored.readStream.schema(COMMANDS).json(str(tmp_path / "told")))
    told = lambda n, *rows: (tmp_path / "told" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    send = lambda n, *spans: (tmp_path / "in" / f"{n}.json").write_text(body(*spans))
    send(0, ("t0", "s", "early", 1, 1, place(1)))
    run(stream(), tmp_path, "roots")
    told(0, {"at": 1, "command": "arm", "direction": "backward", "depth": 3})
    send(1, ("t1", "s", "cors middleware", 1, 1, place(2)), ("t1", "r", "go", 3, 1, place(3)), ("t2", "q", "GET /*", 2, 1, {"http.method": "GET", "http.route": "/*"}), ("t3", "z", "later", 4, 1, place(9)))
    fails = [True]

    def sink(d, i):
        rows = d.collect()
        if fails and rows:
            fails.clear()
            raise ValueError("the sink fails after the root was found")
        got.extend(r.asDict() for r in rows)

    got = []
    for _ in range(2):
        q = stream().writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{tmp_path}/roots-checkpoint").start()
        try:
            q.processAllAvailable()
        except Exception as e:
            assert "the sink fails" in str(e)
        finally:
            q.stop()
    assert got == [{"root_name": "f3", "is_route": False, "trace_id": "t1", "file": "a.js", "line": "3", "direction": "backward", "depth": 3}]
    got.clear()
    told(1, {"at": 2, "command": "arm"})  # t1 has been handled
    send(2, ("t1", "u", "again", 1, 1, place(4)), ("t4", "v", "x", 5, 1, {"http.method": "POST", "http.target": "/y"}), ("t1", "w", "again", 2, 1, place(5)))
    run(stream(), tmp_path, "roots")
    send(3, ("t5", "u", "unasked", 1, 1, place(6)))
    run(stream(), tmp_path, "roots")
    rows = stored.read.parquet(f"{tmp_path}/roots/b=*").collect()
    assert [(r["root_name"], r["is_route"], r["direction"], r["depth"]) for r in rows] == [("POST /y", True, "forward", st.DEFAULT_DEPTH)]


def test_a_failed_batch_keeps_the_session(spark, tmp_path):
    """The sink fails at the root; the next run of the batch sends it. Places have the prefix that is given."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text(body(("t", "s", "go", 1, 1, {"own.static.file": "a.js", "own.static.line": "3"})))
    session, got, fails = st.Session(), [], [True]
    session.arm()

    def sink(kind, d):
        if kind == "root":
            if fails:
                fails.clear()
                raise ValueError("once")
            got.append(d.head()["root_name"])

    for _ in range(2):
        q = st.start(st.json_bodies(spark, str(tmp_path / "in")), session, sink, str(tmp_path / "cp"), prefix="own.static")
        try:
            q.processAllAvailable()
        except Exception as e:
            assert "once" in str(e)
        finally:
            q.stop()
    assert got == ["go"] and not session.armed and session.handled == "t"


def test_newest_answer_wins(spark):
    rows = [("c", 2, 20, "new"), ("c", 1, 10, "late and old"), ("d", 1, 5, "only")]
    got = state.newest(spark.createDataFrame(rows, "client string, request int, asked_at int, answer string")).collect()
    assert {r["client"]: r["answer"] for r in got} == {"c": "new", "d": "only"}


def test_answers_within_the_watermark(spark, tmp_path):
    """Copies of an answer are one; the newest request's answer stays when an older one comes later."""
    (tmp_path / "in").mkdir()
    said = lambda n, *rows: (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("client", "request", "asked_at", "answer"), r, strict=True))) for r in rows))
    stream = lambda: state.latest_answers(spark.readStream.schema("client string, request long, asked_at timestamp, answer string").json(str(tmp_path / "in")))
    said(0, ("c", 2, "2024-01-01T00:02:00Z", "new"), ("c", 2, "2024-01-01T00:02:00Z", "new"))
    run(stream(), tmp_path, "answers")
    said(1, ("c", 1, "2024-01-01T00:01:00Z", "old"), ("c", 2, "2024-01-01T00:02:00Z", "new"))
    run(stream(), tmp_path, "answers")
    table = spark.read.parquet(f"{tmp_path}/answers/b=*")
    assert sorted(r["request"] for r in table.collect()) == [1, 2] and [r["answer"] for r in state.newest(table).collect()] == ["new"]
