"""Messages kept for clients: what was missed comes, none twice, a failed batch shows nothing."""

import json

from test_state import body

from spanweave.streaming import session as st
from spanweave.streaming.clients import MessageLog

AT = {"static.file": "a.js", "static.line": "3"}


def texts(log, client):
    rows, last = log.unread(client)
    return [(r["number"], r["kind"], json.loads(r["message"]).get("name")) for r in rows.orderBy("number", "kind", "seq").collect()], last


def test_clients_get_what_they_missed(spark, tmp_path):
    log = MessageLog(spark, str(tmp_path / "log"))
    early, twin = log.connect(), log.connect()
    assert early != twin and texts(log, early) == ([], -1)
    add = lambda n, *names: log.sink(n)("pulse_batch", spark.createDataFrame([(x,) for x in names], "name string").coalesce(1))
    add(0, "z", "a")
    assert texts(log, early) == ([], -1)
    log.commit(0)
    first = [(0, "pulse_batch", "z"), (0, "pulse_batch", "a")]
    assert texts(log, early) == (first, 0) == texts(log, early)
    log.confirm(early, 0)
    late = log.connect()
    add(1, "b")
    log.commit(1)
    again = MessageLog(spark, str(tmp_path / "log"))
    assert again.connect(early) == early
    assert texts(again, early) == ([(1, "pulse_batch", "b")], 1) == texts(again, late)
    assert texts(again, twin) == ([*first, (1, "pulse_batch", "b")], 1)
    log.confirm(twin, 1)
    log.confirm(twin, 0)
    assert texts(log, twin) == ([], 1)
    add(1, "changed")
    assert texts(log, early) == ([(1, "pulse_batch", "b")], 1)


def test_a_failed_batch_shows_nothing(spark, tmp_path):
    """The sink fails behind the first message; the next run of the batch is shown once, with its own messages only."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text(body(("t", "s", "go", 1, 1, AT)))
    log, fails = MessageLog(spark, str(tmp_path / "log")), [True]
    client = log.connect()

    def sink(kind, d):
        if kind == "pulse_batch" and fails:
            fails.clear()
            log.sink(0)("stale", d)
            raise ValueError("once")

    for want in ([], [(0, "pulse_batch", "go"), (0, "spans", "go")]):
        q = st.start(st.json_bodies(spark, str(tmp_path / "in")), st.Session(), sink, str(tmp_path / "cp"), log=log)
        try:
            q.processAllAvailable()
        except Exception as e:
            assert "once" in str(e)
        finally:
            q.stop()
        assert texts(log, client)[0] == want
