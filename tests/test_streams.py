"""Streams against batches, event-time rules, stateful processors, sources and sinks."""

import datetime as dt
import json
import socket
import threading
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import aggregators as A
from millrace.operators import eventtime, joins, windows
from millrace.operators.stream import Stream
from millrace.plans import nexmark
from millrace.sources import readers as R
from millrace.sources import sinks as K
from millrace.streaming import stateful

EPOCH = dt.datetime(2022, 1, 1)
SCHEMA = "k long, v long, _t timestamp"


def _write(spark, path, rows, parts=3):
    df = spark.createDataFrame([(k, v, EPOCH + dt.timedelta(seconds=t)) for k, v, t in rows], SCHEMA)
    size = -(-len(rows) // parts)
    all_rows = df.orderBy("_t", "v").collect()
    for i in range(parts):
        part = all_rows[i * size : (i + 1) * size]
        if part:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
            time.sleep(0.05)


def _memory(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


ROWS = [(i % 3, i, i * 7 % 101) for i in range(60)]


@pytest.fixture()
def stream(spark, tmp_path):
    _write(spark, tmp_path / "in", ROWS)
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return s.withWatermark("_t", "10 seconds"), spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))


def test_stateless_and_window(stream, tmp_path):
    live, batch = stream

    def plan(df):
        s = Stream(df).filter(F.col("v") % 2 == 0).keyby(key=F.col("k"))
        return s.window(windows.Tumbling("20 seconds"), n=(A.count, F.lit(1)), total=(A.total, F.col("v"))).df

    got = {(r["key"], r["start"]): (r["n"], r["total"]) for r in _memory(plan(live), "tumbling", tmp_path)}
    want = {(r["key"], r["start"]): (r["n"], r["total"]) for r in plan(batch).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    closed = {(r["key"], r["start"]) for r in eventtime.closed_only(plan(batch), batch, "_t", "10 seconds").collect()}
    assert closed <= set(got)


def test_window_join_frees_state(spark, stream, tmp_path):
    live, batch = stream
    q = lambda df: joins.window_join(df.select("k", "v", "_t"), df.select("k", F.col("v").alias("w"), "_t"), ["k"], ["k"], "20 seconds").select("l_v", "r_w")
    got = sorted(map(tuple, _memory(q(live), "joined", tmp_path)))
    assert got == sorted(map(tuple, q(batch).collect()))
    progress = [p for p in spark.streams.active]
    assert not progress


def test_scan(stream, tmp_path):
    live, batch = stream
    fold = lambda acc, r: (acc[0] + r["v"],)
    out = stateful.scan(live, ["k"], ["_t", "v"], "s long", (0,), fold, "v long, total long", lambda acc, r: (r["v"], acc[0]))
    got = sorted(map(tuple, _memory(out, "scanned", tmp_path)))
    want = Stream(batch, keys=("k",)).scan(["v"], total=(A.total, F.col("v"))).df.select("k", "v", "total").collect()
    assert got == sorted(map(tuple, want))


@pytest.mark.parametrize(("length", "step"), [(4, 4), (5, 2), (2, 3)])
def test_count_windows(stream, tmp_path, length, step):
    live, batch = stream
    out = stateful.moving(live, ["k"], ["_t", "v"], "v", length, step, "total long", lambda v: (sum(v),))
    got = sorted(map(tuple, _memory(out, f"moving{length}", tmp_path)))
    w = windows.Moving(length, step)
    want = windows.aggregate(batch, w, {"total": (A.total, F.col("v"))}, ["k"], "_t", ["v"]).select("k", "window", "total").collect()
    assert got == sorted(map(tuple, want))


def test_dedup(stream, tmp_path):
    live, batch = stream
    got = _memory(Stream(live).dedup(["k"]).df.select("k"), "deduped", tmp_path)
    assert sorted(r["k"] for r in got) == [0, 1, 2]


def test_timers(stream, tmp_path):
    live, _ = stream
    out = stateful.after(live, ["k"], "_t", 1000, "at long", lambda key, at: (at,))
    got = {(r["k"], r["at"]) for r in _memory(out, "timers", tmp_path)}
    base = int(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert got and got <= {(k, base + t * 1000 + 1000) for k, _, t in ROWS}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(times=st.lists(st.integers(-50, 50), min_size=1, max_size=20), slack=st.integers(0, 20), every=st.integers(1, 4))
def test_late_rows(spark, times, slack, every):
    df = spark.createDataFrame([(i, EPOCH + dt.timedelta(seconds=t)) for i, t in enumerate(times)], "i long, t timestamp")
    kept, latest, mark = [], None, None
    for i, t in enumerate(times):
        if mark is not None and t < mark:
            continue
        kept.append(i)
        latest = t if latest is None else max(latest, t)
        if (i + 1) % every == 0:
            mark = latest - slack
    assert sorted(r["i"] for r in eventtime.drop_late_every(df, "t", slack * 10**6, every, "i").collect()) == kept
    if every == 1:
        assert sorted(r["i"] for r in eventtime.drop_late(df, "t", f"{slack} seconds", "i").collect()) == kept


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(times=st.lists(st.integers(-10**6, 10**6), min_size=1, max_size=20), length=st.integers(1, 5000))
def test_tumbling_floor(spark, times, length):
    df = spark.createDataFrame([(t, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=t)) for t in times], "s long, _t timestamp")
    got = df.select("s", F.unix_seconds(F.window("_t", f"{length} seconds")["start"]).alias("w"), eventtime.bucket(F.col("_t"), length * 10**6).alias("b")).collect()
    assert all(r["w"] == r["s"] // length * length and r["b"] == r["s"] // length for r in got)


def test_distinct_join_rejects_two_rows(spark):
    df = spark.createDataFrame([(1, 1, EPOCH), (1, 2, EPOCH)], SCHEMA)
    with pytest.raises(Exception, match="two rows"):
        joins.window_join_distinct(df, df, ["k"], ["k"], "1 second", strict=True).collect()


def test_plans_push_filters_and_prune(spark, tmp_path):
    t = nexmark.generate(spark, 2000)
    for n, df in t.items():
        df.write.parquet(str(tmp_path / n))
    a, p = spark.read.parquet(str(tmp_path / "auction")), spark.read.parquet(str(tmp_path / "person"))
    plan = nexmark.q3(a, p, "1 hour")._jdf.queryExecution().executedPlan().toString()
    assert "description" not in plan and "credit_card" not in plan
    assert "EqualTo(category,10)" in plan and "In(state" in plan
    assert sorted(map(tuple, nexmark.q3(a, p, "1 hour").collect())) == sorted(map(tuple, nexmark.q3_opt(a, p, "1 hour").collect()))
    assert nexmark.q3(a, p, "1 hour").count() > 0


def test_generator(spark, tmp_path):
    t = nexmark.generate(spark, 5000, 92, 6, 2)
    assert {n: df.count() for n, df in t.items()} == nexmark.counts(5000, 92, 6, 2) == {"person": 100, "auction": 300, "bid": 4600}
    nexmark.save(t, str(tmp_path))
    back = nexmark.read(spark, str(tmp_path))
    assert sorted(map(tuple, back["bid"].collect())) == sorted(map(tuple, t["bid"].collect()))
    r = nexmark.q1(t["bid"]).orderBy("auction").first()
    assert set(r.asDict()) == {"auction", "price", "bidder", "date_time"}
    nexmark.q1_io(t["bid"])
    nexmark.q3_io(t["auction"], t["person"])


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1;x\n2;y\nbad;z\n")
    got = R.source(spark, R.File(str(tmp_path / "a.csv")), R.Csv(";"), "k long, s string", R.Event("timestamp_seconds(k)"), {"key": "k % 2"})
    assert [(r["k"], r["s"], r["key"]) for r in got.orderBy("k").collect()] == [(1, "x", 1), (2, "y", 0)]
    K.run(K.sink(got.select(F.struct("k", "s").alias("r"), "key"), K.FileOut(str(tmp_path / "out")), R.Csv("|")))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1|x|1", "2|y|0"]
    K.run(K.sink(got, K.FileOut(str(tmp_path / "js")), R.Json()))
    watched = R.source(spark, R.File(str(tmp_path / "js"), watch=True), R.Json(), "k long, s string", R.Ingestion())
    assert watched.isStreaming
    q = K.run(K.sink(watched.drop("_t"), K.FileOut(str(tmp_path / "copy")), R.Json(), str(tmp_path / "cp")))
    q.wait()
    assert spark.read.json(str(tmp_path / "copy")).count() == 2
    assert R.read_text(spark, str(tmp_path / "a.csv")).first()["value"].startswith("1;x")
    assert R.read_bytes(spark, str(tmp_path / "a.csv")).first()["length"] == 14
    K.drain(got)
    assert R.from_iter(spark, [(1, EPOCH), (2, EPOCH - dt.timedelta(seconds=9)), (3, EPOCH)], "v long, t timestamp", "t", "5 seconds").count() == 2


def test_tcp(spark):
    got, port = [], _port()

    def serve():
        with socket.create_server(("127.0.0.1", port)) as s:
            peer, _ = s.accept()
            with peer, peer.makefile() as lines:
                got.extend(json.loads(x) for x in lines)

    t = threading.Thread(target=serve)
    t.start()
    time.sleep(0.2)
    K.run(K.sink(spark.createDataFrame([(1, "a")], "k long, s string").coalesce(1), K.TcpOut("127.0.0.1", port)))
    t.join(20)
    assert got == [{"k": 1, "s": "a"}]
    port = _port()

    def send():
        for _ in range(100):
            try:
                with socket.create_connection(("127.0.0.1", port)) as c:
                    c.sendall(b'{"k":7,"s":"x"}\nnonsense\n')
                return
            except OSError:
                time.sleep(0.1)

    t = threading.Thread(target=send)
    t.start()
    rows = R.source(spark, R.Tcp("127.0.0.1", port, listen=True, bounded=True), R.Json(), "k long, s string").collect()
    t.join(20)
    assert (7, "x") in [tuple(r) for r in rows]


def test_http(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer

    posted = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"1,a\n2,b\n")

        def do_POST(self):
            posted.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    df = R.source(spark, R.Http(url), R.Csv(), "k long, s string")
    assert sorted(map(tuple, df.collect())) == [(1, "a"), (2, "b")]
    K.run(K.sink(df.coalesce(1), K.HttpOut(url), R.Csv()))
    assert b"".join(posted) == b"1,a\n2,b\n"
    server.shutdown()


def _port() -> int:
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]
