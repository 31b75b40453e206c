"""Streaming against batch, restarts, and the HTTP source and sink against a local server."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from ampline.config import FIXTURE as C
from ampline.operators import features
from ampline.sources import http, samples
from ampline.streaming import batch, stream

SF = "/root/testdata/sf0.001"
SAMPLES = "stream_id long, arrival long, pos long, i long, voltage double, current double"


def plain(df):
    return df.selectExpr("stream_id", "arrival", "pos", "i", "cast(voltage as double) voltage", "cast(current as double) current")


def in_files(spark, df, path, cuts):
    """A file for each range of responses, in order."""
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        df.where(f"arrival >= {a} and arrival < {b}").coalesce(1).write.mode("append").parquet(f"{path}/part-{k}")


def run(spark, rows, kind, at, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    out = stream.detect_stream(rows, C, kind)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/{at}")
    query.awaitTermination(240)
    query.stop()


@pytest.mark.parametrize("kind", ["clean", "reordered"])
def test_a_stream_in_pieces_with_a_restart_answers_as_the_batch(spark, tmp_path, kind):
    clean = samples.meter_samples(spark, SF, C, 25) if kind == "clean" else samples.dirty(samples.meter_samples(spark, SF, C, 25))
    rows = plain(clean).cache()
    given = lambda: spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    in_files(spark, rows, f"{tmp_path}/in", [0, 1, 9, 14])
    run(spark, given(), kind, "out", tmp_path)
    some = spark.read.parquet(f"{tmp_path}/out").count()
    in_files(spark, rows, f"{tmp_path}/in", [14, 20, 10_000])
    run(spark, given(), kind, "out", tmp_path)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    want = batch.detect_clean(clean, C, whole_only=True) if kind == "clean" else batch.detect_dirty_reordered(clean, C)
    assert got == sorted(map(tuple, want.collect()))
    assert 0 < some < len(got)


def test_a_batch_run_hands_over_to_a_stream(spark, tmp_path):
    dirty = samples.dirty(samples.meter_samples(spark, SF, C, 25))
    rows = plain(dirty).cache()
    states = stream.machine_states(rows.where("arrival < 14"), C)
    assert states.count() == rows.select("stream_id").distinct().count()
    in_files(spark, rows, f"{tmp_path}/in", [14, 20, 10_000])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    given = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = stream.detect_stream(given, C, start=states)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(240)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    every = sorted(map(tuple, batch.detect_dirty_reordered(dirty, C).collect()))
    emitted = {r.stream_id: json.loads(r.state)["emitted"] for r in states.collect()}
    assert got == [x for x in every if x[1] >= emitted[x[0]]]
    assert 0 < len(got) < len(every)


def test_a_stream_that_stops_is_answered_by_a_timer(spark, tmp_path):
    dirty = samples.dirty(samples.meter_samples(spark, SF, C, 25)).where("stream_id < 2 and arrival < 20")
    in_files(spark, plain(dirty), f"{tmp_path}/in", [0, 10_000])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    given = spark.readStream.schema(SAMPLES).parquet(f"{tmp_path}/in/*")
    out = stream.detect_stream(given, C, silence=3)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start(f"{tmp_path}/out")
    want = sorted(map(tuple, batch.detect_dirty_reordered(dirty, C, finish=True).collect()))
    short = batch.detect_dirty_reordered(dirty, C).count()
    end, got = time.time() + 120, []
    while len(got) < len(want) and time.time() < end and query.isActive:
        time.sleep(1)
        if list(tmp_path.glob("out/*.parquet")):
            got = spark.read.schema(batch.RESULT).parquet(f"{tmp_path}/out").collect()
    query.stop()
    # the end comes after the last response; in a batch run it is known with it, so only the order may differ
    assert sorted((x[0], *x[2:]) for x in map(tuple, got)) == sorted((x[0], *x[2:]) for x in want)
    assert short < len(want)


def test_event_time_counts_seconds_and_not_responses(spark, tmp_path):
    """Batches of ten samples a second. Batch 3 comes after 25 empty responses, in time by its own clock; batch 5 comes with
    the second response after a jump of 40 seconds, too late by event time (a watermark holds from the response after the next)."""
    size = C.samples_per_feature
    rows = lambda arrival, seq, n=size: [(0, arrival, k, seq * size + k, 2.0 + k, 1.5, seq) for k in range(n)]
    parts = [[*rows(0, 0), *rows(0, 1), *rows(0, 2)], [*rows(28, 3), *rows(28, 4, 8)], rows(29, 44), rows(30, 45), rows(31, 5), rows(32, 100)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, f"{SAMPLES}, second long").selectExpr("*", "timestamp_seconds(second) ts").coalesce(1).write.parquet(f"{tmp_path}/in/part-{k}")
        time.sleep(1.1)  # files are taken by age
    given = spark.readStream.schema(f"{SAMPLES}, second long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = stream.event_time_features(given, C)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(240)
    got = {int(r.start.timestamp()): (r.n_samples, r.is_bad) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: (10, False), 1: (10, False), 2: (10, False), 3: (10, False), 4: (8, True), 44: (10, False), 45: (10, False)}
    assert stream.sums_dropped(query) == 1  # the ten samples of batch 5, in one task
    # by responses, batch 3 is 25 late and batch 5 has its whole number of samples at once
    every = spark.createDataFrame([x[:6] for part in parts for x in part], SAMPLES)
    slots = {r.seq: r.flush_at for r in features.flushed_slots(every, C).collect()}
    assert slots[3] == 28
    assert slots[5] == 31


def test_batches_that_are_not_whole_stay_open(spark):
    users = samples.user_samples(spark, SF, C)
    whole = batch.detect_clean(users, C, whole_only=True).count()
    assert whole == batch.clean_batches(users, C).where("n_samples = 10").count()
    assert whole < batch.detect_clean(users, C).count()


def test_json_files_are_a_stream_of_samples(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"arrival": 0, "records": [{"i": 0, "voltage": 1.5, "current": 2}, {"i": 1, "voltage": 1.0, "current": 3.0}]}, {"arrival": 1}, {"arrival": 2, "records": []}, {"arrival": 3, "records": [{"i": 5, "voltage": 1, "current": 1}]}]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    query = samples.read_json_stream(spark, str(tmp_path / "in"), 4).writeStream.format("memory").queryName("read_json").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("read_json").collect())) == [(4, 0, 0, 0, 1.5, 2.0), (4, 0, 1, 1, 1.0, 3.0), (4, 3, 0, 5, 1.0, 1.0)]


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        bodies, posted = [], []

        def do_GET(self):
            self._send(self.bodies.pop(0) if self.bodies else b"")

        def do_POST(self):
            self.posted.append((self.headers["Content-Type"], self.rfile.read(int(self.headers["Content-Length"])).decode()))
            self._send(b"")

        def _send(self, body):
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    found = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}", Handler
    found.shutdown()


def body(*numbers):
    return json.dumps({"records": [{"i": i, "voltage": i + 0.5, "current": 1.0} for i in numbers]}).encode()


def read_all(reader, start, calls):
    rows = []
    for _ in range(calls):
        more, start = reader.read(start)
        rows += list(more)
    return rows, start


def test_only_an_object_without_records_ends_the_stream(server):
    url, handler = server
    handler.bodies[:] = [body(0, 1), b"", b"{16 bytes here }", b'{"records": [{"i": 2', b"[1]", b'{"records": null}', body(2), body(), b'{"end": 1}', body(9)]
    reader = http._Reader({"url": url})
    rows, at = read_all(reader, reader.initialOffset(), 9)
    assert [(r[1], r[2], r[3]) for r in rows] == [(0, 0, 0), (0, 1, 1), (1, 0, 2)]
    assert at == {"response": 3}
    assert reader.ended
    assert len(handler.bodies) == 1


def test_a_restart_reads_from_the_log_or_fails(server, tmp_path):
    url, handler = server
    handler.bodies[:] = [body(0), body(1), body(2)]
    options = {"url": url, "log_dir": f"file://{tmp_path}/log"}
    first = http._Reader(options)
    rows, at = read_all(first, first.initialOffset(), 1)
    assert (len(rows), at) == (3, {"response": 3})
    again = http._Reader(options)
    assert list(again.readBetweenOffsets({"response": 0}, at)) == rows
    again.commit({"response": 2})
    assert list(http._Reader(options).readBetweenOffsets({"response": 2}, at)) == rows[2:]
    more, later = http._Reader(options).read({"response": 2})  # written, but its offset was not
    assert (list(more), later) == (rows[2:], at)
    with pytest.raises(RuntimeError, match="response 0"):
        http._Reader({"url": url}).readBetweenOffsets({"response": 0}, at)


def test_answers_of_an_http_stream_are_posted(spark, server, tmp_path):
    url, handler = server
    clean = plain(samples.meter_samples(spark, SF, C, 25)).where("stream_id = 1").orderBy("i").collect()
    handler.bodies[:] = [json.dumps({"records": [{"i": r.i, "voltage": r.voltage, "current": r.current} for r in clean if r.arrival == k]}).encode() for k in range(25)]
    handler.bodies[3:3] = [b"", b"wait a little..."]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    rows = http.read_http_stream(spark, url, responses_per_batch="10", log_dir=f"file://{tmp_path}/log")
    out = stream.detect_stream(rows, C, "clean")
    query = out.writeStream.foreachBatch(lambda df, _: http.post_results(df, url)).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    end = time.time() + 120
    while len(handler.posted) < 25 and time.time() < end and query.isActive:
        time.sleep(0.5)
    query.stop()
    one = samples.meter_samples(spark, SF, C, 25).where("stream_id = 1").withColumn("stream_id", samples.F.lit(0).cast("long"))
    want = [(r.s, r.d, r.event_s) for r in batch.detect_clean(one, C).orderBy("emit_ord").collect()]
    assert {x[0] for x in handler.posted} == {"application/json"}
    assert [tuple(json.loads(x[1]).values()) for x in handler.posted] == want
    assert handler.posted[0][1] == '{"s":0,"d":0,"event_s":-1}'


def test_events_are_printed(spark, tmp_path):
    spark.createDataFrame([(0, 0, 7, 1, 5), (0, 1, 8, 0, -1)], batch.RESULT).write.parquet(f"{tmp_path}/in")
    query = http.print_events(spark.readStream.schema(batch.RESULT).parquet(f"{tmp_path}/in")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert "Console" in query.lastProgress["sink"]["description"]
    # the event alone; how many rows are read for it depends on what the filter skips of the files
    assert sum(x["sink"]["numOutputRows"] for x in query.recentProgress) == 1
