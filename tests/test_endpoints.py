"""Many HTTP endpoints as one source, the sink that posts once, and scores in flight, against local servers and the batch form."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from ampline.operators import scoring
from ampline.sources import endpoints, post
from ampline.streaming import batch, stream

TRUTH = "stream_id long, s long, truth_d int"


class Server:
    """Sends ``bodies`` one a GET, then empty ones; takes POSTs unless ``refuse`` tells a status for one."""

    def __init__(self):
        self.bodies, self.posted, self.refuse = [], [], lambda n: None
        own, one_by_one = self, threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                self._send(200, own.bodies.pop(0) if own.bodies else b"")

            def do_POST(self):
                got = self.rfile.read(int(self.headers["Content-Length"]))
                with one_by_one:
                    status = own.refuse(len(own.posted))
                    if not status:
                        own.posted.append((self.headers["Idempotency-Key"], json.loads(got)))
                self._send(status or 200, b"")

            def _send(self, status, body):
                self.send_response(status)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


@pytest.fixture
def servers():
    found = [Server() for _ in range(3)]
    yield found
    for one in found:
        one.http.shutdown()


def body(*numbers):
    return json.dumps({"records": [{"i": i, "voltage": i + 0.5, "current": 1.0} for i in numbers]}).encode()


def reader(servers, tmp_path, most=2):
    return endpoints._Endpoints({"endpoints": json.dumps({str(k): s.url for k, s in enumerate(servers)}), "log_dir": f"file://{tmp_path}/log", "responses_per_turn": str(most)})


def read(r, start, end):
    return sorted(row for p in r.partitions(start, end) for row in r.read(p))


def test_turns_are_read_again_from_the_log_and_go_on_where_they_stopped(servers, tmp_path):
    a, b, c = servers
    a.bodies[:] = [body(0, 1), body(2), body(3), b'{"end": 1}', body(9)]
    b.bodies[:] = [body(5), b"", body(6), body()]
    r = reader(servers, tmp_path)
    zero = r.initialOffset()
    one = r.latestOffset()
    assert (zero, one) == ({"0": 0, "1": 0, "2": 0}, {"0": 1, "1": 1, "2": 1})
    assert r.latestOffset() == one  # a turn that is not read yet is not passed over
    first = [(0, 0, 0, 0, 0.5, 1.0), (0, 0, 1, 1, 1.5, 1.0), (0, 1, 0, 2, 2.5, 1.0), (1, 0, 0, 5, 5.5, 1.0)]
    assert read(r, zero, one) == first
    assert read(r, zero, one) == first  # as a stage that runs again, or a restart
    assert read(reader(servers, tmp_path), zero, one) == first
    again = reader(servers, tmp_path)
    two = again.latestOffset()
    assert two == {"0": 2, "1": 2, "2": 2}
    part = again._turn(0, a.url, 1)
    assert next(part) == (0, 2, 0, 3, 3.5, 1.0)
    part.close()  # a task that is lost after its first response
    assert read(again, one, two) == [(0, 2, 0, 3, 3.5, 1.0), (1, 1, 0, 6, 6.5, 1.0)]
    assert again.latestOffset() == {"0": 2, "1": 3, "2": 3}  # the first has ended
    assert a.bodies == [body(9)]
    read(again, two, again.latestOffset())
    assert sorted(x.name for x in (tmp_path / "log" / "1").iterdir()) == ["1", "2"]  # older turns are gone
    with pytest.raises(RuntimeError, match="lacks turn 4"):
        list(again._turn(1, b.url, 5))


def test_three_endpoints_lose_nothing_over_a_restart(spark, servers, tmp_path):
    numbers = {k: [range(n * 3 + k, n * 3 + k + 3) for n in range(12)] for k in range(3)}
    urls = {k + 7: s.url for k, s in enumerate(servers)}

    def run(want):
        rows = endpoints.read_endpoints(spark, urls, f"file://{tmp_path}/log", responses_per_turn="2", tasks="2")
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="500 milliseconds").start(f"{tmp_path}/out")
        end, got = time.time() + 90, []
        while len(got) < want and time.time() < end and query.isActive:
            time.sleep(0.5)
            if list(tmp_path.glob("out/*.parquet")):
                got = spark.read.schema(endpoints.SCHEMA).parquet(f"{tmp_path}/out").collect()
        query.stop()
        assert query.exception() is None
        return got

    for k, s in enumerate(servers):
        s.bodies[:] = [b"", *[body(*x) for x in numbers[k]][:6]]
    assert len(run(54)) == 54
    for k, s in enumerate(servers):
        s.bodies[:] = [body(*x) for x in numbers[k]][6:] + [b'{"end": 1}']
    got = run(108)
    want = [(k + 7, n, pos, i, i + 0.5, 1.0) for k in range(3) for n, x in enumerate(numbers[k]) for pos, i in enumerate(x)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_the_source_refuses_speculative_execution(spark, tmp_path):
    class Session:
        class sparkContext:  # noqa: N801
            getConf = staticmethod(lambda: {"spark.speculation": "true"})

    with pytest.raises(ValueError, match="speculation"):
        endpoints.read_endpoints(Session(), {0: "http://none"}, f"file://{tmp_path}")


def answers(streams=3, each=7):
    return [(k, n, n + 2, n % 2, n if n % 3 else None) for k in range(streams) for n in range(each)]


def in_order(server, per_request):
    """{stream: the positions posted for it, in order}, from keys and bodies."""
    out = {}
    for key, found in server.posted:
        stream_id, first, last = map(int, key.split("-"))
        mine = [found] if per_request == 1 else found["results"]
        assert len(mine) == last - first + 1
        out.setdefault(stream_id, []).extend(x["s"] for x in mine)
    return out


@pytest.mark.parametrize("per_request", [1, 3])
def test_a_repeated_micro_batch_posts_what_is_left(spark, servers, tmp_path, per_request):
    """The server refuses the fifth request for good, after two that it fails once: the query fails, and goes on when started again."""
    one, tries = servers[0], {}

    def refuse(n):
        tries[n] = tries.get(n, 0) + 1
        return 503 if n in (1, 2) and tries[n] == 1 else 400 if n >= 4 and not open_again else None

    open_again = False
    one.refuse = refuse
    spark.createDataFrame(answers(), batch.RESULT).coalesce(1).write.parquet(f"{tmp_path}/in")

    def run():
        given = spark.readStream.schema(batch.RESULT).parquet(f"{tmp_path}/in")
        return post.posted(given, one.url, f"file://{tmp_path}/log", per_request=str(per_request)).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()

    query = run()
    with pytest.raises(Exception, match="400"):
        query.awaitTermination(120)
    assert len(one.posted) == 4
    open_again = True
    query = run()
    query.awaitTermination(120)
    assert query.exception() is None
    assert in_order(one, per_request) == {k: list(range(2, 9)) for k in range(3)}
    bodies = [x for _, found in one.posted for x in ([found] if per_request == 1 else found["results"])]
    assert sorted((x["s"], x["d"], x["event_s"]) for x in bodies) == sorted((s, d, -1 if e is None else e) for _, _, s, d, e in answers())


def test_a_request_before_its_note_is_sent_again_under_its_key(servers, tmp_path):
    one = servers[0]
    options = {"url": one.url, "log_dir": f"file://{tmp_path}/log"}
    rows = [post.Row(stream_id=5, emit_ord=n, s=n, d=0, event_s=-1) for n in (1, 0)]
    assert post._Writer(options).write(iter(rows)) == post.Posted(2, 2)
    assert [x.name for x in (tmp_path / "log" / "5").iterdir()] == ["1"]
    (tmp_path / "log" / "5" / "1").rename(tmp_path / "log" / "5" / "0")  # as if the worker had died before the second note
    assert post._Writer(options).write(iter(rows)) == post.Posted(1, 1)
    assert [key for key, _ in one.posted] == ["5-0-0", "5-1-1", "5-1-1"]
    assert post._Writer(options).write(iter([])) == post.Posted(0, 0)


def test_scores_in_flight_are_those_of_the_batch(spark, tmp_path):
    """Position s is of second s. A second answer for a position doesn't count, some positions have no truth, and a truth
    that comes after its window is dropped, which leaves its answer unknown."""
    results = [(k, n, n // 2, (n * 7 + k) % 3 % 2, -1) for k in range(3) for n in range(240)]
    truths = [(k, s, (s + k) % 2) for k in range(3) for s in range(120) if s % 11 != 3]
    late = [(0, 3, 1)]
    far = 10_000  # moves the clocks past all windows; its own stays open
    timed = lambda df: df.selectExpr("*", "timestamp_seconds(s) ts")

    def put(rows, schema, name, part):
        timed(spark.createDataFrame(rows, schema)).coalesce(1).write.parquet(f"{tmp_path}/{name}/part-{part}")

    for part, (a, b) in enumerate([(0, 100), (100, 240)]):
        put([r for r in results if a <= r[1] < b], batch.RESULT, "results", part)
        put([t for t in truths if a <= 2 * t[1] < b], TRUTH, "truth", part)
        time.sleep(1.1)  # files are taken by age
    for part, rows in ((2, []), (3, late), (4, [])):
        put([(9, part, far + part, 0, -1)], batch.RESULT, "results", part)
        put([(9, far + part, 0), *rows], TRUTH, "truth", part)
        time.sleep(1.1)
    given = lambda name, schema: spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    scored = scoring.score_stream(given("results", batch.RESULT), given("truth", TRUTH), every="30 seconds", lateness="5 seconds")
    query = scored.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(240)
    assert query.exception() is None
    got = spark.read.parquet(f"{tmp_path}/out").where("stream_id < 9").collect()
    assert len(got) == 3 * 4
    total = {k: tuple(sum(r[c] for r in got if r.stream_id == k) for c in ("answers", "false_positives", "false_negatives", "unknown")) for k in range(3)}
    want = scoring.score(spark.createDataFrame(results, batch.RESULT), spark.createDataFrame(truths, TRUTH))
    assert total == {r.stream_id: tuple(r)[1:] for r in want.collect()}
    assert total[0][3] > 0
    assert stream.sums_dropped(query) >= 1
