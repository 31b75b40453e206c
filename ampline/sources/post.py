"""Answers posted to an HTTP server once each, in the order of their stream, from the executors.

What a server has taken is noted in ``log_dir`` after each request: an empty file by the stream and the last ``emit_ord`` in
it. A task or micro-batch that runs again skips what is noted. A request whose worker dies before the note is the only one that
can be sent again; it then has the same ``Idempotency-Key`` (stream, first and last ``emit_ord``), by which a server can
tell.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

RESULT = "stream_id long, emit_ord long, s long, d int, event_s long"


@dataclass
class Posted(WriterCommitMessage):
    answers: int
    requests: int


class _Ledger:
    """The last ``emit_ord`` of a stream that was taken; a note is a file of its own, so it is there or not."""

    def __init__(self, fs: pafs.FileSystem, root: str, stream_id: int):
        self.fs, self.root = fs, f"{root}/{stream_id}"
        fs.create_dir(self.root, recursive=True)
        self.notes = sorted(int(found.base_name) for found in fs.get_file_info(pafs.FileSelector(self.root)))

    def last(self) -> int:
        return self.notes[-1] if self.notes else -1

    def note(self, emit_ord: int) -> None:
        self.fs.open_output_stream(f"{self.root}/{emit_ord}").close()
        for old in self.notes:
            self.fs.delete_file(f"{self.root}/{old}")
        self.notes = [emit_ord]


class _Writer(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.url, self.uri = options["url"], options["log_dir"]
        self.many, self.retries, self.timeout = int(options.get("per_request", 1)), int(options.get("retries", 3)), float(options.get("timeout", 10))

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        answers = requests = 0
        rows = sorted(((r.stream_id, r.emit_ord, r.s, r.d, r.event_s) for r in iterator), key=lambda r: r[:2])
        for stream_id, mine in groupby(rows, key=lambda r: r[0]):
            ledger = _Ledger(fs, root, stream_id)
            left = [r for r in mine if r[1] > ledger.last()]
            for k in range(0, len(left), self.many):
                part = left[k : k + self.many]
                self._send(part)
                ledger.note(part[-1][1])
                answers, requests = answers + len(part), requests + 1
        return Posted(answers, requests)

    def _send(self, part: list[tuple]) -> None:
        found = [{"s": s, "d": d, "event_s": -1 if event_s is None else event_s} for _, _, s, d, event_s in part]
        body = json.dumps(found[0] if self.many == 1 else {"results": found}, separators=(",", ":")).encode()
        key = f"{part[0][0]}-{part[0][1]}-{part[-1][1]}"
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Idempotency-Key": key})
        for attempt in range(self.retries + 1):
            try:
                urllib.request.urlopen(request, timeout=self.timeout).close()
                return
            except urllib.error.HTTPError as e:
                if e.code < 500 or attempt == self.retries:
                    raise
            except OSError:
                if attempt == self.retries:
                    raise
            time.sleep(min(5.0, 0.1 * 2**attempt))

    def commit(self, messages, batchId: int) -> None:
        """Nothing is left to do: what was posted was noted with each request."""

    def abort(self, messages, batchId: int) -> None:
        """What was posted stays posted and noted, and the micro-batch goes on from there when it is repeated."""


class ResultSink(DataSource):
    """Format ``post_results``; options: url, log_dir (a URI that all executors reach, of this query alone), per_request (1: a
    request is one object; more: an object with a list ``results``), retries (of requests that fail, or that a server refuses with
    500 or more), timeout."""

    @classmethod
    def name(cls) -> str:
        return "post_results"

    def schema(self) -> str:
        return RESULT

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options)


def posted(results: DataFrame, url: str, log_dir: str, **options: str) -> DataStreamWriter:
    """A writer that posts a stream's answers (stream_id, emit_ord, s, d, event_s); each stream in one task, so in order.

    ``emit_ord`` must rise within a stream over the life of the checkpoint, as that of ``detect_stream`` does. What the micro-batch
    brings of one task's streams is held to be sorted. Answers without a stream_id or emit_ord are not posted.
    """
    results.sparkSession.dataSource.register(ResultSink)
    plain = results.select(*[F.col(name).cast(kind) for name, kind in (x.split() for x in RESULT.split(", "))])
    known = plain.where("stream_id is not null and emit_ord is not null")
    writer = known.repartition("stream_id").writeStream.format("post_results").outputMode("append").option("url", url).option("log_dir", log_dir)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer
