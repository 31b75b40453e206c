"""An HTTP server of sample batches as a streaming source, and an HTTP sink of results.

Each GET brings a response: ``records`` with samples; nothing yet (an empty body, or one that isn't JSON, such as a control
message or a cut-off response); or at the end a JSON object without records. Results are posted as {"s", "d", "event_s"}.

A server doesn't repeat what it has sent. With option ``log_dir`` each response is written there before it counts as
read, so a query that starts again from its checkpoint finds what was read and not committed; without it such a
start fails instead of losing samples.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "stream_id long, arrival long, pos long, i long, voltage double, current double"


def parse_body(body: bytes) -> tuple[list[dict] | None, bool]:
    """(the records of a body, or None; whether the body ends the stream)"""
    try:
        found = json.loads(body)
    except ValueError:
        return None, False
    if not isinstance(found, dict):
        return None, False
    records = found.get("records")
    return (records, False) if isinstance(records, list) else (None, "records" not in found)


class _Reader(SimpleDataSourceStreamReader):
    """Keeps what it has read until it is committed, so that a micro-batch can be read again."""

    def __init__(self, options: dict):
        self.url, self.stream_id = options["url"], int(options.get("stream_id", 0))
        self.timeout, self.most = float(options.get("timeout", 10)), int(options.get("responses_per_batch", 100))
        self.kept: dict[int, list[dict]] = {}
        self.ended = False
        self.fs, self.log = pafs.FileSystem.from_uri(options["log_dir"]) if options.get("log_dir") else (None, None)
        if self.fs:
            self.fs.create_dir(self.log, recursive=True)

    def initialOffset(self) -> dict:
        return {"response": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at, rows = start["response"], []
        while at - start["response"] < self.most:
            records = self._again(at)
            if records is None and not self.ended:
                with urllib.request.urlopen(self.url, timeout=self.timeout) as got:
                    records, self.ended = parse_body(got.read())
                if records is not None and self.fs:
                    with self.fs.open_output_stream(f"{self.log}/{at}.json") as out:
                        out.write(json.dumps(records).encode())
            if records is None:
                break
            self.kept[at] = records
            rows += self._rows(at)
            at += 1
        return iter(rows), {"response": at}

    def _again(self, at: int) -> list[dict] | None:
        """A response that was read before."""
        if at in self.kept:
            return self.kept[at]
        if self.fs and self.fs.get_file_info(f"{self.log}/{at}.json").type == pafs.FileType.File:
            with self.fs.open_input_stream(f"{self.log}/{at}.json") as got:
                try:
                    return json.loads(got.read())
                except ValueError:  # cut off while it was written, so it never counted as read
                    return None
        return None

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        wanted = range(start["response"], end["response"])
        for at in wanted:
            if (records := self._again(at)) is None:
                raise RuntimeError(f"response {at} was read before a restart and can't be had again; set log_dir")
            self.kept[at] = records
        return iter([row for at in wanted for row in self._rows(at)])

    def commit(self, end: dict) -> None:
        for at in [x for x in self.kept if x < end["response"]]:
            del self.kept[at]
            if self.fs and self.fs.get_file_info(f"{self.log}/{at}.json").type == pafs.FileType.File:
                self.fs.delete_file(f"{self.log}/{at}.json")

    def _rows(self, at: int) -> list[tuple]:
        return [(self.stream_id, at, pos, int(r["i"]), float(r["voltage"]), float(r["current"])) for pos, r in enumerate(self.kept[at])]


class LoadSignalSource(DataSource):
    """Format ``load_signal``; options: url, stream_id, timeout, responses_per_batch, log_dir (a URI that a restarted driver reaches too)."""

    @classmethod
    def name(cls) -> str:
        return "load_signal"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def read_http_stream(spark: SparkSession, url: str, **options: str) -> DataFrame:
    spark.dataSource.register(LoadSignalSource)
    reader = spark.readStream.format("load_signal").option("url", url)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def post_results(results: DataFrame, url: str) -> None:
    """Posts each result in order from the executors, for use with ``foreachBatch``."""
    ordered = results.repartition("stream_id").sortWithinPartitions("stream_id", "emit_ord").select("s", "d", "event_s")

    def send(rows) -> None:
        for r in rows:
            body = json.dumps({"s": r.s, "d": r.d, "event_s": r.event_s}, separators=(",", ":")).encode()
            urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=10).close()

    ordered.foreachPartition(send)


def print_events(results: DataFrame):
    """A writer that prints a stream's events, without the answers that there is none."""
    return results.where("d = 1").writeStream.format("console").outputMode("append")
