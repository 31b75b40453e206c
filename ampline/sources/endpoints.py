"""Many HTTP servers of sample batches as one streaming source, each read by executors.

A micro-batch takes one turn at every endpoint that has not ended: GETs until a response brings nothing yet, or
``responses_per_turn`` of them. The offset counts each endpoint's turns, so the driver plans turns and sees no sample.

A server doesn't repeat what it has sent, so each response is written to ``log_dir`` before it counts as read, and a turn
that is read to its end is marked. A task, stage or query that runs again reads the turn from there, and goes on with it
where it was not finished. A response is lost only if a worker dies between receiving and writing it. Once the next turn is
read, the micro-batch of the last is committed, and the task deletes what it had written. Two attempts of one task must not
run at once (they would share a turn's responses), so speculative execution is refused.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ampline.sources.http import SCHEMA, parse_body


class _Log:
    """What one endpoint sent: ``turn/number`` is a response, ``turn/done`` what the next turn starts from; ``ended/stream`` marks its end."""

    def __init__(self, uri: str, stream_id: int):
        self.fs, root = pafs.FileSystem.from_uri(uri)
        self.root, self.ended = f"{root}/{stream_id}", f"{root}/ended/{stream_id}"

    def get(self, turn: int, name: str):
        try:
            with self.fs.open_input_stream(f"{self.root}/{turn}/{name}") as got:
                return json.loads(got.read())
        except FileNotFoundError:
            return None
        except ValueError:  # cut off while it was written, so it never counted as read
            return None

    def put(self, turn: int, name: str, found) -> None:
        with self.fs.open_output_stream(f"{self.root}/{turn}/{name}") as out:
            out.write(json.dumps(found).encode())

    def open(self, turn: int) -> None:
        self.fs.create_dir(f"{self.root}/{turn}", recursive=True)

    def end(self) -> None:
        self.fs.open_output_stream(self.ended).close()

    def drop(self, turn: int) -> None:
        """Removes a turn's responses, and the mark of the turn before."""
        for found in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{turn}", allow_not_found=True)):
            if found.base_name != "done":
                self.fs.delete_file(found.path)
        if turn and self.fs.get_file_info(f"{self.root}/{turn - 1}").type == pafs.FileType.Directory:
            self.fs.delete_dir(f"{self.root}/{turn - 1}")


@dataclass
class _Turns(InputPartition):
    """(stream_id, url, turn) of the endpoints that one task reads in turn."""

    turns: list[tuple[int, str, int]]


class _Endpoints(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.urls = {int(k): v for k, v in json.loads(options["endpoints"]).items()}
        self.uri, self.timeout = options["log_dir"], float(options.get("timeout", 10))
        self.most, self.tasks = int(options.get("responses_per_turn", 100)), int(options.get("tasks", 64))
        self.read_to: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(f"{root}/ended", recursive=True)
        return {str(k): 0 for k in self.urls}

    def latestOffset(self) -> dict:
        """One turn more at each endpoint, but for those that have ended."""
        if self.read_to is None:
            self.read_to = self._marked()
        fs, root = pafs.FileSystem.from_uri(self.uri)
        ended = {found.base_name for found in fs.get_file_info(pafs.FileSelector(f"{root}/ended", allow_not_found=True))}
        return {k: n if k in ended else n + 1 for k, n in self.read_to.items()}

    def _marked(self) -> dict[str, int]:
        """Turns that are read to their end, by the log: where a query that starts, or starts again, goes on."""
        fs, root = pafs.FileSystem.from_uri(self.uri)
        out = {}
        for k in self.urls:
            turns = fs.get_file_info(pafs.FileSelector(f"{root}/{k}", allow_not_found=True, recursive=True))
            out[str(k)] = max((int(x.path.rsplit("/", 2)[1]) + 1 for x in turns if x.base_name == "done"), default=0)
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.read_to = {str(k): end.get(str(k), 0) for k in self.urls}
        turns = [(k, url, end[str(k)] - 1) for k, url in self.urls.items() if end.get(str(k), 0) > start.get(str(k), 0)]
        n = min(self.tasks, len(turns))
        return [_Turns(turns[part::n]) for part in range(n)]

    def read(self, partition: _Turns) -> Iterator[tuple]:
        for stream_id, url, turn in partition.turns:
            yield from self._turn(stream_id, url, turn)

    def _turn(self, stream_id: int, url: str, turn: int) -> Iterator[tuple]:
        log = _Log(self.uri, stream_id)
        before = log.get(turn - 1, "done") if turn else {"arrival": 0, "ended": False}
        if before is None:
            raise RuntimeError(f"the log of endpoint {stream_id} lacks turn {turn - 1}; log_dir must stay with the checkpoint")
        log.open(turn)
        if turn:
            log.drop(turn - 1)
        done, arrival, ended, number = log.get(turn, "done"), before["arrival"], before["ended"], 0
        stop = self.most if done is None else done["arrival"] - before["arrival"]
        while number < stop:
            records = log.get(turn, str(number))
            if records is None and done is not None:
                raise RuntimeError(f"the log of endpoint {stream_id} lacks response {number} of turn {turn}")
            if records is None and not ended:
                with urllib.request.urlopen(url, timeout=self.timeout) as got:
                    records, ended = parse_body(got.read())
                if records is not None:
                    log.put(turn, str(number), records)
            if records is None:
                break
            for pos, r in enumerate(records):
                yield stream_id, arrival, pos, int(r["i"]), float(r["voltage"]), float(r["current"])
            number, arrival = number + 1, arrival + 1
        if done is None:
            log.put(turn, "done", {"arrival": arrival, "ended": ended})
            if ended:
                log.end()


class LoadSignalEndpoints(DataSource):
    """Format ``load_signal_endpoints``; options: endpoints (JSON of {stream_id: url}), log_dir (a URI that all executors reach,
    of this query alone), responses_per_turn, tasks (at most so many read at once), timeout."""

    @classmethod
    def name(cls) -> str:
        return "load_signal_endpoints"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Endpoints(self.options)


def read_endpoints(spark: SparkSession, urls: dict[int, str], log_dir: str, **options: str) -> DataFrame:
    """Samples of the endpoints, each a stream. A later start may add endpoints; one that is left out is read no further.

    Micro-batches follow each other even if nothing comes, so give the query a processing-time trigger.
    """
    if spark.sparkContext.getConf().get("spark.speculation", "false").lower() == "true":
        raise ValueError("two attempts of a task would share an endpoint's responses; unset spark.speculation")
    spark.dataSource.register(LoadSignalEndpoints)
    reader = spark.readStream.format("load_signal_endpoints").option("endpoints", json.dumps({str(k): v for k, v in urls.items()})).option("log_dir", log_dir)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
