"""The detector as a Structured Streaming query, with the kernel of the batch form as keyed state.

A stream's state lies in variables of its own kind, and of these only what a micro-batch changes is written: open slots,
features that are not in order yet and recent features in map states, the window and waiting answers in list states, the rest
in a value state. Rows of a micro-batch are sorted by response and place and summed by slot, so a cut into micro-batches
between responses doesn't change the answers. With ``silence`` a timer closes a stream from which nothing comes any more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ampline.config import DetectorConfig
from ampline.operators.features import features_from_sums, quality, sums
from ampline.streaming.batch import RESULT
from ampline.streaming.kernel import Machine

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["stream_id", "emit_ord", "s", "d", "event_s"]
_POINT = "p double, q double"


class _Kept:
    """A machine's state in state variables; ``save`` writes what is not as it was loaded."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.maps = {
            "slots": handle.getMapState("slots", "seq long", "held long, counted long, vv double, cc double, vc double"),
            "pending": handle.getMapState("pending", "seq long", f"{_POINT}, bad boolean"),
            "recent": handle.getMapState("recent", "seq long", _POINT),
        }
        self.lists = {"window": handle.getListState("window", f"seq long, {_POINT}"), "waiting": handle.getListState("waiting", "seq long"), "closed": handle.getListState("closed", "seq long")}
        self.rest = handle.getValueState("rest", "next_seq long, clock long, bad long, drift long, arrivals long, window_total long, events long, resets long, closed_below long, emitted long, response long")
        self.timer = handle.getValueState("timer", "at long")

    @staticmethod
    def _flat(state: dict) -> tuple[dict, dict, tuple]:
        kernel, slots = state["kernel"], state["slots"]
        inner = kernel.get("inner", kernel)
        maps = {
            "slots": {s: tuple(x) for s, x in slots["open"]},
            "pending": {s: (*point, bad) for s, (point, bad) in kernel.get("pending", [])},
            "recent": {s: tuple(point) for s, point in kernel.get("recent", [])},
        }
        lists = {"window": [(s, *point) for s, point in inner["points"]], "waiting": [(s,) for s in kernel.get("waiting", [])], "closed": [(s,) for s in slots["closed"]]}
        rest = (kernel.get("next_seq"), kernel.get("clock"), inner["bad"], inner["drift"], *inner["counters"].values(), slots["closed_below"], state["emitted"], state["response"])
        return maps, lists, rest

    def load(self, machine: Machine) -> None:
        if self.rest.exists():
            maps = {name: {k[0]: tuple(v) for k, v in kept.iterator()} for name, kept in self.maps.items()}
            lists = {name: [tuple(x) for x in kept.get()] for name, kept in self.lists.items()}
            next_seq, clock, bad, drift, arrivals, total, events, resets, below, emitted, response = self.rest.get()
            counters = {"arrivals": arrivals, "window_total": total, "events": events, "resets": resets}
            inner = {"points": [(s, (p, q)) for s, p, q in lists["window"]], "bad": bad, "drift": drift, "counters": counters}
            kernel = inner if machine.kind == "clean" else {"inner": inner, "next_seq": next_seq, "clock": clock, "waiting": [s for (s,) in lists["waiting"]], "pending": [(s, ((p, q), bad)) for s, (p, q, bad) in maps["pending"].items()], "recent": sorted(maps["recent"].items())}
            machine.load({"kernel": kernel, "slots": {"open": list(maps["slots"].items()), "closed": [s for (s,) in lists["closed"]], "closed_below": below}, "emitted": emitted, "response": response})
            self.before = maps, lists
        else:
            self.before = {name: {} for name in self.maps}, {name: [] for name in self.lists}

    def save(self, machine: Machine) -> None:
        maps, lists, rest = self._flat(machine.state())
        for name, now in maps.items():
            old = self.before[0][name]
            for key in old.keys() - now.keys():
                self.maps[name].removeKey((key,))
            for key, value in now.items():
                if old.get(key) != value:
                    self.maps[name].updateValue((key,), value)
        for name, now in lists.items():
            old = self.before[1][name]
            if now[: len(old)] == old and old:
                if now[len(old) :]:
                    self.lists[name].appendList(now[len(old) :])
            elif now:
                self.lists[name].put(now)
            elif old:
                self.lists[name].clear()
        self.rest.update(rest)


class _Processor(StatefulProcessor):
    def __init__(self, kind: str, config: DetectorConfig, silence: float | None):
        self.kind, self.config, self.silence = kind, config, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, _Kept(handle)

    def _machine(self) -> Machine:
        machine = Machine(self.kind, self.config)
        self.kept.load(machine)
        return machine

    def _answers(self, key, machine: Machine, out: list) -> Iterator[pd.DataFrame]:
        self.kept.save(machine)
        yield pd.DataFrame([(int(key[0]), *x) for x in out], columns=COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["arrival", "pos"] if self.kind == "reordered" else ["i"], kind="stable")
        machine = self._machine()
        out = machine.feed(*(frame[c].to_numpy(t) for c, t in (("arrival", np.int64), ("i", np.int64), ("voltage", float), ("current", float))))
        if self.silence is not None:
            if self.kept.timer.exists():
                self.handle.deleteTimer(self.kept.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + int(self.silence * 1000)
            self.handle.registerTimer(at)
            self.kept.timer.update((at,))
        yield from self._answers(key, machine, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self._machine()
        out = machine.end()
        self.kept.timer.clear()
        yield from self._answers(key, machine, out)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        machine = self._machine()
        machine.load(json.loads(initialState["state"].iloc[0]))
        self.kept.save(machine)

    def close(self) -> None:
        pass


def detect_stream(samples: DataFrame, config: DetectorConfig, kind: str = "reordered", silence: float | None = None, start: DataFrame | None = None) -> DataFrame:
    """Streaming answers for a stream of samples (stream_id, arrival, pos, i, voltage, current). Takes the RocksDB state store.

    ``clean`` streams must bring their batches in order; a micro-batch may cut a batch anywhere. A dirty (``reordered``)
    stream may be cut between responses. With ``silence`` a stream from which nothing has come for so many seconds counts
    as ended: open slots are closed and what waits is answered; what comes later is taken as it would be without.
    ``start`` (stream_id, state), as of ``machine_states``, is where streams are taken over from a batch run.
    """
    plain = samples.selectExpr("stream_id", "arrival", "pos", "i", "cast(voltage as double) voltage", "cast(current as double) current")
    given = start.groupBy("stream_id") if start is not None else None
    return plain.groupBy("stream_id").transformWithStateInPandas(
        _Processor(kind, config, silence), outputStructType=RESULT, outputMode="Append", timeMode="None" if silence is None else "ProcessingTime", initialState=given
    )


def machine_states(samples: DataFrame, config: DetectorConfig, kind: str = "reordered") -> DataFrame:
    """stream_id, state: where the detector of each stream stands after all its samples, for ``detect_stream`` to go on from.

    Streams are dealt out over tasks and read in order, batch by batch; only a response that is cut is held over.
    """
    order = ["arrival", "pos"] if kind == "reordered" else ["i"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, machine, over = None, None, None

        def fed(rows: pd.DataFrame) -> None:
            machine.feed(*(rows[c].to_numpy(t) for c, t in (("arrival", np.int64), ("i", np.int64), ("voltage", float), ("current", float))))

        def state() -> tuple:
            fed(over)
            return stream, json.dumps(machine.state())

        for frame in frames:
            done = []
            for name, part in frame.groupby("stream_id", sort=False):
                if machine is not None and name != stream:
                    done.append(state())
                if machine is None or name != stream:
                    stream, machine, over = int(name), Machine(kind, config), part.iloc[:0]
                rows = pd.concat([over, part])
                last = rows["arrival"].to_numpy() == rows["arrival"].iloc[-1]
                cut = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
                fed(rows.iloc[:cut])
                over = rows.iloc[cut:]
            yield pd.DataFrame(done, columns=["stream_id", "state"])
        if machine is not None:
            yield pd.DataFrame([state()], columns=["stream_id", "state"])

    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = samples.selectExpr("stream_id", "arrival", "pos", "i", "cast(voltage as double) voltage", "cast(current as double) current")
    return plain.repartition(n, "stream_id").sortWithinPartitions("stream_id", *order).mapInPandas(run, "stream_id long, state string")


def event_time_features(samples: DataFrame, config: DetectorConfig, time: str = "ts", lateness: str = "20 seconds", every: str = "1 second") -> DataFrame:
    """Features of a stream by event time: stream_id, start, n_samples, ln_p, ln_q, is_bad of each ``every``, filled as gap_filled_features.

    A window is told once, when the greatest time seen is ``lateness`` past its end, however many responses that took; what
    comes later than that is dropped, and counted in the query's progress (``sums_dropped``). Responses that are empty or
    skewed don't move this clock, which is where it differs from slots that count responses. ``time`` is a timestamp.
    """
    rows = samples.withWatermark(time, lateness).withColumn("during", F.window(time, every))
    totals = sums(rows, "stream_id", "during")
    told = features_from_sums(totals, config, fill=True).withColumn("is_bad", quality(config))
    return told.select("stream_id", F.col("during.start").alias("start"), "n_samples", "ln_p", "ln_q", "is_bad")


def sums_dropped(query: StreamingQuery) -> int:
    """What came after its watermark, over the progress that the query still holds. A sum is what one task of a micro-batch has of one window."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])
