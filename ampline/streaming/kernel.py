"""What is sequential within a stream: the event window, re-ordering and early answers, closing of slots; and all of it for samples.

State is bounded (a window of about a hundred features, a few tens of slots and waiting answers) and can be written
as JSON, so the same objects serve batch tasks and Structured Streaming state.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ampline.config import DetectorConfig

Point = tuple[float | None, float | None]


def _near(a: Point, b: Point, eps: float) -> bool:
    if None in a or None in b:
        return False
    dp, dq = a[0] - b[0], a[1] - b[1]
    return math.sqrt(dp * dp + dq * dq) <= eps


def clean_point(p: float | None, q: float | None) -> Point:
    return tuple(None if x is None or math.isnan(x) or math.isinf(x) else float(x) for x in (p, q))


class Clusters:
    """Disjoint sets of positions, each with its first and last one and its members, and the positions without a neighbour in order.

    With two points to a core, clusters don't depend on the order of arrival; loss is 0 for every pair of clusters with
    noise between them, so the first pair wins.
    """

    def __init__(self, config: DetectorConfig):
        self.config = config
        self.root: dict[int, int] = {}
        self.sets: dict[int, tuple[int, int, list[int]]] = {}
        self.noise: list[int] = []

    def add(self, seq: int, near: list[int]) -> None:
        """A position whose neighbours are in the sets of ``near``; only these sets are touched."""
        self.root[seq] = seq
        insort(self.noise, seq)
        for other in near:
            self._join(self.root[seq], self.root[other])

    def _taken(self, root: int) -> tuple[int, int, list[int]]:
        if root in self.sets:
            return self.sets.pop(root)
        del self.noise[bisect_left(self.noise, root)]
        return root, root, [root]

    def _join(self, a: int, b: int) -> None:
        if a == b:
            return
        (u1, v1, large), (u2, v2, small) = self._taken(a), self._taken(b)
        if len(large) < len(small):
            a, large, small = b, small, large
        for x in small:
            self.root[x] = a
        large += small
        self.sets[a] = min(u1, u2), max(v1, v2), large

    def drop_through(self, seq: int, tree: Callable[[int], int]) -> None:
        """Forgets positions up to ``seq``. Sets that lose members fall apart by ``tree``, the name of a position's part of what is left."""
        for root in [r for r, (u, _, _) in self.sets.items() if u <= seq]:
            parts: dict[int, list[int]] = {}
            for x in self.sets.pop(root)[2]:
                if x > seq:
                    parts.setdefault(tree(x), []).append(x)
            for members in parts.values():
                for x in members:
                    self.root[x] = members[0]
                if len(members) == 1:
                    insort(self.noise, members[0])
                else:
                    self.sets[members[0]] = min(members), max(members), members
        del self.noise[: bisect_right(self.noise, seq)]
        for x in [x for x in self.root if x <= seq]:
            del self.root[x]

    def interval(self) -> tuple[int, int] | None:
        """First and last noise position of the first fitting pair of clusters."""
        if not self.noise or len(self.sets) < 2:
            return None
        least = self.config.min_locality
        local = sorted((u, v) for u, v, members in self.sets.values() if len(members) >= least * (v - u + 1) - 1e-9)
        starts = [u for u, _ in local]
        for _, v in local:
            k = bisect_right(self.noise, v)
            if k < len(self.noise) and (second := bisect_right(starts, self.noise[k])) < len(starts):
                return self.noise[k], self.noise[bisect_left(self.noise, starts[second]) - 1]
        return None


class Window:
    """Features of a growing window, in order of position, and their clusters.

    Neighbours are looked for in grid cells so small that all points of one are neighbours, so one link to each cell is
    enough: to the newest neighbour in it. Of the links a forest is kept whose older ends are as young as can be (a maximum
    spanning forest); so when the oldest points go, what is left of the forest spans what is left of every cluster, and
    no distance is looked at again.
    """

    def __init__(self, config: DetectorConfig):
        self.config = config
        self.points: dict[int, Point] = {}
        self.cells: dict[tuple[int, int], list[int]] = {}
        self.up: dict[int, int | None] = {}  # the forest, each tree hung from its newest point
        self.clusters = Clusters(config)

    def _cell(self, point: Point) -> tuple[int, int]:
        side = 0.7 * self.config.eps or 1e-300
        return math.floor(point[0] / side), math.floor(point[1] / side)

    def _newest_near(self, point: Point) -> list[int]:
        """The newest neighbour in each cell within reach, newest first."""
        i, j = self._cell(point)
        found, cells, points, eps = [], self.cells, self.points, self.config.eps
        for x in range(i - 2, i + 3):
            for y in range(j - 2, j + 3):
                for seq in reversed(cells.get((x, y), ())):
                    if _near(points[seq], point, eps):
                        found.append(seq)
                        break
        return sorted(found, reverse=True)

    def add(self, seq: int, point: Point) -> None:
        """A point newer than all others."""
        near = [] if None in point else self._newest_near(point)
        self.points[seq], self.up[seq] = point, None
        if None not in point:
            self.cells.setdefault(self._cell(point), []).append(seq)
        for other in near:
            self._link(other, seq)
        self.clusters.add(seq, near)

    def _link(self, old: int, new: int) -> None:
        """Hangs ``old`` from ``new``, the newest point, if that makes no ring, or else if the ring has a link with an older end, which goes."""
        path = [old]
        while (above := self.up[path[-1]]) is not None:
            path.append(above)
        if path[-1] == new:
            oldest = min(range(len(path) - 1), key=lambda k: min(path[k], path[k + 1]))
            if min(path[oldest], path[oldest + 1]) >= old:
                return
            path = path[: oldest + 1]
        for k in range(len(path) - 1, 0, -1):
            self.up[path[k]] = path[k - 1]
        self.up[old] = new

    def drop_through(self, seq: int) -> None:
        gone = [s for s in self.points if s <= seq]
        for s in gone:
            if None not in self.points[s]:
                cell = self._cell(self.points[s])
                self.cells[cell].remove(s)
                if not self.cells[cell]:
                    del self.cells[cell]
            del self.points[s], self.up[s]
        for s, above in self.up.items():
            if above is not None and above <= seq:
                self.up[s] = None
        self.clusters.drop_through(seq, self._tree)

    def _tree(self, seq: int) -> int:
        while (above := self.up[seq]) is not None:
            seq = above
        return seq

    def interval(self) -> tuple[int, int] | None:
        return self.clusters.interval()

    def suffixes(self, interval: tuple[int, int]) -> tuple[int, tuple[int, int]]:
        """How many of the oldest points can go one by one while the rest fits, and the interval of the last rest that does.

        One pass from the newest point to the oldest, each linked to the newer ends of its links in the forest.
        """
        newer: dict[int, list[int]] = {}
        for s, above in self.up.items():
            if above is not None:
                newer.setdefault(min(s, above), []).append(max(s, above))
        rest, found = Clusters(self.config), []
        order = list(self.points)
        for s in reversed(order[1:]):
            rest.add(s, newer.get(s, []))
            found.append(rest.interval())
        best, dropped = interval, 0
        for fits in reversed(found):
            if fits is None:
                break
            best, dropped = fits, dropped + 1
        return dropped, best

    def tightened(self, interval: tuple[int, int]) -> tuple[int, int]:
        return self.suffixes(interval)[1]


@dataclass
class Event:
    s: int
    start: int
    end: int
    removed: int
    shift: int = 1

    @property
    def event_s(self) -> int:
        return (self.start + self.end) // 2 + self.shift


@dataclass
class Counters:
    arrivals: int = 0
    window_total: int = 0
    events: int = 0
    resets: int = 0


class InOrder:
    """Detection on features in order."""

    def __init__(self, config: DetectorConfig):
        if config.min_pts != 2:
            raise ValueError("the sequential detector takes min_pts = 2")
        self.config, self.window, self.bad, self.drift = config, Window(config), 0, 0
        self.counters = Counters()

    def add(self, seq: int, point: Point, is_bad: bool = False) -> Event | None:
        self.counters.arrivals += 1
        self.counters.window_total += len(self.window.points)
        if is_bad:
            self.bad += 1
            return None
        self.window.add(seq, point)
        found = self.window.interval()
        if found is None:
            return None
        start, end = self.window.tightened(found)
        removed, drift = found[1] if self.config.trim == "forward" else end, self.drift
        if self.config.trim == "v1":
            removed = min(s for s in self.window.points if s > end)
            self.drift -= 1
        self.window.drop_through(removed)
        self.counters.events += 1
        # positions are told as one more; the window's start may be told as less than it is
        return Event(seq, start + 1, end + 1, removed, drift + self.config.point_shift)

    def skip(self, n: int, test: bool) -> int | None:
        """``n`` bad features in order, at once; with ``test`` the window is tested for its size after each. Returns as reset_if_full."""
        size, room = len(self.window.points), self.config.max_window + 1
        until = max(room - size - self.bad, 1)
        self.counters.arrivals += n
        if not test or n < until:
            self.counters.window_total += n * size
            self.bad += n
            return None
        self.counters.window_total += until * size
        self.bad += until
        last = self.reset_if_full()
        self.counters.resets += (n - until) // room
        self.bad = (n - until) % room
        return last

    def reset_if_full(self) -> int | None:
        """Empties a window of more than max_window features, bad ones among them; returns the last position then."""
        if len(self.window.points) + self.bad <= self.config.max_window:
            return None
        last = max(self.window.points, default=None)
        self.window, self.bad, self.drift = Window(self.config), 0, 0
        self.counters.resets += 1
        return last

    def state(self) -> dict:
        return {"points": list(self.window.points.items()), "bad": self.bad, "drift": self.drift, "counters": vars(self.counters)}

    def load(self, state: dict) -> None:
        for seq, point in state["points"]:
            self.window.add(seq, tuple(point))
        self.bad, self.drift, self.counters = state["bad"], state["drift"], Counters(**state["counters"])


class Clean:
    """One answer for each feature as it comes: (s, d, event_s)."""

    def __init__(self, config: DetectorConfig):
        self.inner = InOrder(config)

    def feed(self, seq: int, p: float | None, q: float | None, is_bad: bool = False, clock: int = 0) -> list[tuple[int, int, int]]:
        event = self.inner.add(seq, clean_point(p, q))
        if event:
            return [(seq, 1, event.event_s)]
        self.inner.reset_if_full()
        return [(seq, 0, -1)]

    def advance(self, clock: int) -> list[tuple[int, int, int]]:
        return []

    def finish(self) -> list[tuple[int, int, int]]:
        return []

    def state(self) -> dict:
        return self.inner.state()

    def load(self, state: dict) -> None:
        self.inner.load(state)


@dataclass
class Reordered:
    """Features in the order in which their slots closed; answers early where there is surely no event.

    A feature that is surely no event is answered at once; else it waits. Features are put in order and the detector
    runs on the unbroken prefix. An event answers its trigger, even if that was answered 0 before (a correction); what
    waits and is in order then gets 0.

    A batch of which nothing has come by ``late_batches`` responses after its own counts as bad once that response is
    through (``advance``), unless ``strict_block`` makes it block for good. A stream starts ``late_batches`` before the
    first position that is fed, but not before 0; with ``strict_block`` at that position if 0 is further away.
    """

    config: DetectorConfig
    inner: InOrder = field(init=False)
    pending: dict[int, tuple[Point, bool]] = field(default_factory=dict)
    recent: dict[int, Point] = field(default_factory=dict)
    waiting: list[int] = field(default_factory=list)
    next_seq: int | None = None
    clock: int = -1

    def __post_init__(self):
        self.inner = InOrder(self.config)

    def early(self, seq: int, point: Point) -> int:
        """0: surely no event; 1: wait."""
        self.recent[seq] = point
        c = self.config
        if len(self.recent) < c.early_least or seq - min(self.recent) <= c.early_radius:
            return 0
        before = sorted((s for s in self.recent if s < seq), reverse=True)[: c.early_radius]
        for k in range(c.early_radius):
            if k >= len(before) or before[k] != seq - (k + 1):
                return 1
            if _near(point, self.recent[before[k]], c.eps):
                older = before[k + 1 : c.early_radius]
                return 0 if any(_near(self.recent[s], self.recent[before[k]], c.eps) for s in older) else 1
        return 0

    def _forget(self, through: int | None) -> None:
        if through is not None:
            for s in [s for s in self.recent if s <= through]:
                del self.recent[s]

    def feed(self, seq: int, p: float | None, q: float | None, is_bad: bool = False, clock: int = 0) -> list[tuple[int, int, int]]:
        late = self.config.late_batches
        if self.next_seq is None:
            self.next_seq = seq if self.config.strict_block and seq > late else max(0, seq - late)
        out = self.advance(clock - 1) if clock > self.clock else []
        self.clock = max(self.clock, clock)
        if seq < self.next_seq or seq in self.pending:
            return out  # a second feature of a batch, or one after its time
        point = clean_point(p, q)
        wait = self.early(seq, point)
        self.pending[seq] = (point, is_bad)
        events = self._drain(self.next_seq)
        if wait:
            self.waiting.append(seq)
        else:
            out.append((seq, 0, -1))
        return out + self._told(events)

    def advance(self, clock: int) -> list[tuple[int, int, int]]:
        """What the end of a response brings: batches that are overdue count as bad."""
        self.clock = max(self.clock, clock)
        if self.config.strict_block or not self.pending or self.next_seq > clock - self.config.late_batches:
            return []
        return self._told(self._drain(min(max(self.pending), clock - self.config.late_batches + 1)))

    def _told(self, events: list[Event]) -> list[tuple[int, int, int]]:
        out = []
        for event in events:
            out.append((event.s, 1, event.event_s))
            if event.s in self.waiting:
                self.waiting.remove(event.s)
        if self.config.legacy_reset and not events:
            self._forget(self.inner.reset_if_full())
        return out + self._release()

    def _drain(self, overdue: int) -> list[Event]:
        """Feeds what is in order; batches below ``overdue`` that are missing count as bad."""
        events = []
        while True:
            if self.next_seq in self.pending:
                point, is_bad = self.pending.pop(self.next_seq)
                event = self.inner.add(self.next_seq, point, is_bad)
                if event:
                    events.append(event)
                    self._forget(event.removed)
                elif not self.config.legacy_reset:
                    self._forget(self.inner.reset_if_full())
                self.next_seq += 1
            elif self.next_seq < overdue:
                after = min(overdue, min(self.pending, default=overdue))
                self._forget(self.inner.skip(after - self.next_seq, not self.config.legacy_reset))
                self.next_seq = after
            else:
                return events

    def _release(self) -> list[tuple[int, int, int]]:
        ready = sorted(s for s in self.waiting if s < self.next_seq)
        self.waiting = [s for s in self.waiting if s >= self.next_seq]
        return [(s, 0, -1) for s in ready]

    def finish(self) -> list[tuple[int, int, int]]:
        """Answers for what still waits when the stream has ended."""
        out = self.advance(self.clock)
        rest, self.waiting = sorted(self.waiting), []
        return out + [(s, 0, -1) for s in rest]

    def state(self) -> dict:
        return {"inner": self.inner.state(), "pending": list(self.pending.items()), "recent": list(self.recent.items()), "waiting": self.waiting, "next_seq": self.next_seq, "clock": self.clock}

    def load(self, state: dict) -> None:
        self.inner.load(state["inner"])
        self.pending = {s: (tuple(point), bad) for s, (point, bad) in state["pending"]}
        self.recent = {s: tuple(point) for s, point in state["recent"]}
        self.waiting, self.next_seq, self.clock = list(state["waiting"]), state["next_seq"], state["clock"]


class Slots:
    """Sums of the samples of open batches; ``close`` gives the features of those that a response closes."""

    def __init__(self, config: DetectorConfig):
        self.config = config
        self.open: dict[int, list[float]] = {}  # held, counted, vv, cc, vc
        self.closed_below, self.closed = 0, set()

    def add(self, seq: int, voltage: float, current: float) -> None:
        if seq < self.closed_below or seq in self.closed:
            return  # a straggler
        slot = self.open.setdefault(seq, [0, 0, 0.0, 0.0, 0.0])
        slot[0] += 1
        if slot[1] < self.config.samples_per_feature:
            slot[1] += 1
            slot[2] += voltage * voltage
            slot[3] += current * current
            slot[4] += voltage * current

    def add_many(self, seq: int, voltage: np.ndarray, current: np.ndarray) -> None:
        """As ``add`` for samples of one batch, in order."""
        if seq < self.closed_below or seq in self.closed:
            return
        slot = self.open.setdefault(seq, [0, 0, 0.0, 0.0, 0.0])
        n = min(len(voltage), self.config.samples_per_feature - slot[1])
        v, c = voltage[:n], current[:n]
        slot[0] += len(voltage)
        slot[1] += n
        for k, x in ((2, v * v), (3, c * c), (4, v * c)):
            slot[k] += float(x.sum())

    def close(self, response: int) -> list[tuple[int, float | None, float | None, bool]]:
        c = self.config
        due = [s for s, x in self.open.items() if x[0] == c.samples_per_feature or response - s >= c.late_batches]
        out = self.taken(sorted(due, key=lambda s: (s % c.ring_slots, s)))
        self.closed_below = max(self.closed_below, response - c.late_batches - c.ring_slots)
        self.closed = {s for s in self.closed if s >= self.closed_below}
        return out

    def taken(self, due: list[int]) -> list[tuple[int, float | None, float | None, bool]]:
        """The features of some slots, which are closed."""
        c, out = self.config, []
        for seq in due:
            held, counted, *sums = self.open.pop(seq)
            vv, cc, vc = ((x + (c.samples_per_feature - counted) * c.filler**2) / c.samples_per_feature for x in sums)
            apparent = math.sqrt(vv) * math.sqrt(cc)
            rest = apparent * apparent - vc * vc
            out.append((seq, math.log(vc) if vc > 0 else None, math.log(math.sqrt(rest)) if rest > 0 else None, held < c.good_share * c.samples_per_feature - 1e-9))
            self.closed.add(seq)
        return out

    def state(self) -> dict:
        return {"open": list(self.open.items()), "closed_below": self.closed_below, "closed": sorted(self.closed)}

    def load(self, state: dict) -> None:
        self.open = {s: list(x) for s, x in state["open"]}
        self.closed_below, self.closed = state["closed_below"], set(state["closed"])


KERNELS = {"clean": Clean, "reordered": Reordered}


class Machine:
    """Samples of one stream to answers (emit_ord, s, d, event_s), response by response."""

    def __init__(self, kind: str, config: DetectorConfig):
        self.kind, self.config = kind, config
        self.kernel, self.slots, self.emitted, self.response = KERNELS[kind](config), Slots(config), 0, -1

    def _told(self, answers: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        self.emitted += len(answers)
        return [(self.emitted - len(answers) + k, *x) for k, x in enumerate(answers)]

    def feed(self, arrival: np.ndarray, i: np.ndarray, voltage: np.ndarray, current: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Whole responses, in order of arrival and place (of a clean stream any samples in order)."""
        seq, out, size = i // self.config.samples_per_feature, [], self.config.samples_per_feature
        edges = np.flatnonzero(np.diff(arrival, prepend=arrival[0] - 1, append=arrival[-1] + 1)).tolist() if len(arrival) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if self.kind == "reordered":
                out += self._empty(int(arrival[a]))
            order = np.argsort(seq[a:b], kind="stable") + a
            parts = np.split(order, np.flatnonzero(np.diff(seq[order])) + 1)
            for part in parts:
                self.slots.add_many(int(seq[part[0]]), voltage[part], current[part])
            response = self.response = int(arrival[a])
            if self.kind == "reordered":
                for x in self.slots.close(response):
                    out += self.kernel.feed(*x, response)
                out += self.kernel.advance(response)
            else:  # a clean batch is closed by its own last sample
                whole = sorted({int(seq[part[0]]) for part in parts} & {s for s, x in self.slots.open.items() if x[0] == size})
                for x in self.slots.taken(whole):
                    out += self.kernel.feed(*x, x[0])
        return self._told(out)

    def _empty(self, before: int) -> list[tuple[int, int, int]]:
        """What responses without samples bring that lie between the last one and ``before``: slots whose time is over."""
        out, late = [], self.config.late_batches
        while (response := min((s + late for s in self.slots.open), default=before)) < before:
            for x in self.slots.close(response):
                out += self.kernel.feed(*x, response)
            out += self.kernel.advance(response)
        return out

    def end(self) -> list[tuple[int, int, int, int]]:
        """As if the stream had ended: open slots of a dirty stream are closed as they are, and what waits is answered."""
        out = []
        if self.kind == "reordered":
            ring = self.config.ring_slots
            for x in self.slots.taken(sorted(self.slots.open, key=lambda s: (s % ring, s))):
                out += self.kernel.feed(*x, self.response)
            out += self.kernel.finish()
        return self._told(out)

    def state(self) -> dict:
        return {"kernel": self.kernel.state(), "slots": self.slots.state(), "emitted": self.emitted, "response": self.response}

    def load(self, state: dict) -> None:
        self.kernel.load(state["kernel"])
        self.slots.load(state["slots"])
        self.emitted, self.response = state["emitted"], state["response"]
