"""The detector against models that are written out literally: every window clustered anew, positions counted by hand."""

import math
import random
from dataclasses import replace

import pytest

from ampline.config import DetectorConfig
from ampline.streaming.kernel import Clean, InOrder, Reordered, Slots, Window

C = DetectorConfig(eps=0.25, samples_per_feature=1000)


def near(a, b):
    return None not in a and None not in b and math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) <= 0.25


def labels(points):
    """Density clusters with two points to a core, from 1 in order; 0 is noise."""
    out = [0] * len(points)
    n = 0
    for k in range(len(points)):
        if out[k] or not any(j != k and near(points[j], points[k]) for j in range(len(points))):
            continue
        n += 1
        todo = [k]
        while todo:
            x = todo.pop()
            if not out[x]:
                out[x] = n
                todo += [j for j in range(len(points)) if near(points[j], points[x])]
    return out


def check(points):
    """The noise interval of the first pair of clusters that fits, as positions in ``points``."""
    found = labels(points)
    clusters = []
    for c in range(1, max(found, default=0) + 1):
        at = [k for k, x in enumerate(found) if x == c]
        if len(at) / (at[-1] - at[0] + 1) >= 0.2 - 1e-9:
            clusters.append(at)
    for a in clusters:
        for b in clusters:
            if a[-1] < b[0]:
                noise = [k for k, x in enumerate(found) if x == 0 and a[-1] < k < b[0]]
                if noise:
                    return noise[0], noise[-1]
    return None


def backward(points, found):
    """The interval of the last suffix that fits, as positions in ``points``."""
    best = found
    for i in range(1, len(points)):
        inner = check(points[i:])
        if inner is None:
            break
        best = (inner[0] + i, inner[1] + i)
    return best


def positional(points, version):
    """Answers of the detectors that keep a list of features and the number of its first one (v1, v2)."""
    window, start, out = [], 0, []
    for s, p in enumerate(points):
        if not window:
            start = s
        window.append(p)
        found = check(window)
        if found:
            first, last = (k + 1 for k in backward(window, found))
            out.append((s, 1, start + (first + last) // 2))
            del window[: last + 1 if version == "v1" else last]
            start += last
        else:
            if len(window) > 100:
                window = []
            out.append((s, 0, -1))
    return out


def numbered(points):
    """Answers of the detector that keeps features by their number and drops through the interval first found (v3)."""
    window, out = {}, []
    for s, p in enumerate(points):
        window[s] = p
        seqs = sorted(window)
        found = check([window[k] for k in seqs])
        if found:
            first, last = (seqs[k] + 1 for k in backward([window[k] for k in seqs], found))
            out.append((s, 1, (first + last) // 2 + 1))
            for k in seqs[: found[1] + 1]:
                del window[k]
        else:
            if len(window) > 100:
                window = {}
            out.append((s, 0, -1))
    return out


def stream(rng, n):
    out = []
    while len(out) < n:
        level = (rng.randrange(6) * 1.0, rng.randrange(3) * 1.0)
        out += [(level[0] + rng.choice([0, 0.125]), level[1]) for _ in range(rng.randint(1, 40))]
        out += [(rng.uniform(20, 90), rng.uniform(20, 90)) if rng.random() < 0.9 else (None, 1.0) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.1:
            out += [(100.0 + 3 * k, 0.0) for k in range(rng.randint(60, 130))]  # noise alone, until the window is full
    return out[:n]


def answers(points, config):
    kernel = Clean(config)
    return [x for s, (p, q) in enumerate(points) for x in kernel.feed(s, p, q)]


@pytest.mark.parametrize("seed", range(8))
def test_clean_answers_are_those_of_the_models(seed):
    points = stream(random.Random(seed), 320)
    want = numbered(points)
    assert answers(points, C) == want
    assert any(x[1] for x in want)
    assert answers(points, replace(C, trim="backward", point_shift=0)) == positional(points, "v2")
    assert answers(points, replace(C, trim="v1", point_shift=0)) == positional(points, "v1")


@pytest.mark.parametrize("seed", range(6))
def test_late_features_give_the_events_of_features_in_order(seed):
    rng = random.Random(seed)
    points = stream(rng, 250)
    order = sorted(range(250), key=lambda s: (s + rng.choice([0, 0, 0, rng.randint(1, 20)]), s))
    kernel = Reordered(C)
    got = [x for n, s in enumerate(order) for x in kernel.feed(s, *points[s], clock=n)] + kernel.finish()
    assert [x for x in got if x[1]] == [x for x in numbered(points) if x[1]]
    assert {x[0] for x in got} == set(range(250))
    assert len(got) == len({x[:2] for x in got})


@pytest.mark.parametrize("cut", [1, 7, 100])
def test_state_goes_through_json(cut):
    import json

    points, whole = stream(random.Random(cut), 150), Reordered(C)
    want = [x for s, (p, q) in enumerate(points) for x in whole.feed(s, p, q, s % 11 == 0, s)]
    got, kernel = [], Reordered(C)
    for s, (p, q) in enumerate(points):
        if s % cut == 0:
            state = json.dumps(kernel.state())
            kernel = Reordered(C)
            kernel.load(json.loads(state))
        got += kernel.feed(s, p, q, s % 11 == 0, s)
    assert got == want


def fitting(seqs, points):
    """As ``check`` for points at given positions, and in positions."""
    found = labels(points)
    sets = [[k for k, x in zip(seqs, found, strict=True) if x == c] for c in range(1, max(found, default=0) + 1)]
    sets = [at for at in sets if len(at) / (at[-1] - at[0] + 1) >= 0.2 - 1e-9]
    for a in sets:
        for b in sets:
            noise = [k for k, x in zip(seqs, found, strict=True) if x == 0 and a[-1] < k < b[0]]
            if a[-1] < b[0] and noise:
                return noise[0], noise[-1]
    return None


def rebuilt(window):
    """The interval of a window's points clustered anew, and the one that its suffixes tighten it to."""
    seqs = sorted(window.points)
    points = [window.points[k] for k in seqs]
    found = tight = fitting(seqs, points)
    for i in range(1, len(points) if found else 0):
        inner = fitting(seqs[i:], points[i:])
        if inner is None:
            break
        tight = inner
    return found, tight


@pytest.mark.parametrize("seed", range(12))
def test_kept_clusters_are_those_of_clustering_anew(seed):
    """Over points added, dropped up to any position, and windows emptied, with positions that are left out."""
    rng = random.Random(100 + seed)
    window, seq = Window(C), rng.choice([0, 10**9])
    spread = rng.choice([0.3, 1.0, 4.0])
    for p, q in stream(rng, 150) if seed % 3 == 0 else [(rng.uniform(0, spread), rng.uniform(0, spread / 3)) for _ in range(150)]:
        seq += rng.choice([1, 1, 1, 2, 7])
        window.add(seq, (p, q))
        found, tight = rebuilt(window)
        assert window.interval() == found
        assert found is None or window.tightened(found) == tight
        labelled = labels([window.points[k] for k in sorted(window.points)])
        assert window.clusters.noise == [k for k, x in zip(sorted(window.points), labelled, strict=True) if not x]
        assert sorted(sorted(m) for _, _, m in window.clusters.sets.values()) == sorted([k for k, x in zip(sorted(window.points), labelled, strict=True) if x == c] for c in range(1, max(labelled) + 1))
        if rng.random() < 0.08:
            window.drop_through(rng.choice(sorted(window.points)))
            assert window.interval() == rebuilt(window)[0]
        elif rng.random() < 0.01:
            window = Window(C)


def test_the_forest_keeps_the_youngest_links():
    """After every point the forest's links, by their older end, are those of a maximum spanning forest."""
    rng = random.Random(7)
    window = Window(C)
    for seq in range(80):
        window.add(seq, (rng.uniform(0, 1.2), rng.uniform(0, 1.2)))
        links = [min(s, x) for s, x in window.up.items() if x is not None]
        every = sorted(((a, b) for b in window.points for a in window.points if a < b and near(window.points[a], window.points[b])), reverse=True)
        group, want = {s: s for s in window.points}, []
        for a, b in every:
            if group[a] != group[b]:
                want.append(a)
                old, new = group[a], group[b]
                group = {s: new if g == old else g for s, g in group.items()}
        assert sorted(links) == sorted(want)


def drained(order, points, legacy):
    """Events of a detector that orders features by their number and tests for a full window after each (or once for each arrival)."""
    window, waiting, at, out, most = {}, {}, 0, [], 0
    for s in order:
        waiting[s] = points[s]
        fired = False
        while at in waiting:
            window[at] = waiting.pop(at)
            most = max(most, len(window))
            seqs = sorted(window)
            found = check([window[k] for k in seqs])
            if found:
                fired = True
                first, last = (seqs[k] + 1 for k in backward([window[k] for k in seqs], found))
                out.append((at, 1, (first + last) // 2 + 1))
                for k in seqs[: found[1] + 1]:
                    del window[k]
            elif not legacy and len(window) > 100:
                window = {}
            at += 1
        if legacy and not fired and len(window) > 100:
            window = {}
    return out, most


@pytest.mark.parametrize("seed", range(6))
def test_a_window_that_is_tested_once_an_arrival_may_outgrow_its_size(seed):
    rng = random.Random(50 + seed)
    points = [(100.0 + 3 * k, 0.0) for k in range(120)] + stream(rng, 160)
    order = sorted(range(len(points)), key=lambda s: (s + (20 if s in (85, 95) or (s > 120 and rng.random() < 0.05) else 0), s))
    for legacy in (False, True):
        kernel = Reordered(replace(C, legacy_reset=legacy))
        got = [x for n, s in enumerate(order) for x in kernel.feed(s, *points[s], clock=n)] + kernel.finish()
        want, most = drained(order, points, legacy)
        assert [x for x in got if x[1]] == want
        assert most > 101 if legacy else most <= 101


def early_model(recent, seq, point):
    """The rule for an early answer, written out; ``recent`` holds the points before."""
    held = {**recent, seq: point}
    if len(held) < 4 or seq - min(held) <= 7:
        return 0
    older = sorted((k for k in held if k < seq), reverse=True)
    for i in range(7):
        if i >= len(older) or older[i] != seq - i - 1:
            return 1
        if near(point, held[older[i]]):
            return 0 if any(near(held[k], held[older[i]]) for k in older[i + 1 : 7]) else 1
    return 0


@pytest.mark.parametrize("seed", range(4))
def test_early_answers_over_a_whole_stream(seed):
    rng = random.Random(70 + seed)
    points = stream(rng, 200)
    order = sorted(range(200), key=lambda s: (s + rng.choice([0, 0, 0, rng.randint(1, 20)]), s))
    kernel = Reordered(C)
    for n, s in enumerate(order):
        before = dict(kernel.recent)
        want = early_model(before, s, points[s])
        got = kernel.feed(s, *points[s], clock=n)
        late = [x for x in got if x[0] == s and x[1] == 0]
        if want == 0:
            assert late[:1] == [(s, 0, -1)]
        elif not late:
            assert s in kernel.waiting or any(x[0] == s and x[1] for x in got)


def test_a_batch_that_never_comes_counts_as_bad_after_its_time():
    """Batch 3 is missing: at the end of response 23 it counts as bad, not before."""
    kernel, held = Reordered(C), []
    for s in [k for k in range(30) if k != 3]:
        kernel.feed(s, *A, clock=s)
        held.append((s, kernel.next_seq))
        if s == 22:
            kernel.advance(22)
            assert kernel.next_seq == 3
        if s == 23:
            kernel.advance(23)
            assert kernel.next_seq == 24
    assert dict(held)[23] == 3
    assert kernel.inner.bad == 1
    # without the call, the next response's first feature tells that the one before is through
    other = Reordered(C)
    for s in [k for k in range(25) if k != 3]:
        other.feed(s, *A, clock=s)
    assert (other.next_seq, other.inner.bad) == (25, 1)
    # its own feature in response 23 is in time, one in response 24 is not
    for clock, bad in ((23, 0), (24, 1)):
        late = Reordered(C)
        for s in [k for k in range(clock + 1) if k != 3]:
            late.feed(s, *A, clock=s)
        late.feed(3, *A, clock=clock)
        assert late.inner.bad == bad


@pytest.mark.parametrize("strict", [False, True])
def test_a_stream_may_start_anywhere(strict):
    import time

    start, kernel = 10**9, Reordered(replace(C, strict_block=strict))
    began = time.perf_counter()
    points = [A] * 30 + [LONE] + [B] * 3
    got = [x for k, p in enumerate(points) for x in kernel.feed(start + k, *p, clock=start + k)]
    assert time.perf_counter() - began < 0.5
    assert got[0] == (start, 0, -1)
    assert [x for x in got if x[1]] == [(start + 32, 1, start + 32)]


def test_a_long_hole_is_as_many_bad_features():
    for hole in (1, 99, 100, 101, 102, 350):
        one, many = InOrder(C), InOrder(C)
        for s in range(7):
            one.add(s, (9.0 * s, 0.0))
            many.add(s, (9.0 * s, 0.0))
        one.skip(hole, True)
        for k in range(hole):
            many.add(7 + k, (None, None), True)
            many.reset_if_full()
        assert (one.bad, vars(one.counters), list(one.window.points)) == (many.bad, vars(many.counters), list(many.window.points))


A, B, LONE = (0.0, 0.0), (5.0, 0.0), (50.0, 50.0)


def test_a_step_is_found_where_it_is():
    got = answers([A] * 10 + [LONE] + [B] * 2, C)
    assert got == [(s, 0, -1) for s in range(12)] + [(12, 1, 12)]
    assert answers([A] * 10 + [LONE] + [B] * 2, replace(C, trim="backward", point_shift=0))[-1] == (12, 1, 11)


def test_no_event_without_noise_between():
    assert not any(x[1] for x in answers([A] * 10 + [B] * 10, C))
    assert not any(x[1] for x in answers([LONE, A, B, A, B, A, B], C))


def test_points_at_eps_are_neighbours():
    assert answers([(0.0, 0.0), (0.25, 0.0), LONE, B, B], C)[-1][1] == 1
    assert answers([(0.0, 0.0), (0.2500001, 0.0), LONE, B, B], C)[-1][1] == 0


@pytest.mark.parametrize(("span", "d"), [(10, 1), (11, 0)])
def test_a_cluster_of_two_may_span_ten_positions(span, d):
    lone = [(100.0 + 9 * k, 0.0) for k in range(span - 2)]
    assert answers([A, *lone, A, LONE, B, B], C)[-1][1] == d


@pytest.mark.parametrize(("n", "resets"), [(100, 0), (101, 1)])
def test_a_window_of_more_than_a_hundred_is_emptied(n, resets):
    inner = InOrder(C)
    for s in range(n):
        assert inner.add(s, (9.0 * s, 0.0)) is None
        inner.reset_if_full()
    assert (inner.counters.resets, inner.counters.arrivals) == (resets, n)
    assert inner.counters.window_total == n * (n - 1) // 2
    assert len(inner.window.points) == (0 if resets else 100)


@pytest.mark.parametrize(("n", "bad"), [(899, True), (900, False), (999, False)])
def test_quality_of_a_late_slot(n, bad):
    slots = Slots(C)
    for _ in range(n):
        slots.add(0, 3.0, 4.0)
    assert slots.close(19) == []
    [(seq, p, _, is_bad)] = slots.close(20)
    assert (seq, is_bad) == (0, bad)
    assert p == pytest.approx(math.log((12 * n + 4 * (1000 - n)) / 1000))


@pytest.mark.parametrize(("n", "closes"), [(999, False), (1000, True), (1001, False)])
def test_a_slot_closes_when_it_holds_its_samples(n, closes):
    slots = Slots(C)
    for _ in range(n):
        slots.add(3, 1.0, 1.0)
    assert bool(slots.close(3)) == closes
    assert len(slots.close(23)) == (0 if closes else 1)
    slots.add(3, 1.0, 1.0)  # a straggler
    assert slots.close(60) == []


def test_features_are_put_in_order():
    kernel = Reordered(C)
    frontier = []
    for s in (0, 1, 3, 4, 2):
        kernel.feed(s, *A, clock=s)
        frontier.append(kernel.next_seq - 1)
    assert frontier == [0, 1, 1, 1, 4]
    stuck = Reordered(replace(C, strict_block=True))
    for s in (0, 1, *range(3, 90)):
        stuck.feed(s, *A, clock=s)
    assert stuck.next_seq == 2
    freed = Reordered(C)
    for s in (0, 1, *range(3, 90)):
        freed.feed(s, *A, clock=s)
    assert freed.next_seq == 90


def test_early_answers_wait_before_a_hole_and_a_lone_pair():
    kernel = Reordered(C)
    for s in range(9):
        kernel.recent[s] = (9.0 * s, 0.0)
    assert kernel.early(9, (500.0, 0.0)) == 0  # no neighbour among seven
    assert kernel.early(10, (500.0, 0.0)) == 1  # a neighbour that has none
    assert kernel.early(11, (500.0, 0.0)) == 0  # a neighbour that has one
    assert kernel.early(13, (700.0, 0.0)) == 1  # 12 is missing
    assert Reordered(C).early(0, A) == 0


def test_degenerate_powers_are_noise():
    slots = Slots(replace(C, samples_per_feature=2))
    for v, c in ((2.0, 2.0), (2.0, 2.0), (3.0, -1.0), (1.0, -1.0)):
        slots.add(0 if c == 2.0 else 1, v, c)
    (_, p, q, _), (_, p2, _, _) = slots.close(1)
    assert p == pytest.approx(math.log(4))
    assert q is None
    assert p2 is None
    assert answers([(math.log(4), None)] * 5, C)[-1] == (4, 0, -1)
