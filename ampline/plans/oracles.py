"""DuckDB SQL for the detector's queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

SIZE, EPS, GOOD, LATE = 10, 0.1, 9, 20

_CLEAN = f"""
samples AS (
  SELECT 0::BIGINT AS stream_id, event_id // {SIZE} AS arrival, event_id AS pos, event_id AS i,
         CAST(value AS DECIMAL(18,2)) AS voltage, CAST(json_extract(props, '$.k') AS DECIMAL(18,0)) AS "current"
  FROM events)"""
_DIRTY = (
    _CLEAN.replace("samples AS", "first_samples AS")
    + """,
kept AS (
  SELECT stream_id, arrival + CASE WHEN i % 13 = 0 THEN i % 23 ELSE 0 END AS arrival, i * 2 AS pos, i, voltage, "current"
  FROM first_samples WHERE i % 97 <> 0),
samples AS (
  SELECT * FROM kept
  UNION ALL SELECT stream_id, arrival, pos + 1, i, CAST(voltage + 1 AS DECIMAL(18,2)), "current" FROM kept WHERE i % 101 = 0)"""
)


def _powers(source: str, keys: str, fill: bool, more: str = "") -> str:
    """A table ``features`` of sums in ``source``: keys, n_samples, ln_p, ln_q."""
    missing = f"greatest({SIZE} - n_samples, 0) * 4" if fill else "0"
    return f"""
sums AS (
  SELECT {keys}, count(i) AS n_samples, coalesce(sum(voltage * voltage), 0) AS vv, coalesce(sum("current" * "current"), 0) AS cc,
         coalesce(sum(voltage * "current"), 0) AS vc FROM {source} GROUP BY ALL),
means AS (
  SELECT {keys}, n_samples, CAST(vv + {missing} AS DOUBLE) / {SIZE} AS mv, CAST(cc + {missing} AS DOUBLE) / {SIZE} AS mc,
         CAST(vc + {missing} AS DOUBLE) / {SIZE} AS p FROM sums),
powers AS (SELECT *, sqrt(mv) * sqrt(mc) AS apparent FROM means),
features AS (
  SELECT {keys}, n_samples, CASE WHEN p > 0 THEN ln(p) END AS ln_p,
         CASE WHEN apparent * apparent - p * p > 0 THEN ln(sqrt(apparent * apparent - p * p)) END AS ln_q{more}
  FROM powers)"""


_BAD = f", n_samples < {GOOD} AS is_bad"
_KEYED = f"keyed AS (SELECT *, i // {SIZE} AS seq FROM samples)"
_SHOWN = "round(ln_p, 6) AS ln_p, round(ln_q, 6) AS ln_q"
_FEATURES = f"{_CLEAN}, {_KEYED}, {_powers('keyed', 'stream_id, seq', False)}"
_WINDOWS = f"{_FEATURES}, w AS (SELECT *, seq // 100 AS window_id FROM features)"
_NEAR = f"""{_WINDOWS},
pairs AS (
  SELECT a.stream_id, a.window_id, a.seq AS a, b.seq AS b, sqrt((a.ln_p - b.ln_p) * (a.ln_p - b.ln_p) + (a.ln_q - b.ln_q) * (a.ln_q - b.ln_q)) AS distance
  FROM w a JOIN w b ON a.stream_id = b.stream_id AND a.window_id = b.window_id AND a.seq < b.seq
  WHERE sqrt((a.ln_p - b.ln_p) * (a.ln_p - b.ln_p) + (a.ln_q - b.ln_q) * (a.ln_q - b.ln_q)) <= {EPS}),
touched AS (SELECT stream_id, window_id, a AS seq FROM pairs UNION ALL SELECT stream_id, window_id, b FROM pairs)"""
_CLUSTERS = f"""{_NEAR},
edges AS (SELECT stream_id, window_id, a AS x, b AS y FROM pairs UNION ALL SELECT stream_id, window_id, b, a FROM pairs),
reach AS (
  SELECT stream_id, window_id, x, y FROM edges
  UNION SELECT r.stream_id, r.window_id, r.x, e.y FROM reach r JOIN edges e ON r.stream_id = e.stream_id AND r.window_id = e.window_id AND r.y = e.x),
roots AS (SELECT stream_id, window_id, x AS seq, least(x, min(y)) AS root FROM reach GROUP BY stream_id, window_id, x),
numbered AS (SELECT stream_id, window_id, seq, dense_rank() OVER (PARTITION BY stream_id, window_id ORDER BY root) AS cluster_id FROM roots),
clusters AS (
  SELECT w.stream_id, w.window_id, w.seq, coalesce(n.cluster_id, 0) AS cluster_id
  FROM w LEFT JOIN numbered n ON w.stream_id = n.stream_id AND w.window_id = n.window_id AND w.seq = n.seq),
stats AS (
  SELECT stream_id, window_id, cluster_id, min(seq) AS u, max(seq) AS v, count(*) AS cnt FROM clusters WHERE cluster_id > 0 GROUP BY ALL),
good AS (SELECT * FROM stats WHERE 5 * cnt >= v - u + 1)"""


def _stream_near(eps: float) -> str:
    apart = "sqrt((a.ln_p - b.ln_p) * (a.ln_p - b.ln_p) + (a.ln_q - b.ln_q) * (a.ln_q - b.ln_q))"
    return f"""{_FEATURES},
pairs AS MATERIALIZED (SELECT a.stream_id, a.seq AS a, b.seq AS b, {apart} AS distance FROM features a JOIN features b ON a.seq < b.seq WHERE {apart} <= {eps})"""


_STREAM_CLUSTERS = f"""{_stream_near(EPS / 2)},
ends AS MATERIALIZED (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
core AS MATERIALIZED (SELECT x AS seq FROM ends GROUP BY x HAVING count(*) + 1 >= 4),
links AS MATERIALIZED (SELECT x, y FROM ends WHERE x IN (SELECT seq FROM core) AND y IN (SELECT seq FROM core)),
label(seq, first_core) USING KEY (seq) AS (
  SELECT seq, seq FROM core
  UNION
  SELECT l.x, min(n.first_core) FROM label n JOIN links l ON l.y = n.seq JOIN recurring.label o ON o.seq = l.x
  WHERE n.first_core < o.first_core GROUP BY l.x),
border AS (SELECT e.x AS seq, min(n.first_core) AS first_core FROM ends e JOIN label n ON n.seq = e.y WHERE e.x NOT IN (SELECT seq FROM core) GROUP BY e.x),
told AS (SELECT * FROM label UNION ALL SELECT * FROM border)"""
_PAIRS = f"""{_CLUSTERS},
cpairs AS (
  SELECT a.stream_id, a.window_id, a.cluster_id AS c1, a.u AS u1, a.v AS v1, b.cluster_id AS c2, b.u AS u2, b.v AS v2
  FROM good a JOIN good b ON a.stream_id = b.stream_id AND a.window_id = b.window_id AND a.v < b.u)"""
_INTERVALS = f"""{_PAIRS},
intervals AS (
  SELECT p.*, min(c.seq) AS first_noise, max(c.seq) AS last_noise, count(*) AS n_noise
  FROM cpairs p JOIN clusters c ON p.stream_id = c.stream_id AND p.window_id = c.window_id AND c.cluster_id = 0 AND c.seq > p.v1 AND c.seq < p.u2
  GROUP BY ALL)"""
_LOSSES = f"""{_INTERVALS},
losses AS (
  SELECT t.*, (SELECT count(*) FROM clusters c WHERE c.stream_id = t.stream_id AND c.window_id = t.window_id
               AND ((c.cluster_id = t.c1 AND c.seq > t.first_noise - 1) OR (c.cluster_id = t.c2 AND c.seq < t.last_noise - 1))) AS loss
  FROM intervals t)"""
_BEST = f"""{_LOSSES},
best AS (SELECT * FROM losses WHERE loss <= 40 QUALIFY row_number() OVER (PARTITION BY stream_id, window_id ORDER BY loss, u1, u2) = 1)"""
_LATE = f"{_DIRTY}, late AS (SELECT *, arrival - i // {SIZE} AS lag FROM samples WHERE i < {SIZE} * arrival)"
_SLOTS = f"""{_DIRTY}, {_KEYED},
held AS (
  SELECT stream_id, seq, arrival, sum(count(*)) OVER (PARTITION BY stream_id, seq ORDER BY arrival) AS n FROM keyed GROUP BY stream_id, seq, arrival),
due AS (
  SELECT stream_id, seq, min(CASE WHEN n = {SIZE} THEN arrival END) AS whole, greatest(seq + {LATE}, min(arrival)) AS timeout
  FROM held GROUP BY stream_id, seq),
times AS (
  SELECT stream_id, seq, least(coalesce(whole, timeout), timeout) AS flush_at FROM due
  WHERE least(coalesce(whole, timeout), timeout) <= (SELECT max(arrival) FROM keyed)),
taken AS (
  SELECT k.*, t.flush_at FROM keyed k JOIN times t ON k.stream_id = t.stream_id AND k.seq = t.seq WHERE k.arrival <= t.flush_at
  QUALIFY row_number() OVER (PARTITION BY k.stream_id, k.seq ORDER BY k.arrival, k.pos) <= {SIZE})"""
# n_samples counts what a slot holds, of which the first SIZE are taken
_FLUSHED = f"{_SLOTS}, {_powers('taken', 'stream_id, seq, flush_at', True, _BAD)}"


_EARLY = f"""{_FEATURES},
past AS (
  SELECT stream_id, seq, ln_p, ln_q, min(seq) OVER (PARTITION BY stream_id) AS first_seq,
         list({{'seq': seq, 'p': ln_p, 'q': ln_q}}) OVER (PARTITION BY stream_id ORDER BY seq DESC ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS before
  FROM features),
marked AS (
  SELECT *, list_filter(range(1, len(before) + 1), lambda k: before[k].seq <> seq - k)[1] AS hole,
         list_filter(range(1, len(before) + 1), lambda k: coalesce(sqrt((before[k].p - ln_p) * (before[k].p - ln_p) + (before[k].q - ln_q) * (before[k].q - ln_q)) <= {EPS}, false))[1] AS hit
  FROM past)"""
_EARLY_ANSWER = f"""SELECT stream_id, seq, CAST(CASE
    WHEN seq - first_seq <= 7 THEN 0
    WHEN least(coalesce(hole, 8), coalesce(hit, 8)) = 8 THEN CASE WHEN len(before) < 7 THEN 1 ELSE 0 END
    WHEN coalesce(hole, 8) <= coalesce(hit, 8) THEN 1
    WHEN len(list_filter(before[hit + 1:], lambda x: coalesce(sqrt((x.p - before[hit].p) * (x.p - before[hit].p) + (x.q - before[hit].q) * (x.q - before[hit].q)) <= {EPS}, false))) > 0 THEN 0
    ELSE 1 END AS INT) AS answer FROM marked"""


def _bound(value: str, name: str, expression: str) -> str:
    return f"list_transform([{value}], lambda {name}: {expression})[1]"


def _interval(a: str, k: str) -> str:
    """The noise interval of the first fitting pair of clusters among the points a to k of ``seqs`` and ``links``, as a struct; null if none fits.

    Labels grow point by point: a point joins its earlier neighbours' clusters under its own number.
    """
    labels = (
        f"list_reduce(list_transform(range({a}, {k} + 1), lambda i: [i]), lambda acc, x: "
        + _bound(
            f"list_transform(list_filter(links[x[1]], lambda j: j >= {a}), lambda j: acc[j - {a} + 1])",
            "joined",
            "list_append(list_transform(acc, lambda l: CASE WHEN list_contains(joined, l) THEN x[1] ELSE l END), x[1])",
        )
        + ", []::BIGINT[])"
    )
    members = f"list_transform(list_distinct(labels), lambda l: list_transform(list_filter(range(1, len(labels) + 1), lambda j: labels[j] = l), lambda j: seqs[{a} + j - 1]))"
    spans = "list_transform(list_filter(members, lambda m: len(m) > 1), lambda m: {'u': list_min(m), 'v': list_max(m), 'n': len(m)})"
    clusters = f"list_sort(list_filter({spans}, lambda c: 5 * c.n >= c.v - c.u + 1))"
    noise = "list_transform(list_filter(members, lambda m: len(m) = 1 AND NOT list_contains(bads, m[1])), lambda m: m[1])"
    between = "list_filter(noise, lambda s: s > c1.v AND s < c2.u)"
    pairs = f"flatten(list_transform(clusters, lambda c1: list_transform(list_filter(clusters, lambda c2: c2.u > c1.v), lambda c2: {{'first': list_min({between}), 'last': list_max({between})}})))"
    return _bound(labels, "labels", _bound(members, "members", _bound(clusters, "clusters", _bound(noise, "noise", f"list_filter({pairs}, lambda x: x.first IS NOT NULL)[1]"))))


def _walk(features: str, forward: bool, shift: int, bad: str = "false") -> str:
    """Tables that end in ``answers`` (stream_id, k, s, d, event_s, held, reset, gone): the detector's window, moved feature by feature.

    ``features`` is the text of tables that end in ``features``. forward: whether an event removes what lies before the end of the
    interval first found, or of the tightened one. ``bad`` says which features only count. held: good features in the window
    before this one; gone: the last position that an event or a reset removes.
    """
    tight = _bound(
        "list_transform(range(w.a, w.k + 2), lambda b: " + _interval("b", "w.k + 1") + ")",
        "found",
        "{'first': found[1], 'best': found[list_filter(range(1, len(found) + 1), lambda j: found[j] IS NULL)[1] - 1]}",
    )
    end, distance = "first" if forward else "best", "sqrt((a.ln_p - b.ln_p) * (a.ln_p - b.ln_p) + (a.ln_q - b.ln_q) * (a.ln_q - b.ln_q))"
    good = lambda a, k: f"list_filter(range({a}, {k} + 1), lambda j: NOT list_contains(bads, seqs[j]))"
    return f"""{features},
ordered AS (SELECT stream_id, seq, ln_p, ln_q, {bad} AS bad, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS k FROM features),
near AS (
  SELECT b.stream_id, b.k, list(a.k ORDER BY a.k) AS links FROM ordered a JOIN ordered b ON a.stream_id = b.stream_id AND a.k < b.k AND a.k >= b.k - 101
  WHERE {distance} <= {EPS} AND NOT a.bad AND NOT b.bad GROUP BY ALL),
streams AS (
  SELECT o.stream_id, list(o.seq ORDER BY o.k) AS seqs, list(coalesce(n.links, []) ORDER BY o.k) AS links, coalesce(list(o.seq ORDER BY o.k) FILTER (o.bad), []) AS bads
  FROM ordered o LEFT JOIN near n ON o.stream_id = n.stream_id AND o.k = n.k GROUP BY ALL),
walk AS (
  SELECT stream_id, 0::BIGINT AS k, 1::BIGINT AS a, 0::BIGINT AS bad, 0::BIGINT AS held, NULL::STRUCT("first" STRUCT("first" BIGINT, "last" BIGINT), best STRUCT("first" BIGINT, "last" BIGINT)) AS event, 0 AS reset, NULL::BIGINT AS gone FROM streams
  UNION ALL
  SELECT stream_id, k, CASE WHEN event IS NOT NULL THEN list_filter(range(a, k + 1), lambda j: seqs[j] > event.{end}.last)[1] WHEN full_ THEN k + 1 ELSE a END, CASE WHEN full_ THEN 0 ELSE bad END,
         held, event, CAST(full_ AS INT), CASE WHEN event IS NOT NULL THEN event.{end}.last WHEN full_ THEN list_max(list_transform({good('a', 'k')}, lambda j: seqs[j])) END
  FROM (
    SELECT *, event IS NULL AND len({good('a', 'k')}) + bad > 100 AS full_, len({good('a', 'k - 1')}) AS held FROM (
      SELECT w.stream_id, w.k + 1 AS k, w.a, s.seqs, s.bads, w.bad + CAST(list_contains(s.bads, s.seqs[w.k + 1]) AS BIGINT) AS bad,
             CASE WHEN NOT list_contains(s.bads, s.seqs[w.k + 1]) AND {_interval("w.a", "w.k + 1")} IS NOT NULL THEN {tight} END AS event
      FROM walk w JOIN streams s ON w.stream_id = s.stream_id WHERE w.k < len(s.seqs)))),
answers AS (
  SELECT w.stream_id, k, seqs[k] AS s, CASE WHEN event IS NULL THEN 0 ELSE 1 END AS d,
         CASE WHEN event IS NULL THEN -1 ELSE (event.best.first + event.best.last + 2) // 2 + {shift} END AS event_s, held, reset, gone
  FROM walk w JOIN streams s ON w.stream_id = s.stream_id WHERE k > 0)"""


_METER = SIZE * 200
_METERS = f"""
{{}} AS (
  SELECT event_id // {_METER} AS stream_id, event_id % {_METER} // {SIZE} AS arrival, event_id % {_METER} AS pos, event_id % {_METER} AS i,
         CAST(value AS DECIMAL(18,2)) AS voltage, CAST(json_extract(props, '$.k') AS DECIMAL(18,0)) AS "current"
  FROM events)"""
_USERS = f"""numbered AS (
  SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, CAST(value AS DECIMAL(18,2)) AS voltage,
         CAST(json_extract(props, '$.k') AS DECIMAL(18,0)) AS "current" FROM events),
keyed AS (SELECT *, i // {SIZE} AS seq FROM numbered), {_powers('keyed', 'stream_id, seq', False)}"""


def _last_write(dirty: str) -> str:
    return f"""{dirty}, seen AS (SELECT DISTINCT stream_id, arrival AS seq FROM samples),
last AS (
  SELECT stream_id, arrival AS seq, i, voltage, "current" FROM samples WHERE i - {SIZE} * arrival BETWEEN 0 AND {SIZE - 1}
  QUALIFY row_number() OVER (PARTITION BY stream_id, arrival, i ORDER BY pos DESC) = 1),
rows AS (SELECT seen.stream_id, seen.seq, i, voltage, "current" FROM seen LEFT JOIN last ON seen.stream_id = last.stream_id AND seen.seq = last.seq),
{_powers('rows', 'stream_id, seq', True)}"""


_METER_WALK = _walk(f"{_METERS.format('samples')}, {_KEYED}, {_powers('keyed', 'stream_id, seq', False)}", True, 1)
_USER_WALK = _walk(_USERS, True, 1)
_DIRTY_METERS = _DIRTY.replace(_CLEAN.replace("samples AS", "first_samples AS"), _METERS.format("first_samples"))
_FILL_WALK = _walk(_last_write(_DIRTY_METERS), False, 0)
# every slot is closed by the last response at the latest
_CLOSED = _FLUSHED.replace(_DIRTY, _DIRTY_METERS).replace(
    """least(coalesce(whole, timeout), timeout) AS flush_at FROM due
  WHERE least(coalesce(whole, timeout), timeout) <= (SELECT max(arrival) FROM keyed)""",
    "least(coalesce(whole, timeout), timeout, (SELECT max(arrival) FROM keyed k WHERE k.stream_id = due.stream_id)) AS flush_at FROM due",
)
# the features in the order in which their slots close; each is put in order once all before it are closed
_REORDERED = f"""{_walk(_CLOSED, True, 1, "is_bad")},
closed AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY flush_at, seq % 30, seq) AS rank FROM features),
placed AS (SELECT *, max(rank) OVER (PARTITION BY stream_id ORDER BY seq) AS drained FROM closed),
forgotten AS (SELECT p.stream_id, p.drained, a.gone FROM placed p JOIN answers a ON p.stream_id = a.stream_id AND p.seq = a.s WHERE a.gone IS NOT NULL),
seen AS (SELECT p.*, coalesce((SELECT max(gone) FROM forgotten f WHERE f.stream_id = p.stream_id AND f.drained < p.rank), -1) AS gone FROM placed p),
recent AS (
  SELECT x.stream_id, x.seq, x.ln_p, x.ln_q, x.rank, x.drained, count(*) AS stored, min(y.seq) AS oldest,
         list({{'seq': y.seq, 'p': y.ln_p, 'q': y.ln_q}} ORDER BY y.seq DESC) FILTER (y.seq < x.seq) AS past
  FROM seen x JOIN placed y ON x.stream_id = y.stream_id AND y.rank <= x.rank AND y.seq > x.gone GROUP BY ALL),
before AS (SELECT * REPLACE (coalesce(past[:7], []) AS past) FROM recent),
marked AS (
  SELECT *, list_filter(range(1, 8), lambda k: k > len(past) OR past[k].seq <> seq - k)[1] AS hole,
         list_filter(range(1, len(past) + 1), lambda k: coalesce(sqrt((past[k].p - ln_p) * (past[k].p - ln_p) + (past[k].q - ln_q) * (past[k].q - ln_q)) <= {EPS}, false))[1] AS hit
  FROM before),
waits AS (
  SELECT *, CASE WHEN stored < 4 OR seq - oldest <= 7 THEN false
                 WHEN hole IS NOT NULL AND hole <= coalesce(hit, 8) THEN true
                 WHEN hit IS NULL THEN false
                 ELSE len(list_filter(past[hit + 1:], lambda x: coalesce(sqrt((x.p - past[hit].p) * (x.p - past[hit].p) + (x.q - past[hit].q) * (x.q - past[hit].q)) <= {EPS}, false))) = 0 END AS wait
  FROM marked),
told AS (
  SELECT stream_id, rank AS told_at, 0 AS phase, seq AS s, 0 AS d, -1 AS event_s FROM waits WHERE NOT wait
  UNION ALL SELECT a.stream_id, w.drained, 1, a.s, 1, a.event_s FROM answers a JOIN waits w ON a.stream_id = w.stream_id AND a.s = w.seq WHERE a.d = 1
  UNION ALL SELECT w.stream_id, w.drained, 2, w.seq, 0, -1 FROM waits w JOIN answers a ON a.stream_id = w.stream_id AND a.s = w.seq WHERE wait AND a.d = 0),
results AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY told_at, phase, s) - 1 AS emit_ord, s, d, event_s FROM told)"""
_FIRST = "SELECT stream_id, s, d, event_s FROM results QUALIFY row_number() OVER (PARTITION BY stream_id, s ORDER BY emit_ord) = 1"
_ANSWERS = "SELECT stream_id, k - 1 AS emit_ord, s, d, event_s FROM answers"
_SUFFIXES = f"""{_WINDOWS},
ordered AS (SELECT *, row_number() OVER (PARTITION BY stream_id, window_id ORDER BY seq) AS k FROM w),
near AS (
  SELECT b.stream_id, b.window_id, b.k, list(a.k ORDER BY a.k) AS links
  FROM ordered a JOIN ordered b ON a.stream_id = b.stream_id AND a.window_id = b.window_id AND a.k < b.k
  WHERE sqrt((a.ln_p - b.ln_p) * (a.ln_p - b.ln_p) + (a.ln_q - b.ln_q) * (a.ln_q - b.ln_q)) <= {EPS} GROUP BY ALL),
gathered AS (
  SELECT o.stream_id, o.window_id, count(*) AS n, []::BIGINT[] AS bads, list(o.seq ORDER BY o.k) AS seqs, list(coalesce(n.links, []) ORDER BY o.k) AS links
  FROM ordered o LEFT JOIN near n ON o.stream_id = n.stream_id AND o.window_id = n.window_id AND o.k = n.k GROUP BY ALL),
suffixes AS (SELECT *, unnest(range(1, n + 1)) AS a FROM gathered),
checked AS (SELECT stream_id, window_id, a, {_interval("a", "n")} AS found FROM suffixes),
fitting AS (SELECT *, min(CASE WHEN found IS NULL THEN a END) OVER (PARTITION BY stream_id, window_id) AS stop FROM checked)"""


def _with(tables: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables} {select}"


def _score(first: str) -> str:
    """Scores of first answers (stream_id, s, d) against the clean streams' answers."""
    return f"""SELECT x.stream_id, count(*) AS answers, count(*) FILTER (x.d = 1 AND t.d = 0) AS false_positives, count(*) FILTER (x.d = 0 AND t.d = 1) AS false_negatives, count(*) FILTER (t.d IS NULL) AS unknown
FROM ({first}) x LEFT JOIN ({_with(_METER_WALK, "SELECT stream_id, s, d FROM answers", True)}) t ON x.stream_id = t.stream_id AND x.s = t.s GROUP BY x.stream_id"""


ORACLES: dict[str, str] = {
    "samples_from_json": _with(_CLEAN, f'SELECT arrival, row_number() OVER (PARTITION BY arrival ORDER BY pos) - 1 AS pos, i, CAST(voltage AS DOUBLE) AS voltage, CAST("current" AS DOUBLE) AS "current" FROM samples'),
    "batch_id_projection": _with(_DIRTY, f"SELECT arrival, pos, i, i // {SIZE} AS seq, i - {SIZE} * arrival AS \"offset\" FROM samples"),
    "batch_offset_filter": _with(_DIRTY, f"SELECT arrival, pos, i, i - {SIZE} * arrival AS \"offset\" FROM samples WHERE i - {SIZE} * arrival BETWEEN 0 AND {SIZE - 1}"),
    "power_features": _with(_FEATURES, f"SELECT stream_id, seq, n_samples, {_SHOWN} FROM features"),
    "user_power_features": _with(_USERS, f"SELECT stream_id, seq, n_samples, {_SHOWN} FROM features"),
    "features_last_write_wins": _with(_last_write(_DIRTY), f"SELECT stream_id, seq, n_samples, {_SHOWN} FROM features"),
    "features_gap_filled": _with(f"{_DIRTY}, {_KEYED}, {_powers('keyed', 'stream_id, seq', True, _BAD)}", f"SELECT stream_id, seq, n_samples, {_SHOWN}, is_bad FROM features"),
    "feature_quality_flag": _with(f"{_DIRTY}, {_KEYED}", f"SELECT seq, count(*) AS n_samples, count(*) < {GOOD} AS is_bad FROM keyed GROUP BY seq"),
    "neighbor_pairs_stream": _with(_stream_near(EPS / 4), "SELECT stream_id, a, b, round(distance, 6) AS distance FROM pairs"),
    "dbscan_stream": _with(_STREAM_CLUSTERS, "SELECT f.stream_id, f.seq, t.first_core FROM features f LEFT JOIN told t ON t.seq = f.seq", True),
    "slot_flush": _with(_FLUSHED, f"SELECT stream_id, seq, flush_at, n_samples, {_SHOWN}, is_bad FROM features"),
    "stragglers": _with(_SLOTS, "SELECT k.arrival, k.pos, k.i, k.seq FROM keyed k JOIN times t ON k.stream_id = t.stream_id AND k.seq = t.seq WHERE k.arrival > t.flush_at"),
    "reorder_frontier": _with(
        _SLOTS,
        "SELECT stream_id, seq, flush_at, CASE WHEN count(*) OVER o = seq + 1 THEN max(flush_at) OVER o END AS released_at FROM times WINDOW o AS (PARTITION BY stream_id ORDER BY seq)",
    ),
    "quality_counters": _with(
        f"""{_DIRTY}, marked AS (
  SELECT *, i - {SIZE} * arrival AS off, lag(voltage) OVER (PARTITION BY stream_id, arrival, i ORDER BY pos) AS before FROM samples),
counts AS (
  SELECT stream_id, count(*) AS total, count(*) FILTER (off BETWEEN 0 AND {SIZE - 1} AND (before IS NULL OR before = 2)) AS normal,
         count(*) FILTER (off BETWEEN 0 AND {SIZE - 1} AND before <> 2) AS duplicates, count(*) FILTER (off < 0) AS delayed, count(DISTINCT arrival) AS responses
  FROM marked GROUP BY stream_id)""",
        f"SELECT stream_id, total, normal, duplicates, delayed, responses * {SIZE} - duplicates - delayed - normal AS missing FROM counts",
    ),
    "late_samples": _with(_LATE, "SELECT arrival, pos, i, lag FROM late"),
    "lateness_mean": _with(_LATE, "SELECT stream_id, CAST(sum(lag) // count(*) AS BIGINT) AS mean_lag FROM late GROUP BY stream_id"),
    "lateness_quartiles": _with(
        f"{_LATE}, sorted AS (SELECT stream_id, list(lag ORDER BY lag) AS x FROM late GROUP BY stream_id)",
        "SELECT stream_id, x[1] AS q0, x[len(x) // 4 + 1] AS q1, x[len(x) // 2 + 1] AS q2, x[3 * len(x) // 4 + 1] AS q3, x[len(x)] AS q4 FROM sorted",
    ),
    "lateness_histogram": _with(_LATE, "SELECT stream_id, lag, count(*) AS n FROM late GROUP BY ALL"),
    "feature_gap_count": _with(
        f"{_WINDOWS}, steps AS (SELECT *, lag(ln_p) OVER o AS p0, lag(ln_q) OVER o AS q0 FROM w WINDOW o AS (PARTITION BY stream_id, window_id ORDER BY seq))",
        f"SELECT stream_id, window_id, count(*) FILTER (sqrt((ln_p - p0) * (ln_p - p0) + (ln_q - q0) * (ln_q - q0)) > {EPS}) AS gaps FROM steps GROUP BY ALL",
    ),
    "neighbor_pairs": _with(_NEAR, "SELECT stream_id, window_id, a, b, round(distance, 6) AS distance FROM pairs"),
    "core_points": _with(_NEAR, "SELECT stream_id, window_id, seq, count(*) + 1 AS neighbours FROM touched GROUP BY ALL"),
    "noise_points": _with(_NEAR, "SELECT stream_id, window_id, seq FROM w WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.window_id = w.window_id AND t.seq = w.seq)"),
    "dbscan_window": _with(_CLUSTERS, "SELECT stream_id, window_id, seq, cluster_id FROM clusters", True),
    "cluster_stats": _with(_CLUSTERS, "SELECT *, round(cnt / (v - u + 1), 6) AS loc FROM stats", True),
    "locality_filter": _with(_CLUSTERS, "SELECT * FROM good", True),
    "cluster_size_histogram": _with(
        f"{_CLUSTERS}, sizes AS (SELECT window_id, cluster_id, count(*) AS size FROM clusters GROUP BY ALL)", "SELECT cluster_id, size, count(*) AS n FROM sizes GROUP BY ALL", True
    ),
    "cluster_kind_counters": _with(
        _CLUSTERS,
        'SELECT stream_id, window_id, count(*) FILTER (cluster_id = 0) AS noise, count(*) FILTER (cluster_id = 1) AS "first", count(*) FILTER (cluster_id > 1) AS others FROM clusters GROUP BY ALL',
        True,
    ),
    "cluster_pairs": _with(_PAIRS, "SELECT * FROM cpairs", True),
    "event_intervals": _with(_INTERVALS, "SELECT * FROM intervals", True),
    "pair_loss": _with(_LOSSES, "SELECT * FROM losses", True),
    "best_pair": _with(_BEST, "SELECT * FROM best", True),
    "event_point": _with(_BEST, "SELECT window_id, (first_noise + 1 + last_noise + 1) // 2 + 1 AS event_s FROM best", True),
    "early_answer": _with(_EARLY, _EARLY_ANSWER),
    "backward_suffix_check": _with(_SUFFIXES, "SELECT stream_id, window_id, a - 1 AS dropped, found.first AS start, found.last AS \"end\" FROM fitting WHERE a = stop - 1"),
    "detect_clean": _with(_METER_WALK, _ANSWERS, True),
    "detect_clean_stream": _with(_walk(_FEATURES, True, 1), _ANSWERS, True),
    "detect_clean_users": _with(_USER_WALK, _ANSWERS, True),
    "detect_counters": _with(_METER_WALK, "SELECT stream_id, count(*) AS arrivals, CAST(sum(held) AS BIGINT) AS window_total, CAST(sum(d) AS BIGINT) AS events, CAST(sum(reset) AS BIGINT) AS resets FROM answers GROUP BY stream_id", True),
    "detect_dirty_fill": _with(_FILL_WALK, _ANSWERS, True),
    "result_json": _with(_METER_WALK, "SELECT stream_id, s, '{\"s\":' || s || ',\"d\":' || d || ',\"event_s\":' || event_s || '}' AS body FROM answers", True),
    "detect_dirty_reorder": _with(_REORDERED, "SELECT * FROM results", True),
    "first_answers": _with(_REORDERED, _FIRST, True),
    "score_results": _score(_with(_REORDERED, _FIRST, True)),
    "score_fill_results": _score(_with(_FILL_WALK, "SELECT stream_id, s, d FROM answers", True)),
}
