"""Queries over events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import events as E
from runloom.plans.tables import table

_ORDER = ["ts", "event_id"]
_RANK = {"view": 0, "click": 1, "error": 2, "purchase": 3}


def events(s, d):
    e = table(s, d, "events")
    return e.withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "k": F.get_json_object("props", "$.k").cast("int")})


_E = "WITH e AS (SELECT *, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
_W = "PARTITION BY user_id ORDER BY ts, event_id"
_SEG = f""", n AS (SELECT *, row_number() OVER ({_W}) AS i, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER ({_W}) THEN 1 ELSE 0 END AS new FROM e),
g AS (SELECT *, sum(new) OVER ({_W}) AS segment FROM n),
s AS (SELECT user_id, CAST(segment AS BIGINT) AS segment, min(event_type) AS phase, min(i) AS first_event, max(i) AS last_event, count(*) AS n_events FROM g GROUP BY 1, 2)"""
_rank_sql = "CASE phase " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _RANK.items()) + " END"


def _rank():
    c = F.when(F.lit(False), 0)
    for k, v in _RANK.items():
        c = c.when(F.col("phase") == k, v)
    return c


def _segments(s, d):
    return E.segments(events(s, d), "user_id", _ORDER, "event_type")


QUERIES = {
    "q_events_durations": lambda s, d: E.durations(events(s, d), "user_id", _ORDER, "us").select("event_id", "user_id", "duration_seconds"),
    "q_events_segments": lambda s, d: _segments(s, d),
    "q_events_regressions": lambda s, d: E.regressions(_segments(s, d), "user_id", _rank()),
    "q_events_cumulative_distinct": lambda s, d: E.cumulative_distinct(events(s, d), "user_id", _ORDER, "k").select("event_id", "n_seen", "revisit"),
    "q_events_resources": lambda s, d: E.resource_summary(events(s, d), "user_id", "event_id", "k", "event_type"),
    "q_events_cycles": lambda s, d: E.cycles(events(s, d), "user_id", _ORDER, "event_type", "error", ["error", "view"], "click"),
    "q_events_elapsed": lambda s, d: E.elapsed(events(s, d), "user_id", "us"),
    "q_events_phase_statistics": lambda s, d: E.phase_statistics(E.durations(events(s, d), "user_id", _ORDER, "us"), "user_id", "event_type", "duration_seconds"),
    "q_events_test_counts": lambda s, d: E.test_counts(events(s, d).where("event_type IN ('error', 'view')"), "user_id", "k", "event_type", "error"),
    "q_events_steps": lambda s, d: E.steps(table(s, d, "conversations"), "conv_id", "turn", "role").groupBy("conv_id", "step").agg(F.count(F.lit(1)).alias("n")),
    "q_events_shortlist": lambda s, d: E.shortlist(events(s, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n")), [F.col("errors"), F.col("n"), F.col("user_id")], [True, True, False]),
    "q_events_suffixed_names": lambda s, d: E.suffixed(table(s, d, "events").select("event_id", F.col("event_type").alias("name")), "name", "event_id"),
}
SQL = {
    "q_events_durations": f"{_E} SELECT event_id, user_id, lead(us) OVER ({_W}) - us AS duration_seconds FROM e",
    "q_events_segments": _E + _SEG + " SELECT * FROM s",
    "q_events_regressions": _E + _SEG + f", r AS (SELECT user_id, {_rank_sql} AS r, lag({_rank_sql}) OVER (PARTITION BY user_id ORDER BY segment) AS b FROM s) SELECT user_id, count(*) AS n_segments, count(*) FILTER (b > r) AS n_regressions FROM r GROUP BY 1",
    "q_events_cumulative_distinct": f"{_E}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) = 1 AS fst FROM e) SELECT event_id, CAST(sum(CASE WHEN fst THEN 1 ELSE 0 END) OVER ({_W}) AS BIGINT) AS n_seen, NOT fst AS revisit FROM f",
    "q_events_resources": f"""{_E}, g AS (SELECT user_id, k, count(*) AS n, min(event_id) AS o FROM e GROUP BY 1, 2), t AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY 1, 2)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n_access, count(*) AS n_unique, count(*) FILTER (n > 1) AS n_revisited, arg_min(k, o) AS first_item,
  (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type || '=' || n) FROM t WHERE t.user_id = g.user_id) AS by_kind FROM g GROUP BY user_id""",
    "q_events_cycles": f"""{_E}, n AS (SELECT *, row_number() OVER ({_W}) AS i, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER ({_W}) AS ed, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS al FROM e),
t AS (SELECT *, lead(i) OVER ({_W}) AS ni, lead(event_type) OVER ({_W}) AS nk, lead(ed) OVER ({_W}) AS ne FROM n WHERE event_type IN ('error', 'view'))
SELECT user_id, i AS test_event, ni AS next_test, nk AS next_kind, CAST(coalesce(ne, al) - ed AS BIGINT) AS n_edits FROM t WHERE event_type = 'error'""",
    "q_events_elapsed": f"{_E} SELECT user_id, count(*) AS n_events, CASE WHEN count(us) >= 2 THEN max(us) - min(us) END AS elapsed FROM e GROUP BY 1",
    "q_events_phase_statistics": f"""{_E}, d AS (SELECT *, lead(us) OVER ({_W}) - us AS dur FROM e), g AS (SELECT user_id, event_type, count(*) AS n_events, CAST(coalesce(sum(dur), 0) AS BIGINT) AS seconds FROM d GROUP BY 1, 2)
SELECT *, 100.0 * n_events / sum(n_events) OVER (PARTITION BY user_id) AS share, row_number() OVER (PARTITION BY user_id ORDER BY n_events DESC, event_type) = 1 AS largest, row_number() OVER (PARTITION BY user_id ORDER BY seconds DESC, event_type) = 1 AS largest_by_time FROM g""",
    "q_events_test_counts": f"{_E} SELECT user_id, count(*) AS n_runs, count(*) FILTER (event_type = 'error') AS n_failed, count(*) - count(DISTINCT k) AS n_reruns FROM e WHERE event_type IN ('error', 'view') GROUP BY 1",
    "q_events_steps": "WITH c AS (SELECT conv_id, CAST(coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS step FROM conversations) SELECT conv_id, step, count(*) AS n FROM c GROUP BY 1, 2",
    "q_events_shortlist": "WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY 1) SELECT *, row_number() OVER (ORDER BY errors DESC, n DESC, user_id) AS rank FROM g",
    "q_events_suffixed_names": "SELECT event_id, event_type AS name, CASE WHEN row_number() OVER w > 1 THEN event_type || '_' || row_number() OVER w ELSE event_type END AS unique_name FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)",
}
