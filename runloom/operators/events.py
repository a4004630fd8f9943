"""Ordered events of cases: durations, segments, first sights, test and edit cycles, phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(case: str, order: list[str]):
    return Window.partitionBy(case).orderBy(*order)


def seconds(ts: Column) -> Column:
    """Epoch seconds from seconds or milliseconds."""
    return F.when(ts > 1e11, ts / 1000.0).otherwise(ts)


def durations(events: DataFrame, case: str, order: list[str], ts: str) -> DataFrame:
    """Seconds to the next event of the case; null for the last, and where time runs back."""
    d = F.lead(ts).over(_by(case, order)) - F.col(ts)
    return events.withColumn("duration_seconds", F.when(d >= 0, d))


def numbered(events: DataFrame, case: str, order: list[str]) -> DataFrame:
    return events.withColumn("event_idx", F.row_number().over(_by(case, order)) - 1)


def segments(events: DataFrame, case: str, order: list[str], phase: str) -> DataFrame:
    """Runs of equal phase: case, segment, phase, first and last event, number of events."""
    w = _by(case, order)
    e = events.withColumn("_i", F.row_number().over(w)).withColumn("_new", (~F.col(phase).eqNullSafe(F.lag(phase).over(w)) | (F.col("_i") == 1)).cast("int"))
    e = e.withColumn("segment", F.sum("_new").over(w))
    return e.groupBy(case, "segment").agg(F.first(phase).alias("phase"), F.min("_i").alias("first_event"), F.max("_i").alias("last_event"), F.count(F.lit(1)).alias("n_events"))


def regressions(segs: DataFrame, case: str, rank: Column) -> DataFrame:
    """For each case how often an ordered phase follows a later one; unordered phases (null rank) never count."""
    s = segs.withColumn("_r", rank)
    return s.withColumn("_b", F.lag("_r").over(_by(case, ["segment"]))).groupBy(case).agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(F.col("_b") > F.col("_r")).alias("n_regressions"))


def cumulative_distinct(events: DataFrame, case: str, order: list[str], item: str) -> DataFrame:
    """How many different items a case has seen up to each event, and whether it sees this one again."""
    first = F.row_number().over(Window.partitionBy(case, item).orderBy(*order)) == 1
    e = events.withColumn("_f", (first & F.col(item).isNotNull()).cast("long"))
    return e.withColumn("n_seen", F.sum("_f").over(_by(case, order))).withColumn("revisit", (F.col("_f") == 0) & F.col(item).isNotNull()).drop("_f")


def resource_summary(access: DataFrame, case: str, order: str, item: str, kind: str) -> DataFrame:
    """By case: accesses, different resources, those met more than once, first resource, accesses by kind."""
    g = access.groupBy(case, item).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    a = g.groupBy(case).agg(F.sum("_n").alias("n_access"), F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col("_n") > 1).alias("n_revisited"), F.min_by(item, "_o").alias("first_item"))
    k = access.groupBy(case, kind).agg(F.count(F.lit(1)).alias("_n")).groupBy(case).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(kind).cast("string"), F.lit("="), F.col("_n").cast("string")))), ",").alias("by_kind"))
    return a.join(k, case)


def cycles(events: DataFrame, case: str, order: list[str], kind: str, failed: str, test: list[str], edit: str) -> DataFrame:
    """Each failed test with the next test of its case and the edits between; to the end if no test follows.

    The edits between are a difference of running counts, so no range join is needed.
    """
    w = _by(case, order)
    e = events.withColumn("_i", F.row_number().over(w)).withColumn("_e", F.sum((F.col(kind) == edit).cast("long")).over(w))
    all_edits = F.max("_e").over(Window.partitionBy(case))
    e = e.withColumn("_all", all_edits).where(F.col(kind).isin(test))
    e = e.withColumns({"next_test": F.lead("_i").over(w), "next_kind": F.lead(kind).over(w), "_ne": F.lead("_e").over(w)})
    return e.where(F.col(kind) == failed).select(case, F.col("_i").alias("test_event"), "next_test", "next_kind", (F.coalesce("_ne", "_all") - F.col("_e")).alias("n_edits"))


def elapsed(events: DataFrame, case: str, ts: str) -> DataFrame:
    return events.groupBy(case).agg(F.count(F.lit(1)).alias("n_events"), F.when(F.count(ts) >= 2, F.max(ts) - F.min(ts)).alias("elapsed"))


def phase_statistics(events: DataFrame, case: str, phase: str, duration: str) -> DataFrame:
    """By case and phase: events, seconds and shares; and whether it is the largest by events and by time (ties: first by name)."""
    g = events.groupBy(case, phase).agg(F.count(F.lit(1)).alias("n_events"), F.coalesce(F.sum(duration), F.lit(0)).alias("seconds"))
    w = Window.partitionBy(case)
    g = g.withColumn("share", 100.0 * F.col("n_events") / F.sum("n_events").over(w))
    top = lambda c: F.row_number().over(w.orderBy(F.desc(c), phase)) == 1
    return g.withColumns({"largest": top("n_events"), "largest_by_time": top("seconds")})


def test_counts(tests: DataFrame, case: str, command: str, outcome: str, failed: str) -> DataFrame:
    return tests.groupBy(case).agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col(outcome) == failed).alias("n_failed"), (F.count(F.lit(1)) - F.count_distinct(command)).alias("n_reruns"))


def steps(messages: DataFrame, case: str, order: str, role: str, closes: str = "user") -> DataFrame:
    """Pages of messages: a step ends with each message of the closing role."""
    before = Window.partitionBy(case).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("step", F.coalesce(F.sum((F.col(role) == closes).cast("long")).over(before), F.lit(0)))


def shortlist(cases: DataFrame, order: list[Column], descending: list[bool]) -> DataFrame:
    """Ranks from 1 over all cases, for a triage table; the order should leave no ties."""
    from runloom.operators.ranks import numbered

    return numbered(cases, order, "rank", descending).withColumn("rank", F.col("rank") + 1)


def triage_shortlist(cases: DataFrame, order: str) -> DataFrame:
    """Triaged cases by include, priority, confidence and score, each from the top, ties as they came, with tags joined by |; failed ones come after all others, without a rank.

    cases: status, include, priority, confidence, score, tags (array) and the column order.
    """
    level = F.when(F.col("priority") == "high", 2).when(F.col("priority") == "medium", 1).otherwise(0)
    done = cases.where("status = 'completed'")
    keys = [F.coalesce("include", F.lit(False)).cast("int"), level, F.coalesce("confidence", F.lit(0.0)), F.coalesce("score", F.lit(0)), F.col(order)]
    ranked = shortlist(done, keys, [True, True, True, True, False])
    failed = cases.where("status IS NULL OR status != 'completed'").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(failed).withColumn("tags", F.array_join("tags", " | "))


def next_content(events: DataFrame, case: str, order: list[str], content: str = "content") -> DataFrame:
    """Adds evidence: an event's content and that of the next one."""
    return events.withColumn("evidence", F.concat_ws("\n", F.coalesce(content, F.lit("")), F.lead(content).over(_by(case, order))))


def suffixed(names: DataFrame, name: str, order: str) -> DataFrame:
    """Names made unique by _2, _3, … in order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return names.withColumn("unique_name", F.when(n > 1, F.concat(F.col(name), F.lit("_"), n.cast("string"))).otherwise(F.col(name)))


def access_to_targets(access: DataFrame, targets: DataFrame, case: str, path: str, target: str, order: str) -> DataFrame:
    """The first access to each target: paths match if equal or if one ends with / and the other. Joined by base name, then compared."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    a, t = access.withColumn("_b", base(F.col(path))), targets.withColumn("_b", base(F.col(target)))
    j = a.join(t, [case, "_b"]).where((F.col(path) == F.col(target)) | F.endswith(F.col(path), F.concat(F.lit("/"), F.col(target))) | F.endswith(F.col(target), F.concat(F.lit("/"), F.col(path))))
    return j.groupBy(case, target).agg(F.min(order).alias("first_access"), F.count(F.lit(1)).alias("n_access"))
