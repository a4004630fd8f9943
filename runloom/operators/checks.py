"""Deterministic checks of trajectories: commands, git, files, patches, tests, errors, and all of them by case.

events: case_id, event_idx, role, kind, content, tool_input, tool_status. Everything is a
projection, a window over a case's events, or an aggregation by case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.session import written
from runloom.functions import text as X

def commands(events: DataFrame) -> DataFrame:
    """(case_id, event_idx, n, command): the shell commands of agents' and tools' events, each once an event.

    A tool's input is a command by itself or has one under `command`; others stand in fenced blocks.
    """
    given = F.col("tool_input")
    own = F.when(F.try_parse_json(given).isNotNull() & given.rlike(r"^\s*\{"), F.get_json_object(given, "$.command")).otherwise(given)
    own = F.regexp_replace(F.coalesce(own, F.lit("")), r"^\s+|\s+$", "")
    all_ = F.array_distinct(F.concat(F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>")), X.shell_blocks(F.coalesce("content", F.lit("")))))
    e = events.where(F.col("role").isin("assistant", "tool") | (F.col("kind") == "tool"))
    return e.select("case_id", "event_idx", F.posexplode(all_).alias("n", "command"))


def git(cmds: DataFrame) -> DataFrame:
    """(case_id, event_idx, command, subcommand, category, is_reversion) of each git invocation."""
    g = cmds.select("case_id", "event_idx", F.explode(X.git_commands(F.col("command"))).alias("command"))
    category = X.git_class(F.col("command"))
    return g.select("*", X.git_subcommand(F.col("command")).alias("subcommand"), category.alias("category"), (category == "reversion").alias("is_reversion"))


def _has_diff(c: Column) -> Column:
    return F.contains(c, F.lit("diff --git")) | F.contains(c, F.lit("*** Update File:"))


def accesses(events: DataFrame, cmds: DataFrame) -> DataFrame:
    """(case_id, event_idx, resource, kind): files that commands name, by the command's kind, and those of diffs, as edits."""
    a = cmds.select("case_id", "event_idx", F.explode(X.file_tokens(F.col("command"))).alias("resource"), X.command_kind(F.col("command")).alias("kind"))
    b = events.where(_has_diff(F.col("content"))).select("case_id", "event_idx", F.explode(X.file_tokens(F.col("content"))).alias("resource"), F.lit("edit").alias("kind"))
    return a.unionByName(b).distinct()


def patches(events: DataFrame) -> DataFrame:
    """(case_id, event_idx, files, lines_added, lines_removed) of events that hold a patch; files by its headers."""
    c = F.col("content")
    p = events.where(_has_diff(c) | F.contains(c, F.lit("apply_patch")))
    lines = F.split(c, r"\r?\n")
    files = F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^\+\+\+ b/([^\r\n]+?)\s*$"), F.lit(1))))
    named = F.transform(F.regexp_extract_all(c, F.lit(r"\*\*\* (?:Update|Add|Delete) File:\s*([^\r\n]+)"), F.lit(1)), lambda x: F.trim(x))
    n = lambda mark: F.size(F.filter(lines, lambda x: x.startswith(mark) & ~x.startswith(mark * 3)))
    return p.select("case_id", "event_idx", F.when(F.size(files) > 0, files).otherwise(named).alias("files"), n("+").alias("lines_added"), n("-").alias("lines_removed"))


def repeatedly_edited(patched: DataFrame) -> DataFrame:
    """(case_id, file, events) of files that more than one event's patch has."""
    f = patched.select("case_id", "event_idx", F.explode("files").alias("file")).groupBy("case_id", "file")
    return f.agg(F.array_sort(F.collect_list("event_idx")).alias("events")).where(F.size("events") > 1)


def tests(events: DataFrame, cmds: DataFrame) -> DataFrame:
    """(case_id, event_idx, n, command, outcome) of each test run; the outcome is read from its event and the next one."""
    e = events.withColumn("evidence", F.concat_ws("\n", F.coalesce("content", F.lit("")), F.lead("content").over(Window.partitionBy("case_id").orderBy("event_idx"))))
    t = cmds.where(X.runs_tests(F.col("command"))).join(e.select("case_id", "event_idx", "evidence"), ["case_id", "event_idx"])
    return t.select("case_id", "event_idx", "n", "command", X.test_outcome(F.col("evidence")).alias("outcome"))


def iterations(ran: DataFrame, edits: DataFrame) -> DataFrame:
    """Each failed test run with the next run of a later event and how many events with edits lie between; to the end if none follows.

    edits: case_id, event_idx. Edits between are a difference of running counts.
    """
    t = ran.select("case_id", "event_idx", F.lit(1).alias("_t"), "n", "outcome")
    e = edits.select("case_id", "event_idx").distinct().select("*", F.lit(0).alias("_t"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("outcome"))
    u = t.unionByName(e)
    by = Window.partitionBy("case_id").orderBy("event_idx")  # peers of an event count together
    u = u.withColumn("_e", F.sum(1 - F.col("_t")).over(by)).withColumn("_all", F.sum(1 - F.col("_t")).over(Window.partitionBy("case_id")))
    later = by.rangeBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy("case_id").orderBy("event_idx").rangeBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("_before", F.coalesce(F.sum(1 - F.col("_t")).over(before), F.lit(0)))
    u = u.withColumn("next", F.min(F.when(F.col("_t") == 1, F.struct("event_idx", "n", "outcome", "_before"))).over(later))
    return u.where((F.col("_t") == 1) & F.col("outcome").isin("failed", "error")).select("case_id", "event_idx", "n", (F.coalesce("next._before", "_all") - F.col("_e")).alias("n_edits"), F.col("next.event_idx").alias("retest_event"), F.col("next.outcome").alias("retest_outcome"))


#: What tells of an error.
ERRORS = r"(?i)Traceback \(most recent call last\)|\b[A-Za-z_][A-Za-z0-9_]*(?:Error|Exception):|\bcommand failed\b|\btool error\b|\bERRORS?\b|\bFAILURES?\b"


def errors(events: DataFrame, issue: DataFrame | None = None) -> DataFrame:
    """(case_id, event_idx, matched, snippet, tool_status) of events that tell of an error, or whose tool failed.

    The snippet has 160 characters before and 300 after the first match. System events and
    the issue's own (issue: case_id, event_idx) are left out.
    """
    e = events.where(F.coalesce(F.col("role"), F.lit("")) != "system")
    if issue is not None:
        e = e.join(issue.select("case_id", "event_idx"), ["case_id", "event_idx"], "left_anti")
    c = F.coalesce("content", F.lit(""))
    found = c.rlike(ERRORS)
    matched = F.regexp_extract(c, ERRORS, 0)
    at = F.regexp_instr(c, F.lit(ERRORS))
    start = F.greatest(F.lit(1), at - 160)
    snippet = F.substring(c, start, at + F.length(matched) + 300 - start)
    e = e.where(found | F.col("tool_status").isin("error", "failed"))
    return e.select("case_id", "event_idx", F.when(found, matched).otherwise(F.concat(F.lit("tool status: "), F.col("tool_status"))).alias("matched"), F.when(found, snippet).otherwise(F.left(c, F.lit(460))).alias("snippet"), "tool_status")


def top_counts(rows: DataFrame, case: str, item: str, order: str, k: int) -> DataFrame:
    """The k most frequent items of each case with their counts; ties go to the one seen first."""
    g = rows.where(F.col(item).isNotNull()).groupBy(case, item).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy(F.desc("n"), "_o", item))).where(F.col("rank") <= k).drop("_o")


def evaluation_counts(tests_status: Column) -> Column:
    """Of a map of groups to their lists of successes and failures (JSON text): group -> (success, failure) counts."""
    m = F.from_json(tests_status, "map<string,struct<success:array<string>,failure:array<string>>>")
    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    return F.transform_values(m, lambda _, g: F.struct(n(g["success"]).alias("success"), n(g["failure"]).alias("failure")))


def evaluation_failures(counts: Column) -> Column:
    return F.coalesce(F.aggregate(F.map_values(counts), F.lit(0), lambda a, g: a + g["failure"]), F.lit(0))


def transformed_files(spt: DataFrame, access: DataFrame) -> DataFrame:
    """(case_id, file, n_mutations, kinds, first_event): mutated files, how they were accessed, and when first.

    spt: case_id, file, transformation. Paths match if they are equal, or one ends with / and
    the other; joined by base name.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    m = spt.select("case_id", X.normalized_path(F.col("file")).alias("file")).groupBy("case_id", "file").agg(F.count(F.lit(1)).alias("n_mutations")).withColumn("_b", base(F.col("file")))
    a = access.select("case_id", "event_idx", "kind", X.normalized_path(F.col("resource")).alias("resource")).withColumn("_b", base(F.col("resource")))
    same = (F.col("file") == F.col("resource")) | F.endswith("file", F.concat(F.lit("/"), "resource")) | F.endswith("resource", F.concat(F.lit("/"), "file"))
    hit = m.join(a, ["case_id", "_b"]).where(same).groupBy("case_id", "file").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.min("event_idx").alias("first_event"))
    return m.drop("_b").join(hit, ["case_id", "file"], "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))


def reconciled(cases: DataFrame) -> DataFrame:
    """Adds outcome, contradictions and summary.

    cases: resolved, patch_applied, n_failures (structured test failures), exit_status,
    submission. Resolved contradicts a patch that wasn't applied, failures that remain, and a
    run that ended in failure or error.
    """
    yes = F.coalesce(F.col("resolved"), F.lit(False))
    rules = {
        "patch not applied": yes & F.coalesce(~F.col("patch_applied"), F.lit(False)),
        "failures remain": yes & (F.coalesce("n_failures", F.lit(0)) > 0),
        "failed exit": yes & F.coalesce(F.lower("exit_status").isin("failed", "error"), F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(c, n) for n, c in rules.items()]), lambda x: x.isNotNull())
    submitted = F.coalesce(F.col("submission") != "", F.lit(False))
    said = F.when(F.col("resolved"), "resolved by the evaluator").when(~F.col("resolved") & ~submitted, "no patch was submitted").when(~F.col("resolved"), "a patch was submitted and not resolved").otherwise("no outcome is known")
    return cases.withColumns({"outcome": F.when(F.col("resolved"), "resolved").when(~F.col("resolved"), "unresolved").otherwise("unknown"), "contradictions": broken, "summary": said})


def composite(events: DataFrame, cases: DataFrame | None = None, issue: DataFrame | None = None) -> DataFrame:
    """One row for each case: all counts of the checks, and with cases (case_id and the columns of reconciled) also what they say.

    backtracking adds up reversions, failed test runs, and files with more than one edit.
    """
    cmds = written(commands(events), "commands")  # each is read more than once
    acc, pat, ran = (written(t, "checks") for t in (accesses(events, cmds), patches(events), tests(events, cmds)))
    gits = git(cmds)
    edits = acc.where("kind = 'edit'").select("case_id", "event_idx").unionByName(pat.select("case_id", "event_idx"))
    cyc = iterations(ran, edits)
    by = lambda t, **aggs: t.groupBy("case_id").agg(*[c.alias(n) for n, c in aggs.items()])
    one = F.count(F.lit(1))
    edited = acc.where("kind = 'edit'").groupBy("case_id", "resource").agg(one.alias("k")).where("k > 1")
    parts = [
        by(gits, git_commands=one, reversions=F.count_if("is_reversion")),
        by(acc.groupBy("case_id", "resource").agg(one.alias("k")), unique_resources=one, revisited_resources=F.count_if(F.col("k") > 1)),
        by(pat, patch_iterations=one),
        by(ran, test_runs=one, test_failures=F.count_if(F.col("outcome").isin("failed", "error")), test_reruns=one - F.count_distinct("command")),
        by(cyc, test_edit_cycles=one, edits_between=F.sum("n_edits")),
        by(edited, repeated_edits=one),
        by(errors(events, issue), errors=one),
    ]
    ts = [F.when(F.count("timestamp") >= 2, F.max("timestamp") - F.min("timestamp")).alias("elapsed")] if "timestamp" in events.columns else []
    out = events.groupBy("case_id").agg(one.alias("events"), *ts)
    for p in parts:
        out = out.join(p, "case_id", "left")
    counts = [c for p in parts for c in p.columns if c != "case_id"]
    out = out.na.fill(0, subset=counts).withColumn("backtracking", F.col("reversions") + F.col("test_edit_cycles") + F.col("repeated_edits"))
    return out if cases is None else out.join(reconciled(cases), "case_id", "left")
