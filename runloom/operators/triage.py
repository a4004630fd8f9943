"""What a case's prompt shows of it: features, compacted events, and a budget that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.text import truncated

#: Budgets of characters for events, the largest first, the least and most of an event, and the most of a prompt.
BUDGETS = (28_000, 12_000, 9_000, 6_000, 4_500, 3_000, 2_000, 1_200)
LEAST, MOST, PROMPT = 180, 850, 55_000


def _by(case: str):
    return Window.partitionBy(case)


def candidates(events: DataFrame, case: str = "case_id", issue: str | None = "is_issue") -> DataFrame:
    """Events but for system ones and the issue's own; all events of a case that has no others."""
    own = F.coalesce(F.col("role") != "system", F.lit(True))
    if issue is not None:
        own = own & ~F.coalesce(F.col(issue), F.lit(False))
    return events.withColumn("_own", own).withColumn("_any", F.max(F.col("_own").cast("int")).over(_by(case))).where("_own OR _any = 0").drop("_own", "_any")


def _shown(content: Column, budget: Column, head: Column) -> Column:
    long = F.length(content) > budget
    return F.struct(F.when(~long, content).alias("content"), F.when(long, F.left(content, head)).alias("content_start"), F.when(long, F.right(content, budget - head)).alias("content_end"), F.when(long, F.length(content)).alias("content_length"))


def compacted(events: DataFrame, budget: int = BUDGETS[0], case: str = "case_id") -> DataFrame:
    """candidates() with `shown`: the content, or 65 and 35 % of an event's part of the budget from its two ends."""
    c = candidates(events, case).withColumn("_b", F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(F.lit(budget) / F.count(F.lit(1)).over(_by(case))))).cast("int"))
    return c.withColumn("shown", _shown(F.coalesce("content", F.lit("")), F.col("_b"), F.floor(F.col("_b") * 0.65).cast("int"))).drop("_b")


def prompt_events(events: DataFrame, budget: int = 200_000, most: int = 12_000, case: str = "case_id") -> DataFrame:
    """All events with `shown`: half and half of an event's part of the budget, or nothing but the length where that part is 0."""
    e = events.withColumn("_b", F.least(F.lit(most), F.floor(F.lit(budget) / F.count(F.lit(1)).over(_by(case)))).cast("int"))
    text = F.coalesce("content", F.lit(""))
    none = F.struct(F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("content_start"), F.lit(None).cast("string").alias("content_end"), F.length(text).alias("content_length"))
    return e.withColumn("shown", F.when(F.col("_b") == 0, none).otherwise(_shown(text, F.col("_b"), F.floor(F.col("_b") / 2).cast("int")))).withColumn("omitted", F.col("_b") == 0).drop("_b")


def fitting_budget(events: DataFrame, fixed: DataFrame, most: int = PROMPT, case: str = "case_id") -> DataFrame:
    """(case, budget, n_chars): the first of BUDGETS with which a case's prompt has at most `most` characters, else the last.

    fixed: case, n_fixed, the characters of the prompt besides events. An event costs its
    shown characters. All budgets are tried in one pass over a case's events.
    """
    c = candidates(events, case).withColumn("_n", F.count(F.lit(1)).over(_by(case)))
    size = F.length(F.coalesce("content", F.lit("")))
    cost = [F.sum(F.least(size, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(F.lit(b) / F.col("_n")))))).alias(f"_{b}") for b in BUDGETS]
    g = c.groupBy(case).agg(*cost).join(fixed, case)
    total = lambda b: F.col("n_fixed") + F.col(f"_{b}")
    pick = F.struct(F.lit(BUDGETS[-1]).alias("budget"), total(BUDGETS[-1]).alias("n_chars"))
    for b in reversed(BUDGETS[:-1]):
        pick = F.when(total(b) <= most, F.struct(F.lit(b).alias("budget"), total(b).alias("n_chars"))).otherwise(pick)
    return g.select(case, pick.alias("x")).select(case, "x.*")


#: A case's features, which are columns of checks.composite() or of the case, and their types.
FEATURES = {
    "events": "long", "resolved": "boolean", "result_status": "string", "patch_applied": "boolean", "patch_exists": "boolean", "n_failures": "long", "test_runs": "long", "test_failures": "long", "test_reruns": "long", "patch_iterations": "long",
    "repeated_edits": "long", "backtracking": "long", "reversions": "long", "errors": "long", "unique_resources": "long", "spt_available": "boolean", "spt_entry_count": "long", "spt_applied": "boolean",
}


def features(checks: DataFrame, cases: DataFrame, files: DataFrame, case: str = "case_id", repeated: DataFrame | None = None, needed: tuple[str, ...] = ()) -> DataFrame:
    """One row for each case: ids, format, FEATURES and the files of its events' patches (files: case, file).

    Types are always the same; what neither table has is null, but for a feature in `needed`,
    which is an error, as is a name there that is no feature. repeated: case, file, events, as
    repeatedly_edited() gives them, becomes the map repeated_file_edits.
    """
    if unknown := set(needed) - set(FEATURES):
        raise ValueError(f"no such features: {', '.join(sorted(unknown))}")
    f = files.groupBy(case).agg(F.array_sort(F.collect_set("file")).alias("patched_files"))
    own = [c for c in cases.columns if c == case or c not in checks.columns]
    j = checks.join(cases.select(*own), case, "left").join(f, case, "left")
    if lacking := sorted(set(needed) - set(j.columns)):
        raise ValueError(f"neither table has {', '.join(lacking)}")
    kinds = {"case_name": "string", "format": "string", **FEATURES}
    there = [(F.col(c) if c in j.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
    out = j.select(case, *there, F.coalesce("patched_files", F.array().cast("array<string>")).alias("patched_files"))
    if repeated is None:
        return out
    r = repeated.groupBy(case).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("file"), F.col("events").cast("long"))))).alias("repeated_file_edits"))
    return out.join(r, case, "left").withColumn("repeated_file_edits", F.coalesce("repeated_file_edits", F.create_map().cast("map<string,bigint>")))


def compact_case(cases: DataFrame, keep: list[str], limit: int = 4000) -> DataFrame:
    """The columns of a case that a prompt shows, with its issue cut to limit characters."""
    return cases.select(*keep, truncated(F.col("issue_description"), limit).alias("issue_description"))


def compact_lists(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Array columns cut to their first entries, each with its whole length beside it."""
    return rows.withColumns({f"n_{c}": F.size(c) for c in limits} | {c: F.slice(c, 1, n) for c, n in limits.items()})
