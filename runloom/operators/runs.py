"""Runs of an agent, baseline against mutant: cleaning, sampling and reports.

A run has instance_id, sample_id, run_type ('baseline' or 'mutant'), status, steps, cost,
files, spt (map of transformation to count) and scan_order, which stands for the order in
which runs were found wherever the first or last of several counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLVED = "resolved"


def hashed(*cols: Column | str) -> Column:
    """A number from the md5 of the columns' text, the same in any engine; for sampling and shuffling."""
    text = F.concat_ws("|", *[c if isinstance(c, Column) else F.col(c) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def first_seen(runs: DataFrame, keys: list[str], order: str = "scan_order") -> DataFrame:
    """The first row of each key."""
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def capped(runs: DataFrame, cap: int, group: str = "instance_id", by: str = "sample_id") -> DataFrame:
    """At most `cap` rows of each group, those first by `by`."""
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(by))).where(F.col("_n") <= cap).drop("_n")


def noop_split(runs: DataFrame, spt: str = "spt") -> tuple[DataFrame, DataFrame]:
    """Runs with a transformation, and those without any."""
    none = F.coalesce(F.size(F.map_keys(spt)) < 1, F.lit(True))
    return runs.where(~none), runs.where(none)


def stratified(runs: DataFrame, n: int, group: str = "instance_id", stratum: Column | None = None, seed: str = "s", id_col: str = "sample_id") -> DataFrame:
    """At most n rows of each group, its strata in proportion by largest remainders.

    Each stratum gets the floor of its exact share; the slots left go to the largest
    fractions, ties by name. Rows are picked by a seeded hash of their ids.
    """
    s = stratum if stratum is not None else F.when(F.col("status") == RESOLVED, "resolved").otherwise("other")
    rows = runs.withColumn("_s", s)
    size = rows.groupBy(group, "_s").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(group)
    size = size.withColumn("_t", F.sum("_k").over(w)).withColumn("_exact", F.col("_k") * F.lit(n) / F.col("_t")).withColumn("_a", F.floor("_exact"))
    size = size.withColumn("_left", F.lit(n) - F.sum("_a").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(F.col("_exact") - F.col("_a")), "_s")))
    take = F.when(F.col("_t") <= n, F.col("_k")).otherwise(F.least(F.col("_k"), F.col("_a") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)))
    rows = rows.join(size.select(group, "_s", take.alias("_take")), [group, "_s"])
    pick = Window.partitionBy(group, "_s").orderBy(hashed(F.lit(seed), F.col(group), F.col(id_col)), id_col)
    return rows.withColumn("_n", F.row_number().over(pick)).where("_n <= _take").drop("_n", "_s", "_take")


def rate(ok: Column) -> Column:
    return F.coalesce(100.0 * F.avg(ok.cast("int")), F.lit(0.0))


def mean0(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def sd0(x: Column) -> Column:
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def _side(runs: DataFrame, kind: str, p: str) -> DataFrame:
    ok = F.col("status") == RESOLVED
    own = runs.where(F.col("run_type") == kind)
    per = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    counts = [F.count_if(F.col("status") == s).alias(f"{p}_{s}") for s in ("resolved", "unresolved", "empty", "error")]
    effort = [f(F.col(c)).alias(f"{p}_{c}_{n}") for c in ("steps", "cost", "files") for n, f in (("mean", mean0), ("sd", sd0))]
    split = [mean0(F.when(cond, F.col(c))).alias(f"{p}_{c}_{n}") for c in ("steps", "cost") for n, cond in (("ok", ok), ("failed", ~ok))]
    return own.groupBy("instance_id").agg(F.count(F.lit(1)).alias(f"{p}_n"), *counts, rate(ok).alias(f"{p}_rate"), *effort, *split, per("cost", "steps").alias(f"{p}_cost_per_step"), per("files", "steps").alias(f"{p}_files_per_step"))


def increase(m: Column, b: Column) -> Column:
    return F.when(b > 0, (m - b) / b * 100.0).otherwise(0.0)


def instance_report(runs: DataFrame, min_baseline: int = 1) -> DataFrame:
    """One row for each instance of either side: counts, rates, effort by outcome, increases, degradation.

    degradation (baseline rate less mutant rate) is null unless both sides have runs and the
    baseline at least min_baseline. One aggregation for each side and a full outer join.
    """
    j = _side(runs, "baseline", "bl").join(_side(runs, "mutant", "mt"), "instance_id", "full_outer")
    both = (F.coalesce("bl_n", F.lit(0)) >= min_baseline) & F.col("bl_n").isNotNull() & F.col("mt_n").isNotNull()
    zero = {c: 0 for c in j.columns if c != "instance_id"}
    out = j.withColumn("degradation", F.when(both, F.col("bl_rate") - F.col("mt_rate"))).na.fill(zero, subset=list(zero))
    return out.withColumns({f"{c}_increase": increase(F.col(f"mt_{c}_mean"), F.col(f"bl_{c}_mean")) for c in ("steps", "cost", "files")})


def spt_report(runs: DataFrame) -> DataFrame:
    """For each transformation: runs with it, failure rates with and without, and the lift between them.

    "Without" is all mutants less those with it: totals minus counts, so no run is compared
    with each transformation.
    """
    m = runs.where("run_type = 'mutant'")
    failed = (F.col("status") != RESOLVED).cast("int")
    with_ = m.select(F.explode("spt").alias("spt", "entries"), failed.alias("failed"), "steps", "cost")
    with_ = with_.groupBy("spt").agg(F.count(F.lit(1)).alias("n"), F.sum("failed").alias("n_failed"), F.avg("entries").alias("entries_mean"), mean0(F.when(F.col("failed") == 1, F.col("steps"))).alias("steps_failed"), mean0(F.when(F.col("failed") == 0, F.col("steps"))).alias("steps_ok"), F.avg("cost").alias("cost_mean"))
    total = m.agg(F.count(F.lit(1)).alias("_n"), F.sum(failed).alias("_f"))
    j = with_.join(F.broadcast(total))  # one row
    a, rest = 100.0 * F.col("n_failed") / F.col("n"), F.col("_n") - F.col("n")
    b = F.when(rest > 0, 100.0 * (F.col("_f") - F.col("n_failed")) / rest).otherwise(0.0)
    return j.withColumns({"failure_with": a, "failure_without": b, "lift": a - b}).drop("_n", "_f")


def spt_key(spt: str = "spt") -> Column:
    return F.array_join(F.array_sort(F.map_keys(spt)), "+")


def combination_report(runs: DataFrame) -> DataFrame:
    """For each set of transformations that ran together: runs, failures, rate; ranked by failures."""
    m = runs.where("run_type = 'mutant'").where(F.size("spt") > 0)
    g = m.groupBy(spt_key().alias("combination")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != RESOLVED).alias("n_failed"), F.min("scan_order").alias("first_seen"))
    return g.withColumn("failure_rate", 100.0 * F.col("n_failed") / F.col("n"))


def usage(runs: DataFrame) -> DataFrame:
    """For each instance its transformations as name(count), by count, ties by first appearance."""
    e = runs.where("run_type = 'mutant'").select("instance_id", "scan_order", F.explode("spt").alias("spt", "c"))
    g = e.groupBy("instance_id", "spt").agg(F.sum("c").alias("c"), F.min("scan_order").alias("o"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "o", "spt")))
    return g.groupBy("instance_id").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["spt"], F.lit("("), (-x["k"]).cast("string"), F.lit(")"))), ",").alias("usage"))


def outcome_rollup(runs: DataFrame) -> DataFrame:
    """Outcomes by instance and a row TOTAL."""
    g = runs.rollup("instance_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == RESOLVED).alias("n_resolved"), F.count_if(F.col("status") == "unresolved").alias("n_unresolved"), F.count_if(F.col("status") == "error").alias("n_error"), F.grouping("instance_id").alias("_g"))
    return g.withColumn("instance_id", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("instance_id").cast("string"))).drop("_g")


def one_sided(runs: DataFrame, min_baseline: int) -> DataFrame:
    """What a report leaves out and why: instances of one side only, and of a baseline below the guard."""
    n = runs.groupBy("instance_id").agg(F.count_if(F.col("run_type") == "baseline").alias("b"), F.count_if(F.col("run_type") == "mutant").alias("m"))
    why = F.when(F.col("m") == 0, "baseline only").when(F.col("b") == 0, "mutant only").when(F.col("b") < min_baseline, "low baseline")
    return n.select("instance_id", why.alias("reason"), "b", "m").where("reason IS NOT NULL")


def sample_count_mode(runs: DataFrame) -> DataFrame:
    """The most frequent number of runs of an instance on each side; ties give the least."""
    n = runs.groupBy("run_type", "instance_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("run_type").agg(F.mode("n", deterministic=True).alias("mode_n"), F.count(F.lit(1)).alias("instances"))


def scoped(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Baseline runs of instances that have mutants, and baseline runs of those that have none."""
    ids = runs.where("run_type = 'mutant'").select("instance_id").distinct()
    b = runs.where("run_type = 'baseline'")
    return b.join(ids, "instance_id", "left_semi"), b.join(ids, "instance_id", "left_anti")


def pooled(runs: DataFrame) -> DataFrame:
    """Pooled degradation over scoped runs, and the mean over instances with both sides."""
    s, _ = scoped(runs)
    ok = F.col("status") == RESOLVED
    a = s.agg(rate(ok).alias("bl_rate"), F.count(F.lit(1)).alias("bl_n"))
    b = runs.where("run_type = 'mutant'").agg(rate(ok).alias("mt_rate"), F.count(F.lit(1)).alias("mt_n"))
    c = instance_report(runs).agg(F.avg("degradation").alias("mean_degradation"), F.count("degradation").alias("instances"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).withColumn("pooled_degradation", F.col("bl_rate") - F.col("mt_rate"))
