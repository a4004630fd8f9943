"""The reports of a comparison of runs: statistics, errors, summary, and all of them as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators import runs as R
from runloom.operators import stats
from runloom.session import written
from runloom.sources.sinks import write_report


def _rounded(digits: int, **cols) -> list:
    return [F.round(c, digits).alias(n) for n, c in cols.items()]


def degradation_intervals(runs: DataFrame) -> DataFrame:
    """Of each instance with runs of both sides: degradation as a difference of rates, Newcombe's interval, numbers of runs."""
    ok = F.col("status") == R.RESOLVED
    side = lambda kind, p: runs.where(F.col("run_type") == kind).groupBy("instance_id").agg(F.count_if(ok).alias(f"x{p}"), F.count(F.lit(1)).alias(f"n{p}"))
    j = side("baseline", 1).join(side("mutant", 2), "instance_id")
    lo, hi = stats.newcombe(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2"))
    p1, p2 = F.col("x1") / F.col("n1"), F.col("x2") / F.col("n2")
    return j.select("instance_id", *_rounded(4, degradation=p1 - p2, newcombe_ci_lower=lo, newcombe_ci_upper=hi), F.col("n1").alias("n_baseline"), F.col("n2").alias("n_mutant"), p1.alias("p1"), p2.alias("p2"))


def statistics(runs: DataFrame, draws: int = 20_000, seed: int = 0) -> DataFrame:
    """One row: degradation_ci, degradation_binomial_ci, sign_flip_pvalue, and the intervals of the changes of steps and cost over all and over resolved runs.

    All are over instances that have runs of both sides, whatever the number of baseline
    runs. What has no instance is null. Percentage points and their bounds have four digits,
    changes two, the p value six. Runs and instances' rates are written once, and each
    resampling counts what is equal first.
    """
    runs = written(runs.select("instance_id", "run_type", "status", "steps", "cost"), "runs")
    per = written(degradation_intervals(runs).select("instance_id", "n_baseline", "n_mutant", "p1", "p2", (F.col("p1") - F.col("p2")).alias("d")), "rates")
    n = per.agg(F.mode("n_baseline", deterministic=True).alias("n1"), F.mode("n_mutant", deterministic=True).alias("n2"))
    boot = stats.bootstrap_counted(per.select("instance_id", (100 * F.col("d")).alias("d")), "d", draws, seed)
    boot = boot.select(F.when(F.col("n") > 0, F.struct(*_rounded(4, mean_pp=F.col("mean"), ci_lower_pp=F.col("lo"), ci_upper_pp=F.col("hi")), F.col("n").alias("n_instances"), F.lit(0.95).alias("confidence"), F.lit(draws).alias("n_boot"))).alias("degradation_ci"))
    redraw = stats.binomial_redraw(per.select("instance_id", "p1", "p2").join(F.broadcast(n)), draws, seed).join(F.broadcast(n))
    redraw = redraw.select(F.when(F.col("n") > 0, F.struct(*_rounded(4, mean_pp=F.col("mean"), ci_lower_pp=F.col("lo"), ci_upper_pp=F.col("hi")), F.col("n1").alias("n_baseline_per_instance"), F.col("n2").alias("n_mutant_per_instance"), F.col("n").alias("n_instances"), F.lit(0.95).alias("confidence"), F.lit(draws).alias("n_boot"))).alias("degradation_binomial_ci"))
    flip = stats.sign_flip_counted(per, "d").agg(F.round(F.max("p"), 6).alias("sign_flip_pvalue"))
    out = boot.join(F.broadcast(redraw)).join(F.broadcast(flip))
    c = stats.relative_changes(runs, ["steps", "cost"], F.col("status") == R.RESOLVED, draws, seed)
    one = lambda v, name: F.when(F.col(f"{v}_instances") > 0, F.struct(*_rounded(2, mean_pct=F.col(f"{v}_change"), ci_lower=F.col(f"{v}_lo"), ci_upper=F.col(f"{v}_hi")), F.col(f"{v}_instances").alias("n_instances"))).alias(name)
    c = c.select(*[one(f"{field}{part}", f"{short}_delta{name}_ci") for part, name in (("", ""), ("_some", "_resolved")) for field, short in (("steps", "step"), ("cost", "cost"))])
    return out.join(F.broadcast(c))


def errors(runs: DataFrame, min_baseline: int) -> DataFrame:
    """What the report leaves out, in one table: kind, instance_id, sample_id, n_baseline, n_mutant."""
    m = runs.where("run_type = 'mutant'")
    none = R.noop_split(m)[1].select(F.lit("no-op mutant").alias("kind"), F.col("instance_id").cast("string").alias("instance_id"), F.col("sample_id").cast("string").alias("sample_id"), F.lit(None).cast("long").alias("n_baseline"), F.lit(None).cast("long").alias("n_mutant"))
    side = R.one_sided(runs, min_baseline).where("reason != 'mutant only'")
    return none.unionByName(side.select(F.col("reason").alias("kind"), F.col("instance_id").cast("string").alias("instance_id"), F.lit(None).cast("string").alias("sample_id"), F.col("b").alias("n_baseline"), F.col("m").alias("n_mutant")))


def summary(runs: DataFrame) -> DataFrame:
    """One row: resolved runs and rates of both sides, baseline instances without mutants, the scoped baseline rate, pooled and mean degradation."""
    ok = F.col("status") == R.RESOLVED
    side = lambda kind, p: runs.where(F.col("run_type") == kind).agg(F.count_if(ok).alias(f"{p}_resolved"), F.count(F.lit(1)).alias(f"{p}_runs"), R.rate(ok).alias(f"{p}_rate"))
    _, alone = R.scoped(runs)
    p = R.pooled(runs).select(F.col("bl_rate").alias("scoped_baseline_rate"), F.col("bl_n").alias("scoped_baseline_runs"), "pooled_degradation", F.coalesce("mean_degradation", F.lit(0.0)).alias("mean_degradation"))
    return side("baseline", "baseline").join(F.broadcast(side("mutant", "mutant"))).join(F.broadcast(alone.agg(F.count_distinct("instance_id").alias("excluded_instances")))).join(F.broadcast(p))


def write_all(runs: DataFrame, path: str, min_baseline: int = 1, draws: int = 20_000, seed: int = 0) -> None:
    """The seven files of a report, as folders below path; empty ones aren't written.

    Mutants without a transformation are left out of all but errors.
    """
    kept = runs.where("run_type = 'baseline'").unionByName(R.noop_split(runs.where("run_type = 'mutant'"))[0])
    write_report(R.instance_report(kept, min_baseline), f"{path}/instances")
    write_report(kept, f"{path}/detailed")
    write_report(R.spt_report(kept).orderBy("spt"), f"{path}/spt_correlation")
    write_report(R.combination_report(kept).orderBy(F.desc("n_failed"), "first_seen"), f"{path}/spt_combinations")
    write_report(statistics(kept, draws, seed), f"{path}/statistics", "json")
    write_report(degradation_intervals(kept).drop("p1", "p2").orderBy("instance_id"), f"{path}/degradation_ci")
    write_report(errors(runs, min_baseline), f"{path}/errors")
