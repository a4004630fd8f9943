"""Grading of patches by expected tests, and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASS, FAIL = ("PASSED", "XFAIL"), ("FAILED", "ERROR")


def graded(expected: DataFrame, results: DataFrame, keys: list[str], fail_only: Column | None = None) -> DataFrame:
    """Expected tests (keys, test, kind) with ok: true, false, or null where a status counts for neither.

    A test without a result has failed; a skipped one is neither. In fail-only mode whatever
    hasn't failed has passed.
    """
    j = expected.join(results, [*keys, "test"], "left")
    ok = F.when(F.col("status").isin(*PASS), True).when(F.col("status").isNull() | F.col("status").isin(*FAIL), False)
    if fail_only is not None:
        ok = F.when(fail_only, ~F.coalesce(F.col("status").isin(*FAIL), F.lit(False))).otherwise(ok)
    return j.withColumn("ok", ok)


def resolution(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of passed tests of each kind (1 if there are none) and FULL, PARTIAL or NO."""
    share = lambda k: F.coalesce(F.try_divide(F.count_if((F.col("kind") == k) & F.col("ok")).cast("double"), F.count_if((F.col("kind") == k) & F.col("ok").isNotNull())), F.lit(1.0))
    g = rows.groupBy(*keys).agg(share("f2p").alias("f2p"), share("p2p").alias("p2p"), F.count(F.lit(1)).alias("n_tests"))
    return g.withColumn("resolution", F.when((F.col("f2p") == 1) & (F.col("p2p") == 1), "FULL").when((F.col("f2p") > 0) & (F.col("f2p") < 1) & (F.col("p2p") == 1), "PARTIAL").otherwise("NO"))


def all_required_passed(required: DataFrame, passed: DataFrame, keys: list[str]) -> DataFrame:
    """By key whether each required test is among the passed ones, and how many are missing."""
    p = passed.select(*keys, "test").distinct().withColumn("_p", F.lit(1))
    return required.join(p, [*keys, "test"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_required"), F.count_if(F.col("_p").isNull()).alias("n_missing")).withColumn("resolved", F.col("n_missing") == 0)


def running_accuracy(rows: DataFrame, order: str, ok: Column, group: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("accuracy", F.avg(ok.cast("int")).over(w)).withColumn("seen", F.row_number().over(w))


def run_report(dataset: DataFrame, predictions: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """One class for each instance of the dataset: incomplete, empty, error, resolved or unresolved.

    predictions: key, patch; reports: key, resolved. The first that holds counts: no
    prediction, an empty patch, no report.
    """
    p = predictions.select(key, "patch", F.lit(True).alias("_p"))
    r = reports.select(key, "resolved", F.lit(True).alias("_r"))
    c = F.when(F.col("_p").isNull(), "incomplete").when(F.coalesce(F.trim("patch"), F.lit("")) == "", "empty").when(F.col("_r").isNull(), "error").when(F.col("resolved"), "resolved").otherwise("unresolved")
    return dataset.join(p, key, "left").join(r, key, "left").select(key, c.alias("class"))


def report_lists(classes: DataFrame, key: str) -> DataFrame:
    """(class, n, ids): the sorted ids of each class, for the run report of one dataset."""
    return classes.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("ids"))


def report_counts(classes: DataFrame, key: str) -> DataFrame:
    return classes.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"))


#: Projects whose tests count as passed unless they failed.
FAIL_ONLY = ("chartjs/Chart.js", "processing/p5.js", "markedjs/marked")
