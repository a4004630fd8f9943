"""Runs as they arrive: live counts, duplicates within a watermark, results that are still missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_outcomes(runs: DataFrame, status: str = "status") -> DataFrame:
    """Counts by status; write with output mode complete or update."""
    return runs.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def windowed_outcomes(runs: DataFrame, ts: str, status: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by status and window of event time; rows later than the watermark are dropped."""
    return runs.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), status).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), status, "n")


def without_duplicates(runs: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return runs.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def append_batch(batch: DataFrame, batch_id: int, target: str) -> None:
    """For foreachBatch: a folder for each batch, replaced if the batch comes again. The target is never read; nothing is there twice, and a batch that broke off leaves no part of it for good."""
    batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


_FLUSHED = "sample string, n int, bytes long, complete boolean"


def flush_samples(files: DataFrame, ts: str, last: str, late: str = "10 minutes") -> DataFrame:
    """One row for each sample as soon as its last file (named `last`) is there, or the watermark has passed all its files: sample, n, bytes, complete.

    files: sample, member, content and the event time ts. The state of a sample is two
    numbers, which go when it is flushed; files that come later start a new row.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, frames, state):
        if state.hasTimedOut:
            n, size = state.get
            state.remove()
            yield pd.DataFrame({"sample": [key[0]], "n": [n], "bytes": [size], "complete": [False]})
            return
        n, size = state.get if state.exists else (0, 0)
        done, at = False, 0
        for pdf in frames:
            n, size = n + len(pdf), size + int(pdf["size"].sum())
            done, at = done or bool((pdf["member"] == last).any()), max(at, int(pdf["at"].max()))
        if done:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"sample": [key[0]], "n": [n], "bytes": [size], "complete": [True]})
        else:
            state.update((n, size))
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))

    rows = files.withWatermark(ts, late).select("sample", "member", F.octet_length("content").alias("size"), F.unix_millis(ts).alias("at"), ts)
    return rows.groupBy("sample").applyInPandasWithState(run, _FLUSHED, "n int, size long", "append", GroupStateTimeout.EventTimeTimeout)


def append_missing(batch: DataFrame, target: str, key: str) -> None:
    """For foreachBatch: appends the rows whose key the target lacks, so a repeated batch changes nothing."""
    spark = batch.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    new = batch.dropDuplicates([key])
    if there:
        new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
    new.write.mode("append").parquet(target)
