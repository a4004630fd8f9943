"""Session defaults, and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "runloom", cores: str | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a temporary one where none is set.

    On a cluster without it there is no such folder, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    if not at:
        at = tempfile.mkdtemp(prefix="runloom-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/runloom-{name}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """Has a folder deleted when the session ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, computed once, kept as Parquet in the shared folder and read again.

    This cuts lineage: a lost executor costs no recomputation of what stands before. The
    folder goes when the session ends.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(gone_at_exit(df.sparkSession, path))


def bytes_of(df: DataFrame) -> int:
    """Spark's own estimate of df's size; for a table just written, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """df, a written table, with a broadcast hint if its files take up to `most` bytes.

    Above the bound the join shuffles both sides and adaptive execution splits skewed keys.
    """
    return F.broadcast(df) if bytes_of(df) <= most else df
