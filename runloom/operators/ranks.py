"""Positions in a global order without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.session import written


def numbered(rows: DataFrame, order: list[Column], name: str = "position", descending: list[bool] | None = None) -> DataFrame:
    """rows with their positions from 0 in an order, which should leave no ties; descending tells which of its columns run down.

    Rows are range-partitioned and sorted, so partitions follow each other in order; a row's
    position is the number of rows in earlier partitions plus its place in its own. Only
    counts of partitions meet in one task.
    """
    cols = {f"_o{i}": c for i, c in enumerate(order)}
    keyed = rows.withColumns({n: c for n, c in cols.items()})
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    directed = [F.col(n).desc() if down else F.col(n) for n, down in zip(cols, descending or [False] * len(cols), strict=True)]
    spread = written(keyed.repartitionByRange(tasks, *directed).withColumn("_p", F.spark_partition_id()), "ranks")
    sizes = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_k"))
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_s")
    out = spread.join(F.broadcast(starts), "_p")  # a row for each partition
    out = out.withColumn(name, F.col("_s") + F.row_number().over(Window.partitionBy("_p").orderBy(*directed)) - 1)
    return out.drop("_p", "_s", *cols)

