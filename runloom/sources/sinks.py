"""Reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.session import written


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report, which is small, as one CSV (null: empty) or JSON file; an empty one isn't written."""
    df = written(df, "report")
    if df.isEmpty():
        return
    one = df.coalesce(1)  # of a table that is there already
    if kind == "json":
        one.write.mode("overwrite").json(path)
    else:
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        one.select(*flat).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def spt_log(entries: DataFrame, sample: str, order: str) -> DataFrame:
    """The log of each sample as JSON, its entries numbered from 1."""
    e = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), "transformation", "file")))
    return entries.groupBy(sample).agg(F.to_json(F.transform(e, lambda x, i: F.struct((i + 1).alias("order"), x["transformation"].alias("transformation"), x["file"].alias("file")))).alias("spt_log"))


def exit_statuses(runs: DataFrame, status: str, key: str) -> DataFrame:
    return runs.groupBy(status).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("ids")).orderBy(F.desc("n"), status)


def write_cases(cases: DataFrame, path: str, key: str, index: list[str]) -> None:
    """Each case as JSON in a folder of its own below path/cases, and the columns of the index as one table."""
    df = written(cases, "cases")
    df.withColumn("_key", F.col(key)).write.mode("overwrite").partitionBy("_key").json(f"{path}/cases")
    write_report(df.select(key, *index).orderBy(key), f"{path}/index")
