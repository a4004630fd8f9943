"""The driver's tables as the data model of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to several tasks a core: files of few bytes make few tasks, however many rows are made from them and however much work a row is."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4)


def runs(spark, sf: str) -> DataFrame:
    """orders as runs of their customer: status, cost in hundredths (whole numbers, so sums are exact), and from lineitem steps, files and transformations."""
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("instance_id"),
        F.col("o_orderkey").alias("sample_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "baseline").otherwise("mutant").alias("run_type"),
        F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "unresolved").otherwise("error").alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"),
        F.col("o_orderkey").alias("scan_order"),
    )
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("spt"))
    n = li.groupBy("l_orderkey", "spt").agg(F.count(F.lit(1)).cast("int").alias("c"), F.collect_set("l_partkey").alias("p"))
    n = n.groupBy("l_orderkey").agg(F.sum("c").alias("steps"), F.size(F.array_distinct(F.flatten(F.collect_list("p")))).cast("long").alias("files"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("spt", "c")))).alias("spt"))
    j = o.join(n, o["sample_id"] == n["l_orderkey"], "left").drop("l_orderkey")
    return j.withColumns({"steps": F.coalesce("steps", F.lit(0)), "files": F.coalesce("files", F.lit(0)), "spt": F.coalesce("spt", F.create_map().cast("map<string,int>"))})


RUNS_SQL = """
n AS (SELECT l_orderkey, count(*) AS steps, count(DISTINCT l_partkey) AS files FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, l_returnflag || l_linestatus AS spt, count(*) AS c FROM lineitem GROUP BY 1, 2),
k AS (SELECT l_orderkey, string_agg(spt, '+' ORDER BY spt) AS combo FROM s GROUP BY 1),
runs AS (
  SELECT o_custkey AS instance_id, o_orderkey AS sample_id, CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'mutant' END AS run_type,
    CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'unresolved' ELSE 'error' END AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cost,
    coalesce(steps, 0) AS steps, coalesce(files, 0) AS files, combo
  FROM orders LEFT JOIN n ON n.l_orderkey = o_orderkey LEFT JOIN k ON k.l_orderkey = o_orderkey)
"""
