"""Operator 1. Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.base import table, written

LAW = "rows"


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list) -> DataFrame:
    """`rank` (from 1) and `total` of each row within its group, without one task for a whole group.

    bucket is a column that rises with the order; its rows are ranked by themselves, and the
    counts of the buckets before are added. A bucket holds some thousands of rows, and a
    group's counts are one row for each bucket.
    """
    w = Window.partitionBy(*group).orderBy(bucket)
    before = (
        rows.groupBy(*group, bucket)
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
        .withColumn("total", F.sum("_c").over(Window.partitionBy(*group)))
        .drop("_c")
    )
    inside = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)))
    return inside.join(before, [*group, bucket]).withColumn("rank", F.col("_before") + F.col("_in")).drop("_before", "_in")


def assign_shards(
    df: DataFrame,
    shards: int = 8,
    *,
    key: str = "doc_id",
    stratum: str = "source",
    text: str = "text",
    seed: int = 17,
    bucket_rows: int = 50_000,
) -> DataFrame:
    """One row for each of df's: key, stratum, size, text_crc32, shard, slot.

    Rows are shuffled by a seeded hash within their stratum and ranked; rank r of n gets the
    place (r - 0.5) / n. Sorted by place over all strata, the rows are cut into contiguous
    runs, so shard sizes differ by one row at most, and each stratum has its share of each
    shard to within one row. slot numbers a shard's rows in this order, from 0.

    Null keys, texts and strata: a null text has size 1 and checksum 0; null is a stratum of
    its own; rows that agree in key and text are dealt in any order. An empty table gives no
    rows. Other columns of df aren't looked at.
    """
    text_bytes = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(
        F.col(key).alias("_key"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("_stratum"),
        (F.octet_length(text_bytes) + 1).cast("long").alias("size"),
        F.crc32(text_bytes).alias("text_crc32"),
    )
    rows = written(rows.withColumn("_hash", F.xxhash64(F.lit(seed), "_key", "text_crc32", "size")), "rows")
    n = rows.count()
    buckets = max(1024, -(-n // bucket_rows))
    high = F.shiftrightunsigned("_hash", 32)
    rows = rows.withColumn("_b", F.shiftright(high * F.lit(buckets).cast("long"), 32))
    ties = [F.col("_hash"), F.col("_key"), F.col("text_crc32"), F.col("size")]
    placed = _ranked(rows, ["_stratum"], "_b", [high, *ties]).withColumn("_place", (F.col("rank") - 0.5) / F.col("total")).drop("rank", "total", "_b")
    placed = placed.withColumn("_b", F.floor(F.col("_place") * buckets)).withColumn("_all", F.lit(0))
    out = _ranked(placed, ["_all"], "_b", [F.col("_place"), F.col("_stratum"), *ties])
    out = out.withColumn("shard", F.expr(f"cast((rank - 1) * {shards} div {max(n, 1)} as int)"))
    return out.select(
        F.col("_key").alias(key),
        F.when(F.col("_stratum") != "null", F.substring("_stratum", 2, 1 << 30)).alias(stratum),
        "size",
        "text_crc32",
        "shard",
        F.expr(f"rank - 1 - (shard * {n}L + {shards - 1}) div {shards}").alias("slot"),
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
