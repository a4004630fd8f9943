"""Cases of a folder of trajectories: which results, logs and patches belong to which trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.functions.text import tri_state
from runloom.sources import trajectories

#: Names of result files.
RESULTS = ("result.json", "results.json", "report.json", "eval_results.json", "eval_results_detailed.json")


def is_result(name: Column) -> Column:
    """Whether a base name is that of a result file."""
    n = F.lower(name)
    return ~F.endswith(n, F.lit(".traj.json")) & (n.isin(*RESULTS) | F.endswith(n, F.lit("_output.json")))


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below root, paths from there."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.substring_index(F.regexp_replace(F.lit(root), "/+$", ""), "/", -1)
    below = F.expr("substring(path, instr(path, concat('/', _at, '/')) + length(_at) + 2)")
    return f.withColumn("_at", at).select(below.alias("path"), F.col("content").cast("string").alias("content"))


def folders(path: Column) -> Column:
    """All folders that a path lies in, the root "" first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def roots(found: DataFrame) -> DataFrame:
    """(path, root, has_results) of each trajectory among files (path).

    The root is the nearest folder above a trajectory that holds a result, as long as no other
    trajectory lies in it; else the highest folder with this trajectory alone. The top folder
    is a root only for trajectories that lie in it directly. All folders are counted once, by
    joins on their names.
    """
    at = found.select("path", F.posexplode(folders(F.col("path"))).alias("depth", "root"))
    t = at.where(F.endswith("path", F.lit(".traj.json")))
    alone = t.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    results = at.where(is_result(F.substring_index("path", "/", -1))).select("root").distinct().withColumn("_r", F.lit(True))
    t = t.withColumn("_deepest", F.max("depth").over(Window.partitionBy("path")))
    t = t.join(alone, "root").join(results, "root", "left").where(((F.col("_n") == 1) & ((F.col("depth") > 0) | (F.col("_deepest") == 0))) | (F.col("depth") == F.col("_deepest")))
    single = F.col("_n") == 1
    g = t.groupBy("path").agg(F.max_by("root", F.when(single & F.col("_r"), F.col("depth"))).alias("_with"), F.max(F.when(single & F.col("_r"), 1)).alias("_has"), F.min_by("root", F.when(single, F.col("depth"))).alias("_top"), F.max_by("root", "depth").alias("_own"))
    return g.select("path", F.when(F.col("_has") == 1, F.col("_with")).otherwise(F.coalesce("_top", "_own")).alias("root"), (F.coalesce("_has", F.lit(0)) == 1).alias("has_results"))


def artifact(found: DataFrame, where: DataFrame, name: str) -> DataFrame:
    """(root, path, content) of the first file of that name below each root."""
    f = found.where(F.substring_index("path", "/", -1) == name).select("path", "content", F.explode(folders(F.col("path"))).alias("root"))
    return f.join(where.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("path").alias("path"), F.min_by("content", "path").alias("content"))


def result_records(found: DataFrame, where: DataFrame) -> DataFrame:
    """(root, path, record_id, n_records, resolved, has_tests, has_patch, patch_applied, tests_status) of each record in a root's result files.

    A file is one record, or a map of ids to records or to plain results. What isn't JSON has none.
    """
    f = found.where(is_result(F.substring_index("path", "/", -1))).select("path", "content", F.explode(folders(F.col("path"))).alias("root"))
    f = f.join(where.where("has_results").select("root").distinct(), "root", "left_semi")
    m = F.from_json("content", "map<string,string>")
    bare = F.arrays_overlap(F.map_keys(m), F.array(F.lit("resolved"), F.lit("tests_status"), F.lit("patch_is_None")))
    one = F.array(F.struct(F.get_json_object("content", "$.instance_id").alias("key"), F.col("content").alias("value")))
    many = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    r = f.where(m.isNotNull()).select("root", "path", F.when(bare, one).otherwise(many).alias("_r")).select("root", "path", F.size("_r").alias("n_records"), F.explode("_r").alias("_e"))
    v = F.col("_e.value")
    is_object = v.rlike(r"^\s*\{")
    get = lambda k: F.when(is_object, F.get_json_object(v, f"$.{k}"))
    status = get("tests_status")
    return r.select("root", "path", "n_records", F.coalesce(get("instance_id"), F.col("_e.key")).alias("record_id"), F.when(is_object, tri_state(get("resolved"))).otherwise(tri_state(v)).alias("resolved"), F.coalesce(status.rlike(r"^\s*\{"), F.lit(False)).alias("has_tests"), get("patch_successfully_applied").isNotNull().alias("has_patch"), tri_state(get("patch_successfully_applied")).alias("patch_applied"), status.alias("tests_status"))


def discovered(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(cases, errors) of a folder: each trajectory with its root and best result, or why it can't be read.

    cases: path, root, case_id, dialect, trajectory, result status and what it says, the log
    of transformations and the submitted patch.
    """
    from runloom.sources.archives import match_results

    found = files(spark, root)
    t = found.where(F.endswith("path", F.lit(".traj.json")))
    v = F.try_parse_json("content")
    why = F.when(v.isNull() | ~F.col("content").rlike(r"^\s*\{"), "not a JSON object").when(~F.coalesce(F.get_json_object("content", "$.messages").rlike(r"^\["), F.lit(False)), "messages must be a list")
    p = trajectories.parsed(t.withColumn("error", why), "content")
    has = lambda k: F.exists("messages", lambda m: F.get_json_object(m, f"$.{k}").isNotNull())
    p = p.withColumn("error", F.coalesce("error", F.when(~has("parts") & ~has("content"), "neither dialect's messages")))
    good = p.where("error IS NULL").join(roots(found), "path")
    good = good.withColumn("trajectory_id", F.get_json_object("content", "$.instance_id"))
    results = result_records(found, good)
    ids = good.select("root", F.col("path").alias("case_id"), F.coalesce("trajectory_id", F.lit("")).alias("trajectory_id"), "path")
    matched = match_results(ids, results).withColumnRenamed("case_id", "path").withColumnRenamed("status", "result_status")
    spt = artifact(found, good, "spt_log.json").select("root", F.col("content").alias("spt_log"))
    patch = artifact(found, good, "patch.diff").select("root", F.col("content").alias("_patch"))
    c = good.join(matched, "path", "left").join(spt, "root", "left").join(patch, "root", "left")
    name = F.substring_index("root", "/", -1)
    c = c.withColumns({"case_name": name, "case_id": F.coalesce("record_id", "trajectory_id", name), "submission": F.coalesce(F.get_json_object("info", "$.submission"), "_patch"), "result_status": F.coalesce("result_status", F.lit("missing"))})
    return c.drop("_patch", "error"), p.where("error IS NOT NULL").select("path", "error")
