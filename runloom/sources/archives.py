"""Run archives: folders, tar.gz and zip files as rows (sample, path, member, content), and what is read from them."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom.sources import packed

def sample_of(path: Column | str) -> Column:
    """The first component of a path that holds __, which names a sample; null without one."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda x: F.contains(x, F.lit("__"))), F.lit(1))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder; wrapping folders don't matter, as a sample is known by its name. Loose files are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    s = sample_of("path")
    below = F.substring(F.col("path"), F.instr("path", F.concat(F.lit("/"), s, F.lit("/"))) + F.length(s) + 2, F.length("path"))
    f = f.select(s.alias("sample"), below.alias("path"), F.substring_index("path", "/", -1).alias("member"), F.col("content").cast("string").alias("content"), F.endswith("path", F.concat(F.lit("/"), s)).alias("loose"))
    return f.where("sample IS NOT NULL AND NOT loose").drop("loose")


def archive(spark: SparkSession, path: str, subpath: str = "", unsafe: str = "skip", members: tuple[str, ...] = (), partition_bytes: int = packed.PARTITION) -> DataFrame:
    """Members of a .zip, .tar, .tar.gz or .tgz file, or of all in a folder, below subpath.

    Zip and plain tar files are read in ranges by many tasks, compressed tar files as streams;
    see the data source. members: patterns of base names, others aren't unpacked. Paths that
    leave the archive are skipped, or with unsafe="reject" an error. A sample's members needn't
    stand together: rows are grouped by sample later, so it is one record however it was packed.
    """
    spark.dataSource.register(packed.RunArchives)
    r = spark.read.format("run_archive").option("subpath", subpath).option("unsafe", unsafe).option("members", ",".join(members)).option("partitionBytes", partition_bytes)
    return r.load(path)


def pack(files: DataFrame, path: str, kind: str = "zip") -> None:
    """Writes rows (sample, path, content) as archives below path, one for each partition: zip, tar or tar.gz."""
    files.sparkSession.dataSource.register(packed.RunArchives)
    files.select("sample", "path", "content").write.format("run_archive").option("kind", kind).mode("append").save(path)


def load(spark: SparkSession, path: str, subpath: str = "", unsafe: str = "skip") -> DataFrame:
    """Folder or archive, by the name's ending; unsafe as in archive()."""
    return archive(spark, path, subpath, unsafe) if path.endswith(packed.ENDINGS) else directory(spark, f"{path}/{subpath}".rstrip("/"))


def assembled(files: DataFrame) -> DataFrame:
    """One row for each sample: its trajectory, transformation log, patch, predictions and reports, and whether it has a report folder.

    Of several trajectories one whose file or folder is named for the instance is preferred,
    then the first by path. Reports are files of the sample's folder report/ only; of the
    counting ones, which report.json and eval_results.json aren't, the first that is JSON.
    """
    from runloom.functions.text import split_id

    instance, sample = split_id(F.col("sample"))
    f = files.withColumns({"instance_id": instance, "sample_id": sample})
    in_report = F.col("path") == F.concat(F.lit("report/"), F.col("member"))
    role = (
        F.when(F.col("member").endswith(".traj.json"), "trajectory")
        .when(F.col("path") == "spt_log.json", "spt_log")
        .when(F.col("path") == "patch.diff", "patch")
        .when(F.col("path") == "preds.json", "preds")
        .when(in_report & (F.col("member") == "eval_results.json"), "eval_results")
        .when(in_report & F.col("member").endswith(".json") & (F.col("member") != "report.json") & F.try_parse_json("content").isNotNull(), "report")
    )
    named = (F.col("member") == F.concat("instance_id", F.lit(".traj.json"))) | F.endswith(F.concat(F.lit("/"), F.col("path")), F.concat(F.lit("/"), "instance_id", F.lit("/"), "member"))
    order = F.struct(~F.coalesce(named, F.lit(False)), F.col("path"))
    f = f.withColumns({"role": role, "_order": order})
    pick = lambda r: F.min_by("content", F.when(F.col("role") == r, F.col("_order"))).alias(r)
    has_report = F.coalesce(F.bool_or(F.startswith("path", F.lit("report/"))), F.lit(False)).alias("has_report")
    g = f.groupBy("sample").agg(*[pick(r) for r in ("trajectory", "spt_log", "patch", "preds", "eval_results", "report")], has_report)
    return g.select("sample", instance.alias("instance_id"), sample.alias("sample_id"), *g.columns[1:])


def spt_entry_count(log: Column) -> Column:
    """All entries of a log, also those that are no transformation; 0 if it isn't a list."""
    return F.coalesce(F.json_array_length(log), F.lit(0))


def spt_breakdown(log: Column) -> Column:
    """Counts by transformation of a log's JSON text."""
    entries = F.coalesce(F.from_json(log, "array<struct<transformation string, file string>>"), F.array().cast("array<struct<transformation:string,file:string>>"))
    names = F.filter(F.transform(entries, lambda e: e["transformation"]), lambda x: x.isNotNull())
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(names)), lambda n: F.struct(n, F.size(F.filter(names, lambda x: x == n)))))


def spt_metadata(log: Column) -> Column:
    """available, entry_count and applied of a log: applied is true or null, as an empty log doesn't prove that nothing was applied."""
    v = F.try_parse_json(log)
    n = F.coalesce(F.json_array_length(log), F.size(F.json_object_keys(log)))
    return F.struct(v.isNotNull().alias("available"), F.when(v.isNotNull(), n).alias("entry_count"), F.when(v.isNotNull() & (n > 0), True).alias("applied"))


def predicted_patch(preds: Column) -> Column:
    """The patch of a predictions file: of its object, or of the first of a list; null if it isn't JSON."""
    own = F.coalesce(*[F.nullif(F.get_json_object(preds, f"{root}.{k}"), F.lit("")) for root in ("$[0]", "$") for k in ("patch", "model_patch")], F.lit(""))
    return F.when(F.try_parse_json(preds).isNotNull(), own)


def status(sample: DataFrame) -> Column:
    """resolved, unresolved, empty, error or unknown.

    Without a report folder: unknown. Results by instance come first: any that holds is
    resolved, else the predicted patch tells (no predictions: empty, no JSON: error). Then
    the counts of a report. Unreadable results by instance are passed over.
    """
    from runloom.functions.text import patch_class

    ev = F.from_json("eval_results", "map<string,string>")
    yes = F.exists(F.map_values(ev), lambda x: F.coalesce(~x.isin("false", "0", "", "null", "[]", "{}"), F.lit(False)))
    patch = F.when(F.col("preds").isNull(), "empty").when(F.try_parse_json("preds").isNull(), "error").otherwise(patch_class(predicted_patch(F.col("preds"))))
    n = lambda k: F.coalesce(F.get_json_object("report", f"$.{k}").try_cast("int"), F.lit(0))
    old = F.when(n("resolved_instances") > 0, "resolved").when(n("error_instances") > 0, "error").when(n("empty_patch_instances") > 0, "empty").otherwise("unresolved")
    by_instance = F.when(yes, "resolved").when(patch == "ok", "unresolved").otherwise(patch)
    return F.when(~F.col("has_report"), "unknown").when(F.coalesce(F.size(F.map_keys(ev)), F.lit(0)) > 0, by_instance).when(F.col("report").isNotNull(), old).otherwise("unknown")


def outcomes(files: DataFrame) -> DataFrame:
    """(sample, outcome) by the other convention: resolved, unresolved, empty or error; a sample without reports is an error.

    The first counting report by name, any but report.json, tells by its counts; without one
    the first entry of report.json does.
    """
    own = F.col("path") == F.concat(F.lit("report/"), F.col("member"))
    json = own & F.endswith("member", F.lit(".json"))
    counting = json & (F.col("member") != "report.json")
    g = files.groupBy("sample").agg(F.min_by("content", F.when(counting, F.col("path"))).alias("c"), F.max(F.when(counting, 1)).alias("has"), F.max(F.when(json & (F.col("member") == "report.json"), F.col("content"))).alias("r"))
    n = lambda k: F.coalesce(F.get_json_object("c", f"$.{k}").try_cast("int"), F.lit(0)) > 0
    counts = F.when(n("resolved_instances"), "resolved").when(n("error_instances"), "error").when(n("empty_patch_instances"), "empty").otherwise("unresolved")
    entry = F.try_element_at(F.map_values(F.from_json("r", "map<string,string>")), F.lit(1))
    flag = lambda k, default: F.coalesce(F.get_json_object(entry, f"$.{k}"), F.lit(default)) == "true"
    one = F.when(~F.coalesce(entry.rlike(r"^\s*\{"), F.lit(False)), "error").when(flag("patch_is_None", "false") | ~flag("patch_exists", "true"), "empty").when(~flag("patch_successfully_applied", "true"), "error").when(flag("resolved", "false"), "resolved").otherwise("unresolved")
    return g.select("sample", F.when(F.col("has") == 1, counts).otherwise(one).alias("outcome"))


def group_key(results: Column, folder: Column) -> Column:
    """The id that results by instance name first; without one the first half of a folder's name, which holds it twice."""
    parts = F.split(folder, "_")
    return F.coalesce(F.try_element_at(F.json_object_keys(results), F.lit(1)), F.array_join(F.slice(parts, 1, F.floor(F.size(parts) / 2).cast("int")), "_"))


def records(samples: DataFrame, run_type: str) -> DataFrame:
    """assembled() samples as runs: ids, status, metrics of the trajectory, transformations, files of the patch."""
    from runloom.functions.text import patch_files
    from runloom.sources import trajectories

    files = F.coalesce(F.size(patch_files(F.col("patch"))), F.lit(0))
    s = samples.withColumns({"status": status(samples), "patch_files_touched": files, "spt": spt_breakdown(F.col("spt_log")), "spt_entry_count": spt_entry_count(F.col("spt_log"))})
    s = trajectories.metrics(trajectories.parsed(s))
    return s.select("instance_id", "sample_id", F.lit(run_type).alias("run_type"), "status", F.col("sample").alias("source_dir"), "patch_files_touched", *trajectories.METRICS, "spt", F.array_join(F.array_sort(F.map_keys("spt")), ",").alias("spt_types"), "spt_entry_count")


def predictions(spark: SparkSession, path: str, dataset: DataFrame | None = None) -> DataFrame:
    """Predictions as rows (instance_id, model_name_or_path, model_patch), from a map by id, a list, or lines of JSON.

    The path "gold" gives the dataset's own patches. A prediction without an id is an error.
    """
    if path == "gold":
        if dataset is None:
            raise ValueError("gold predictions need a dataset")
        return dataset.select("instance_id", F.lit("gold").alias("model_name_or_path"), F.col("patch").alias("model_patch"))
    raw = spark.read.text(path, wholetext=not path.endswith(".jsonl"))
    kind = "struct<instance_id:string,model_name_or_path:string,model_patch:string,patch:string,prefix:string>"
    v = F.col("value")
    rows = F.when(v.rlike(r"^\s*\["), F.from_json(v, f"array<{kind}>")).when(F.lit(path.endswith(".jsonl")), F.array(F.from_json(v, kind))).otherwise(F.map_values(F.from_json(v, f"map<string,{kind}>")))
    out = raw.select(F.explode(rows).alias("p")).select("p.instance_id", F.coalesce("p.model_name_or_path", "p.prefix").alias("model_name_or_path"), F.coalesce("p.model_patch", "p.patch").alias("model_patch"))
    return out.withColumn("instance_id", F.when(F.col("instance_id").isNull(), F.raise_error(F.lit("a prediction has no instance_id"))).otherwise(F.col("instance_id")))


def reshaped(preds: DataFrame, prefix: str) -> DataFrame:
    """Predictions in the list form: instance_id, patch (null: empty) and prefix."""
    return preds.select("instance_id", F.coalesce("model_patch", F.lit("")).alias("patch"), F.lit(prefix).alias("prefix"))


def dataset(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Instances from .json (a list) or .jsonl; with ids (column id) only those. An id that the dataset lacks is an error."""
    df = spark.read.json(path, multiLine=not path.endswith(".jsonl"))
    if ids is None:
        return df
    missing = [r.id for r in ids.join(df.select(F.col("instance_id").alias("id")), "id", "left_anti").orderBy("id").limit(10).collect()]
    if missing:
        raise ValueError(f"not in the dataset: {', '.join(missing)}")
    return df.join(ids.select(F.col("id").alias("instance_id")), "instance_id", "left_semi")


def python_files(files: DataFrame, folders: tuple[str, ...] = (), names: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(Python files that aren't excluded, one row of counts) of files (path): by a folder's name anywhere above, by base name, or by a shell pattern over the path."""
    parts, none = F.split("path", "/"), F.lit(False)
    words = lambda w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    by_folder = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), words(folders)) if folders else none
    by_name = F.element_at(parts, -1).isin(*names) if names else none
    by_pattern = none
    for p in patterns:
        by_pattern = by_pattern | F.col("path").rlike("^" + fnmatch.translate(p).replace(r"\Z", r"\z"))
    py = F.endswith("path", F.lit(".py"))
    kept = py & ~(by_folder | by_name | by_pattern)
    n = lambda c, name: F.count_if(c).alias(name)
    return files.where(kept), files.agg(n(py, "found"), n(py & by_folder, "by_folder"), n(py & by_name, "by_name"), n(py & by_pattern, "by_pattern"), n(kept, "kept"))


def code_files(files: DataFrame) -> DataFrame:
    """Files whose paths have no word of tests."""
    from runloom.functions.text import is_test_path

    return files.where(~is_test_path(F.col("path")))


def gathered_patches(files: DataFrame, ending: str = r"\.(pred|json|patch|diff)$") -> DataFrame:
    """(sample, patch) of each sample's first matching file by path: the patch of a JSON prediction, else the whole text."""
    f = files.where(F.col("path").rlike(ending)).groupBy("sample").agg(F.min_by("content", "path").alias("c"))
    return f.select("sample", F.coalesce(F.get_json_object("c", "$.model_patch"), F.get_json_object("c", "$.patch"), F.col("c")).alias("patch"))


def frame(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, or lines of JSON, with empty text for null."""
    df = spark.read.json(path) if path.endswith(".jsonl") else spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.na.fill("")


def ids(spark: SparkSession, path: str) -> DataFrame:
    """A list of ids: blank lines and comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id != '' AND NOT startswith(id, '#')")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing with rows replaced or added by key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def without(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """existing without the rows of these ids."""
    return existing.join(ids.select(key), key, "left_anti")


def match_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    """The best result of each case: matched, missing, or ambiguous if the two best tie with different ids.

    cases: root, case_id, and trajectory_id if that is another id. results: root, path,
    record_id, n_records (of its file; 1 if there is no such column and the root has one
    record), resolved, has_tests, has_patch. Scores: 100 for the same id, 60 for an id in the
    root's name, 20 for a file's only record; and for what the record holds. Only records of
    the case's own root are looked at.
    """
    from runloom.functions.text import identifier

    r = results if "n_records" in results.columns else results.withColumn("n_records", F.count(F.lit(1)).over(Window.partitionBy("root")))
    own = "trajectory_id" if "trajectory_id" in cases.columns else "case_id"
    j = cases.select("root", "case_id", F.col(own).alias("_id")).join(r, "root", "left")
    record, name = identifier(F.col("record_id")), identifier(F.substring_index("root", "/", -1))
    same = F.when(record == identifier(F.col("_id")), 100).when(F.contains(name, record), 60).when(F.col("n_records") == 1, 20).otherwise(0)
    quality = F.when(F.col("resolved").isNotNull(), 10).otherwise(0) + F.when(F.col("has_tests"), 30).otherwise(0) + F.when(F.col("has_patch"), 5).otherwise(0)
    named = F.when(F.lower(F.substring_index("path", "/", -1)).isin("result.json", "results.json"), 2).otherwise(0)
    j = j.withColumn("score", F.when(F.col("path").isNotNull(), same + quality + named))
    w = Window.partitionBy("root", "case_id").orderBy(F.desc_nulls_last("score"), "path", "record_id")
    j = j.withColumns({"_n": F.row_number().over(w), "_second": F.lead(F.struct("score", "record_id")).over(w)}).where("_n = 1")
    tie = F.coalesce((F.col("_second.score") == F.col("score")) & ~F.col("_second.record_id").eqNullSafe(F.col("record_id")), F.lit(False))
    state = F.when(F.col("score").isNull(), "missing").when(tie, "ambiguous").otherwise("matched")
    j = j.withColumn("status", state)
    keep = F.col("status") == "matched"
    said = [c for c in ("resolved", "patch_applied", "tests_status") if c in j.columns]
    return j.select("case_id", "status", F.when(keep, F.col("record_id")).alias("record_id"), *[F.when(keep, F.col(c)).alias(c) for c in said], F.when(keep, F.col("score")).alias("score"))
