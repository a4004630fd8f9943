"""Datasets of task instances: built from pull requests, filtered, split, joined with retrieval and predictions, and turned into prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.operators.runs import hashed


def instance_id(repo: Column, number: Column) -> Column:
    """owner/repo and a number as owner__repo-number."""
    return F.replace(F.concat_ws("-", repo, number.cast("string")), F.lit("/"), F.lit("__"))


def valid_pull(merged_at: Column, resolved_issues: Column) -> Column:
    return F.coalesce(merged_at.isNotNull() & (F.size(resolved_issues) >= 1), F.lit(False))


def valid_instance(patch: Column, problem_statement: Column) -> Column:
    return F.coalesce((patch != "") & (problem_statement != ""), F.lit(False))


def has_tests(test_patch: Column) -> Column:
    return F.coalesce(test_patch.rlike(r"\S"), F.lit(False))


def statements(links: DataFrame, issues: DataFrame) -> DataFrame:
    """(pull, problem_statement): titles and bodies of a pull request's issues, in order.

    links: pull, at, issue. issues: issue, title, body. An issue that is missing is left out;
    a pull request without any has an empty statement.
    """
    j = links.join(issues, "issue", "left")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    there = F.col("title").isNotNull() | F.col("body").isNotNull()
    return j.groupBy("pull").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(there, F.struct("at", text.alias("t"))))), lambda x: x["t"]), "").alias("problem_statement"))


def hints(comments: DataFrame, first_commits: DataFrame) -> DataFrame:
    """(pull, hints_text): comments before the pull request's first commit, up to the first that isn't.

    comments: pull, issue_at, at, updated, body. first_commits: pull, committed. Without
    commits there are no hints. The texts of an issue, then of all issues, are joined by a
    line break.
    """
    c = comments.join(first_commits, "pull", "left").withColumn("_ok", F.coalesce(F.col("updated") < F.col("committed"), F.lit(False)))
    w = Window.partitionBy("pull", "issue_at").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_all", F.min(F.col("_ok").cast("int")).over(w))
    by = c.groupBy("pull", "issue_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_all") == 1, F.struct("at", F.coalesce("body", F.lit("")).alias("t"))))), lambda x: x["t"]), "\n").alias("t"))
    return by.groupBy("pull").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("issue_at", "t"))), lambda x: x["t"]), "\n").alias("hints_text"))


def problem_text(statement: Column, requirements: Column, interface: Column) -> Column:
    """A statement with its requirements and interface, each under a heading, where there are any."""
    part = lambda head, c: F.when(c.rlike(r"\S"), F.concat(F.lit(f"{head}:\n"), c))
    return F.concat_ws("\n\n", statement, part("Requirements", requirements), part("New interfaces introduced", interface))


def selected(instances: DataFrame, key: str, pattern: str | None = None, begin: int | None = None, end: int | None = None, seed: str | None = None) -> DataFrame:
    """Instances whose id begins with a match of pattern, of these numbers begin to end - 1, in order of id or, with a seed, in a shuffled order."""
    rows = instances if pattern is None else instances.where(F.col(key).rlike(f"^(?:{pattern})"))
    order = [hashed(F.lit(seed), F.col(key)), F.col(key)] if seed is not None else [F.col(key)]
    from runloom.operators.ranks import numbered

    rows = numbered(rows, order, "position")
    return rows.where((F.col("position") >= (begin or 0)) & (F.lit(True) if end is None else F.col("position") < end))


def by_length(rows: DataFrame, key: str, length: Column, least: int | None = None, most: int | None = None, shard: int | None = None, shards: int = 1) -> DataFrame:
    """Rows with least <= length < most, numbered by length; with a shard only that contiguous part of equal parts, the first of which have one more."""
    from runloom.operators.ranks import numbered

    r = rows.withColumn("length", length)
    r = r.where((F.lit(True) if least is None else F.col("length") >= least) & (F.lit(True) if most is None else F.col("length") < most))
    r = numbered(r, [F.col("length"), F.col(key)], "position")
    if shard is None:
        return r
    n = r.count()
    size, rest = divmod(n, shards)
    begin = shard * size + min(shard, rest)
    return r.where(F.col("position").between(begin, begin + size + (shard < rest) - 1))


def even_parts(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """Adds part, 1 to n, of contiguous parts in each group whose sizes differ by one at most, the larger first."""
    return rows.withColumn("part", F.ntile(n).over(Window.partitionBy(group).orderBy(*order)))


def random_split(rows: DataFrame, key: str, share: float, seed: str = "split") -> DataFrame:
    """Adds validation: whether a row is in the share that a seeded hash of its key picks."""
    return rows.withColumn("validation", hashed(F.lit(seed), F.col(key)) % 1_000_000 < int(share * 1_000_000))


def take(rows: DataFrame, key: str, n: int, seed: str = "take") -> DataFrame:
    """n rows in the order of a seeded hash; a sampling operator."""
    return rows.orderBy(hashed(F.lit(seed), F.col(key)), key).limit(n)


def chosen(candidates: DataFrame, group: str, item: str, k: int, share: float | None = None, seed: str = "choose") -> DataFrame:
    """At most k of each group's items without replacement, or with a share the upper whole number of that share; by a seeded hash."""
    w = Window.partitionBy(group)
    c = candidates.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("pick", F.row_number().over(w.orderBy(hashed(F.lit(seed), F.col(group), F.col(item)), item)))
    most = F.lit(k) if share is None else F.ceil(F.col("_n") * share)
    return c.where(F.col("pick") <= most).drop("_n")


def split_by_repo(rows: DataFrame, eval_repos: DataFrame, repo: str = "repo") -> tuple[DataFrame, DataFrame]:
    """(training, evaluation): evaluation has the given repositories, training all others."""
    e = eval_repos.select(repo).distinct()
    return rows.join(e, repo, "left_anti"), rows.join(e, repo, "left_semi")


def language_is(lang: Column, wanted: str, alias: dict[str, str]) -> Column:
    """Whether a language, by its alias if it has one, is the wanted one."""
    low = F.lower(lang)
    own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in alias.items() for x in kv]), low), low) if alias else low
    return F.coalesce(own == wanted.lower(), F.lit(False))


def funnel(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """One row: how many rows stay after each filter in turn, in one pass."""
    kept, out = F.lit(True), [F.count(F.lit(1)).alias("total")]
    for name, f in filters.items():
        kept = kept & F.coalesce(f, F.lit(False))
        out.append(F.count_if(kept).alias(name))
    return rows.agg(*out)


def gold_files(instances: DataFrame, repo_files: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, file, at): the Python files of a patch that the repository has, in the patch's order. repo_files: key, file."""
    f = instances.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^--- a/(\S+)"), F.lit(1)))).alias("at", "file"))
    return f.where(F.endswith("file", F.lit(".py"))).join(repo_files.select(key, "file").distinct(), [key, "file"], "left_semi")


def with_hits(instances: DataFrame, hits: DataFrame, key: str, k: int) -> DataFrame:
    """instances with the first k of their hits (array); an instance without any has an empty one."""
    h = hits.select(key, F.slice("hits", 1, k).alias("hits"))
    empty = F.array().cast(h.schema["hits"].dataType)
    return instances.join(h, key, "left").withColumn("hits", F.coalesce("hits", empty))


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of one id; an id that isn't there is an error."""
    found = rows.where(F.col(key) == value)
    if found.isEmpty():
        raise KeyError(f"{key} {value} not found")
    return found.limit(1)


def with_samples(patches: DataFrame, samples: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(patches joined with their samples, ids of patches that have none)."""
    return patches.join(samples, key), patches.join(samples, key, "left_anti").select(key).distinct()


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id isn't among those done: what a resumed job has still to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def to_run(dataset: DataFrame, preds: DataFrame, done: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    """Instances that have a prediction with a patch and aren't done; a prediction outside the dataset is an error."""
    outside = preds.join(dataset.select(key), key, "left_anti")
    if not outside.isEmpty():
        raise ValueError(f"predictions outside the dataset: {[r[0] for r in outside.select(key).limit(10).collect()]}")
    some = preds.where(F.coalesce(F.trim(patch) != "", F.lit(False)))
    return remaining(dataset.join(some.select(key), key, "left_semi"), done, key)


def token_costs(rows: DataFrame, rates: dict[str, tuple[float, float]], model: str, tokens_in: Column, tokens_out: Column) -> DataFrame:
    """Adds cost: tokens times the model's rates in and out; null for a model without rates."""
    rate = F.create_map(*[x for m, (a, b) in rates.items() for x in (F.lit(m), F.struct(F.lit(float(a)).alias("i"), F.lit(float(b)).alias("o")))])
    r = F.try_element_at(rate, F.col(model))
    return rows.withColumn("cost", tokens_in * r["i"] + tokens_out * r["o"])


def merged_shards(spark, path: str, key: str) -> DataFrame:
    """The rows of all shards (lines of JSON) below a path, each key once: of the first shard by name that has it."""
    d = spark.read.json(path, recursiveFileLookup=True).withColumn("_f", F.input_file_name())
    return d.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_f", F.monotonically_increasing_id()))).where("_n = 1").drop("_n", "_f")


def missing_images(required: DataFrame, existing: DataFrame, image: str) -> DataFrame:
    return required.select(image).distinct().join(existing.select(image), image, "left_anti")


def by_version(instances: DataFrame, version: str, key: str) -> DataFrame:
    """(version, n, ids) with ids in order."""
    return instances.groupBy(version).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("ids"))


def solved_by_difficulty(solved: DataFrame, buckets: DataFrame, key: str) -> DataFrame:
    """(bucket, n, ids) of solved ids; those without a bucket are unknown. buckets: key, bucket, a table of the dataset's size."""
    j = solved.select(key).join(buckets, key, "left").withColumn("bucket", F.coalesce("bucket", F.lit("unknown")))
    return j.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("ids"))


def status_totals(rows: DataFrame, status: str, words: list[str]) -> DataFrame:
    """One row: how many have each status, and how many there are."""
    return rows.agg(*[F.count_if(F.col(status) == w).alias(w) for w in words], F.count(F.lit(1)).alias("total"))


def cut_pulls(pulls: DataFrame, group: str, order: list, most: int | None = None, since: str | None = None, created: str = "created_at") -> DataFrame:
    """Pull requests in order up to the one that trips a limit, which is still in: number `most` from 0, or the first created before `since`."""
    w = Window.partitionBy(group).orderBy(*order)
    p = pulls.withColumn("_i", F.row_number().over(w) - 1)
    tripped = F.lit(False)
    if most is not None:
        tripped = tripped | (F.col("_i") >= most)
    if since is not None:
        tripped = tripped | F.coalesce(F.col(created) < F.lit(since), F.lit(False))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("_s", F.coalesce(F.max(tripped.cast("int")).over(before), F.lit(0))).where("_s = 0").drop("_i", "_s")


def affordable(rows: DataFrame, group: str, order: list[str], tokens: Column, cost: Column, context: int, budget: float) -> DataFrame:
    """Rows whose tokens fit the context, with running cost; from where that passes the budget none is taken."""
    r = rows.where(tokens <= context).withColumn("cost", cost)
    r = r.withColumn("total_cost", F.sum("cost").over(Window.partitionBy(group).orderBy(*order)))
    return r.where(F.col("total_cost") <= budget)


def costs_within(runs: DataFrame, cost: str, calls: str, cost_limit: float = 0, call_limit: int = 0) -> DataFrame:
    """One row: total cost and calls and whether a limit (0: none) is passed."""
    t = runs.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("cost"), F.coalesce(F.sum(calls), F.lit(0)).alias("calls"))
    over = (F.lit(cost_limit) > 0) & (F.col("cost") >= cost_limit) | (F.lit(call_limit) > 0) & (F.col("calls") >= call_limit)
    return t.withColumn("exceeded", over)


def with_solutions(results: DataFrame, solutions: DataFrame, key: str, ok: str) -> tuple[DataFrame, DataFrame]:
    """(totals of passed and failed, the failed ones with their canonical solutions)."""
    totals = results.agg(F.count_if(F.col(ok)).alias("passed"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"))
    return totals, results.where(~F.coalesce(F.col(ok), F.lit(False))).join(solutions, key, "left")


def differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of keys whose values differ between two runs, or that only one has."""
    j = a.select(*keys, F.col(value).alias("left")).join(b.select(*keys, F.col(value).alias("right")), keys, "full_outer")
    return j.where(~F.col("left").eqNullSafe(F.col("right")))


# --- texts and prompts


def numbered_lines(text: Column) -> Column:
    """The lines of a text, each after its number from 1."""
    return F.transform(F.split(text, "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), x))


def code_block(file: Column, text: Column, numbers: bool = True) -> Column:
    return F.concat(F.lit("[start of "), file, F.lit("]\n"), F.array_join(numbered_lines(text), "\n") if numbers else text, F.lit("\n[end of "), file, F.lit("]"))


def code_text(files: DataFrame, key: str, file: str, text: str, numbers: bool = True) -> DataFrame:
    """(key, code): the blocks of all files of a key, by file name."""
    b = code_block(F.col(file), F.coalesce(F.col(text), F.lit("")), numbers)
    return files.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(file).alias("f"), b.alias("b")))), lambda x: x["b"]), "\n").alias("code"))


def excerpts(text: Column, hunks: Column, around: int = 15) -> Column:
    """The numbered lines about each hunk (array of struct<start, length>), with ... where lines are left out."""
    lines = numbered_lines(text)

    def one(h):
        a, b = h["start"] - around, h["start"] + h["length"]
        shown = F.array_join(F.slice(lines, F.greatest(a, F.lit(0)) + 1, F.greatest(F.least(b, F.size(lines)) - F.greatest(a, F.lit(0)), F.lit(0))), "\n")
        return F.concat(F.when(a > 0, "...\n").otherwise(""), shown, F.lit("\n"), F.when(b < F.size(lines), "...\n").otherwise(""))

    return F.regexp_replace(F.array_join(F.transform(hunks, one), ""), r"^\n+|\n+$", "")


def prompt(statement: Column, readmes: Column, code: Column, instructions: str, example: str) -> Column:
    """A prompt: premise, statement, documents and code in tags, what to answer, and an example of an answer."""
    return F.concat_ws("\n", F.lit(instructions), F.lit("<issue>"), statement, F.lit("</issue>"), F.lit("<code>"), F.nullif(readmes, F.lit("")), code, F.lit("</code>"), F.lit("Answer with a patch, as in this example:"), F.lit("<patch>"), F.lit(example), F.lit("</patch>"))


def labelled(rows: DataFrame, text: str, patch: str) -> DataFrame:
    """text and answer, the patch in a tag; rows without a patch go."""
    return rows.where(F.col(patch).isNotNull()).withColumn("text", F.concat(F.trim(text), F.lit("\n\n"))).withColumn("answer", F.concat(F.lit("<patch>\n"), F.col(patch), F.lit("\n</patch>")))


def document(path: Column, content: Column, style: str = "content") -> Column:
    """A file as a retrieval document: its path and its text, or by its syntax tree its docstrings or its symbols."""
    from runloom.functions import syntax

    if style == "content":
        return F.concat(path, F.lit("\n"), content)
    if style == "docstrings":
        return syntax.documentation(path, content, syntax.tree(content))
    if style == "symbols":
        return syntax.symbol_names(path, content, syntax.tree(content))
    raise ValueError(f"no such style: {style}")


def valid_text(raw: Column) -> Column:
    """Bytes as text; what isn't UTF-8 is a placeholder."""
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.lit("[non-UTF-8 content]"))
