"""Patches repaired: hunks cut down to what they change, and renumbered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HEADER = r"(?s)^@@\s+-(\d+),(\d+)\s+\+(\d+),(\d+)\s+@@(.*)$"


def hunks(df: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, file, hunk, header, pre_start, pre_len, post_start, post_len, body) of each hunk of a patch.

    A hunk is cut to the lines from its first change to one line after its last, without white
    space at line ends (an empty line is a blank). Lengths are counted from what is left, and
    a file's later hunks are moved by what the earlier ones add or remove: a running sum.
    Keys are unique. Patches without a header --- a/ and +++ b/ have no hunks.
    """
    text = F.regexp_replace(F.col(patch), r"^\n+", "")
    files = df.select(key, F.posexplode(F.split(text, r"(?m)(?=^--- a/)")).alias("file", "_f"))
    head = r"(?s)^(--- +a/[^\n]*\n\+\+\+ +b/[^\n]*)\n?(.*?)(?:diff .*)?$"
    files = files.where(F.col("_f").rlike(r"(?s)^--- +a/[^\n]*\n\+\+\+ +b/")).select(key, "file", F.regexp_extract("_f", head, 1).alias("header"), F.regexp_extract("_f", head, 2).alias("_body"))
    h = files.select(key, "file", "header", F.posexplode(F.filter(F.split("_body", r"(?=@@ -)"), lambda x: x.rlike(_HEADER))).alias("hunk", "_h"))
    lines = F.split(F.regexp_extract("_h", _HEADER, 5), "\n")
    h = h.select(key, "file", "header", "hunk", F.regexp_extract("_h", _HEADER, 1).cast("int").alias("_start"), lines.alias("_l"), F.transform(lines, lambda x: x.startswith("+") | x.startswith("-")).alias("_c"))
    first = F.when(F.array_contains("_c", True), F.array_position("_c", True)).otherwise(F.size("_c") + 1).cast("int")  # from 1
    last = F.when(F.array_contains("_c", True), F.size("_c") - F.array_position(F.reverse("_c"), True) + 1).otherwise(0).cast("int")
    kept = F.slice("_l", first, F.greatest(last + 2 - first, F.lit(0)))
    kept = F.transform(kept, lambda x: F.when(F.trim(x) == "", F.lit(" ")).otherwise(F.regexp_replace(x, r"\s+$", "")))
    h = h.select(key, "file", "header", "hunk", (F.col("_start") + first - 2).alias("pre_start"), kept.alias("_k"))
    n = lambda f: F.size(F.filter("_k", f))
    same = n(lambda x: ~x.startswith("+") & ~x.startswith("-"))
    h = h.withColumns({"pre_len": same + n(lambda x: x.startswith("-")), "post_len": same + n(lambda x: x.startswith("+"))})
    before = Window.partitionBy(key, "file").orderBy("hunk").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.col("post_len") - F.col("pre_len")).over(before), F.lit(0)).cast("int")
    return h.select(key, "file", "hunk", "header", "pre_start", "pre_len", (F.col("pre_start") + moved).alias("post_start"), "post_len", F.concat(F.array_join("_k", "\n"), F.lit("\n")).alias("body"))


def minimal(df: DataFrame, key: str, patch: str) -> DataFrame:
    """(key, patch): the patch of hunks() alone; an empty text where there is none."""
    h = hunks(df, key, patch)
    one = F.concat(F.lit("@@ -"), "pre_start", F.lit(","), "pre_len", F.lit(" +"), "post_start", F.lit(","), "post_len", F.lit(" @@\n"), "body")
    by_file = h.groupBy(key, "file", "header").agg(F.array_sort(F.collect_list(F.struct("hunk", one.alias("t")))).alias("x"))
    by_file = by_file.select(key, "file", F.concat("header", F.lit("\n"), F.array_join(F.transform("x", lambda y: y["t"]), "")).alias("t"))
    whole = by_file.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("file", "t"))).alias("x")).select(key, F.array_join(F.transform("x", lambda y: y["t"]), "").alias("_p"))
    return df.select(key).join(whole, key, "left").select(key, F.coalesce("_p", F.lit("")).alias("patch"))


def from_reply(c):
    """The diff in a model's reply: what a <patch> or <diff> tag holds, or a fenced diff block, else any other block, else the whole text."""
    found = [F.regexp_extract(c, p, 1) for p in (r"(?s)<(?:patch|diff)>(.*?)</(?:patch|diff)>", r"(?s)```(?:diff|patch)\n(.*?)```", r"(?s)```\w*\n(.*?)```")]
    return F.coalesce(*[F.when(F.length(x) > 0, x) for x in found], F.substring_index(c, "</s>", 1))


def split_tests(c):
    """(fix, tests): the file sections of a patch that change tests, and the others."""
    from runloom.functions.text import is_test_path

    sections = F.filter(F.split(c, r"(?m)(?=^diff --git )"), lambda x: x.startswith("diff --git "))
    path = lambda x: F.regexp_extract(x, r"^diff --git a/(\S+)", 1)
    pick = lambda test: F.array_join(F.filter(sections, lambda x: is_test_path(path(x)) == F.lit(test)), "")
    return F.struct(pick(False).alias("fix"), pick(True).alias("tests"))
