"""Test results from logs whose lines hang together: sections, nested headings, carried names, blocks, XML.

Formats are declared: which lines begin and end a section, what is a heading, how headings
nest, what a result looks like. Lines become rows, sections and carried names are windows
over a log's lines, and nesting is a fold over its headings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.text import without_ansi


@dataclass(frozen=True)
class Headed:
    """A format of results below headings.

    begins and ends are patterns of the lines around a section, which counts once or again and
    again. head has the groups indent and text, case the groups mark and test. nest is how a
    heading takes its place: below, that is under the last one with a smaller indent; or steps,
    one down if it is deeper than the last one that moved, one up if it is less deep.
    """

    begins: str
    ends: str
    again: bool
    head: str
    nest: str
    case: str
    marks: dict[str, str] = field(default_factory=dict)
    name: Callable[[Column, Column], Column] = lambda heads, test: F.concat_ws(" > ", heads, test)
    between: str = " > "


#: What the lines of these test programs look like.
HEADED = {
    "karma": Headed(r"Starting browser", r"^SUMMARY:", False, r"^(\s+)\s(.*)$", "steps", r"^\s*([✔✖])\s(.*)$", {"✔": "PASSED", "✖": "FAILED"}),
    "calypso": Headed(r" \./node_modules/\.bin/jest ", r"^(?:Test Suites|  ● )", True, r"^(\s+)([^\s✓✕].*?)\s*$", "below", r"^\s+([✓✕])\s(.*?)(?:\(\d+ms\))?$", {"✓": "PASSED", "✕": "FAILED"}, lambda heads, test: F.trim(F.concat(F.coalesce(heads, F.lit("")), F.lit(" - "), test)), " - "),
}


def _lines(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.posexplode(F.split("_log", "\n")).alias("_n", "_l"))


def _so_far(key: str):  # noqa: ANN202
    return Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)


def _last(hits: DataFrame, key: str) -> DataFrame:
    """The last status of each test by its place."""
    return hits.groupBy(key, "test").agg(F.max_by("status", "_n").alias("status"))


_STACK = "array<struct<indent: int, text: string>>"


def _placed(nest: str, stack: Column, depth: Column, head: Column) -> tuple[Column, Column]:
    """The headings above and the depth after one more heading."""
    one = F.array(F.struct(head["indent"].alias("indent"), head["text"].alias("text")))
    if nest == "below":
        return F.concat(F.filter(stack, lambda x: x["indent"] < head["indent"]), one), head["indent"]
    up = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
    return F.when(head["indent"] > depth, F.concat(stack, one)).when(head["indent"] < depth, up).otherwise(stack), head["indent"]


def headed(rows: DataFrame, key: str, form: Headed) -> DataFrame:
    """(key, test, status) of logs in such a format: each test under the headings that are open at its line."""
    line, w = F.col("_l"), _so_far(key)
    edge = F.when(line.rlike(form.ends), 0).when(line.rlike(form.begins), 1)
    kind = F.when(line.rlike(form.case), "case").when(line.rlike(form.head), "head")
    told = _lines(rows, key).select(key, "_n", "_l", edge.alias("_edge"), F.when(edge.isNull(), kind).alias("_kind")).where("_edge IS NOT NULL OR _kind IS NOT NULL")
    inside = F.coalesce(F.last("_edge", ignorenulls=True).over(w), F.lit(0)) == 1
    if not form.again:
        inside = inside & (F.coalesce(F.min("_edge").over(w), F.lit(1)) == 1)
    told = told.withColumn("_in", inside).where("_in AND _kind IS NOT NULL")
    head = F.struct("_n", F.length(F.regexp_extract("_l", form.head, 1)).alias("indent"), F.regexp_extract("_l", form.head, 2).alias("text"))
    heads = told.where("_kind = 'head'").groupBy(key).agg(F.sort_array(F.collect_list(head)).alias("_heads"))
    start = F.struct(F.array().cast(_STACK).alias("stack"), F.lit(-1).alias("depth"), F.array().cast("array<struct<_n: int, path: string>>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        stack, depth = _placed(form.nest, s["stack"], s["depth"], h)
        path = F.when(F.size(stack) > 0, F.array_join(F.transform(stack, lambda x: x["text"]), form.between))
        return F.struct(stack.alias("stack"), depth.alias("depth"), F.concat(s["out"], F.array(F.struct(h["_n"].alias("_n"), path.alias("path")))).alias("out"))

    paths = heads.select(key, F.explode(F.aggregate("_heads", start, step, lambda s: s["out"])).alias("_h")).select(key, "_h._n", F.struct(F.col("_h.path").alias("path")).alias("_path"), F.lit(None).cast("string").alias("_l"))
    both = told.where("_kind = 'case'").select(key, "_n", F.lit(None).cast("struct<path: string>").alias("_path"), "_l").unionByName(paths)
    both = both.withColumn("_path", F.last("_path", ignorenulls=True).over(w)).where("_l IS NOT NULL")
    status = F.element_at(F.create_map(*[F.lit(x) for kv in form.marks.items() for x in kv]), F.regexp_extract("_l", form.case, 1))
    return _last(both.select(key, "_n", form.name(F.col("_path.path"), F.regexp_extract("_l", form.case, 2)).alias("test"), status.alias("status")), key)


#: Results that one line tells; of several that hold the last counts.
_DJANGO = (
    (r"--version is equivalent to version", F.lit, "--version is equivalent to version", "PASSED"),
    (r"^.* (?:\.\.\. ok|\.\.\. OK|\.\.\.  OK)$", None, r"^(.*) (?:\.\.\. ok|\.\.\. OK|\.\.\.  OK)$", "PASSED"),
    (r" \.\.\. skipped", None, r"^(.*?) \.\.\. skipped", "SKIPPED"),
    (r" \.\.\. FAIL$", None, r"^(.*?) \.\.\. FAIL", "FAILED"),
    (r"^FAIL:\S*\s+\S", None, r"^FAIL:\S*\s+(\S+)", "FAILED"),
    (r" \.\.\. ERROR$", None, r"^(.*?) \.\.\. ERROR", "ERROR"),
    (r"^ERROR:\S*\s+\S", None, r"^ERROR:\S*\s+(\S+)", "ERROR"),
)
_MIGRATION = "Applying sites.0002_alter_domain_unique...test_no_migrations"
#: Output that comes between a test's name and its ok: on one line, or from one line to another.
_NOISE = r"^(.*?)\s\.\.\.\s(?:Internal Server Error: /.*/|System check identified no issues \(0 silenced\))$"
_SETUP, _SETUP_ENDS = r"^(.*?)\s\.\.\.\sTesting against Django installed in ", r"silenced\)\.$"


def django(rows: DataFrame, key: str) -> DataFrame:
    """Results after " ... ", FAIL: and ERROR: lines; an ok by itself is that of the last name, or of the one whose output it ends."""
    w, ahead = _so_far(key), Window.partitionBy(key).orderBy("_n")
    lines = _lines(rows, key).withColumn("_t", F.regexp_replace("_l", r"^\s+|\s+$", ""))
    mark = lambda n: (F.col("_n").cast("long") * 16 + n).alias("_n")  # noqa: E731 (several of a line in their order)
    tells = []
    for i, (holds, fixed, what, status) in enumerate(_DJANGO):
        test = fixed(what) if fixed else F.regexp_extract("_t", what, 1)
        if i == 1:
            test = F.when(F.startswith(test, F.lit(_MIGRATION)), F.trim(F.substring(test, F.instr(test, "...") + 3, F.length(test)))).otherwise(test)
        tells.append(F.when(F.col("_t").rlike(holds), F.struct(mark(i), test.alias("test"), F.lit(status).alias("status"))))
    carried = F.last(F.when(F.contains("_t", F.lit(" ... ")), F.substring_index("_t", " ... ", 1)), ignorenulls=True).over(w)
    done = F.lead("_l").over(ahead) == "ok"
    closed = F.col("_l").rlike(_SETUP_ENDS) & F.coalesce(done, F.lit(False))
    lines = lines.select(key, "_n", "_l", "_t", carried.alias("_carried"), done.alias("_done"), closed.alias("_closed"))
    # which of the ends of set-up output comes next
    lines = lines.withColumn("_part", F.sum(F.col("_closed").cast("int")).over(ahead.rowsBetween(Window.unboundedPreceding, -1)))
    opened = F.first(F.when(F.col("_l").rlike(_SETUP), F.regexp_extract("_l", _SETUP, 1)), ignorenulls=True).over(Window.partitionBy(key, F.coalesce("_part", F.lit(0))).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("_opened", opened)
    tells.append(F.when(F.startswith("_t", F.lit("ok")) & F.col("_carried").isNotNull(), F.struct(mark(8), F.col("_carried").alias("test"), F.lit("PASSED").alias("status"))))
    late = (F.lit(1 << 40) + F.col("_n")).alias("_n")
    tells.append(F.when(F.col("_l").rlike(_NOISE) & F.col("_done"), F.struct(late, F.regexp_extract("_l", _NOISE, 1).alias("test"), F.lit("PASSED").alias("status"))))
    tells.append(F.when(F.col("_closed") & F.col("_opened").isNotNull(), F.struct(late, F.col("_opened").alias("test"), F.lit("PASSED").alias("status"))))
    return _last(lines.select(key, F.explode(F.filter(F.array(*tells), lambda x: x.isNotNull())).alias("_h")).select(key, "_h.*"), key)


def _without_blocks(text: Column) -> Column:
    """A text without its elements <name> ... </name>, which may hold others of their name."""
    closers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"</(\w+)>"), F.lit(1)))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(None).cast("string").alias("tag"), F.lit(0).alias("depth"))

    def step(s: Column, p: Column) -> Column:
        opens, closes = F.nullif(F.regexp_extract(p, r"^<(\w+)>", 1), F.lit("")), F.nullif(F.regexp_extract(p, r"^</(\w+)>", 1), F.lit(""))
        begins = s["tag"].isNull() & opens.isNotNull() & F.array_contains(closers, F.coalesce(opens, F.lit("")))
        depth = s["depth"] + F.when(opens == s["tag"], 1).when(closes == s["tag"], -1).otherwise(0)
        ends = s["tag"].isNotNull() & (depth == 0)
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(ends, F.concat(s["out"], F.array(F.regexp_replace(p, r"^</\w+>", "")))).when(s["tag"].isNull() & ~begins, F.concat(s["out"], F.array(p))).otherwise(s["out"]).alias("out"),
            F.when(ends, none).when(begins, F.array(p)).when(s["tag"].isNotNull(), F.concat(s["held"], F.array(p))).otherwise(s["held"]).alias("held"),
            F.when(ends, F.lit(None).cast("string")).when(begins, opens).otherwise(s["tag"]).alias("tag"),
            F.when(begins, F.lit(1)).otherwise(F.when(s["tag"].isNotNull(), depth).otherwise(F.lit(0))).alias("depth"),
        )

    rest = F.aggregate(F.split(text, r"(?=</?\w+>)"), start, step, lambda s: F.array_join(F.concat(s["out"], s["held"]), ""))
    return F.when(F.size(closers) > 0, rest).otherwise(text)


def p5js(rows: DataFrame, key: str) -> DataFrame:
    """Numbered failures whose titles go on over deeper and deeper lines up to a colon; JSON and markup between them don't count."""
    w = _so_far(key)
    lines = _lines(rows.withColumn("_log", without_ansi(F.col("_log"))), key).withColumn("_t", F.regexp_replace("_l", r"\s+$", ""))
    before = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    state = lambda opens, closes, over: F.coalesce(F.last(F.when(F.endswith("_t", F.lit(opens)), 1).when(F.col("_t") == closes, 0), ignorenulls=True).over(over), F.lit(0)) == 1
    inside = state("{", "}", w) | state("[", "]", w)
    closing = ((F.col("_t") == "}") & state("{", "}", before)) | ((F.col("_t") == "]") & state("[", "]", before))
    one = F.col("_t").rlike(r"^(?:\{.*\}|\[.*\])$")
    kept = lines.select(key, "_n", "_l", (inside | closing | one).alias("_skip")).where("NOT _skip")
    text = kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_l"))), lambda x: x["_l"]), "\n").alias("_x"))
    titles = text.select(key, F.posexplode(F.regexp_extract_all(_without_blocks(F.col("_x")), F.lit(r"(?ms)^\s*(\d+)\)(.{0,1000}?):"), F.lit(2))).alias("_n", "_title")).select(key, "_n", F.split("_title", "\n").alias("_parts"))
    indent = lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1))
    deeper = F.forall(F.sequence(F.lit(0), F.size("_parts") - 1), lambda i: indent(F.get("_parts", i)) > F.when(i == 0, 0).otherwise(indent(F.get("_parts", i - 1))))
    name = F.array_join(F.transform("_parts", lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), ":")
    return _last(titles.where(deeper).select(key, "_n", name.alias("test"), F.lit("FAILED").alias("status")), key)


#: How deep a report's cases may be nested in one another.
_DEEP = 3


def _case(depth: int) -> str:
    inner = f", SubCase: array<{_case(depth - 1)}>" if depth else ""
    return f"struct<_name: string, Expression: array<struct<_success: string>>{inner}>"


def _below(cases: Column, depth: int) -> Column:
    """All cases of a list and below, each before those in it, as struct<name, held>."""

    def one(c: Column, d: int) -> tuple[Column, Column]:
        own = F.transform(F.coalesce(c["Expression"], F.array().cast("array<struct<_success: string>>")), lambda e: F.coalesce(e["_success"] == "true", F.lit(False)))
        if not d:
            return own, F.array(F.struct(c["_name"].alias("name"), own.alias("held")))
        inner = F.coalesce(_below(c["SubCase"], d - 1), F.array().cast("array<struct<name: string, held: array<boolean>>>"))
        held = F.concat(own, F.flatten(F.transform(F.filter(inner, lambda x: x.isNotNull()), lambda x: x["held"])))
        return held, F.concat(F.array(F.struct(c["_name"].alias("name"), held.alias("held"))), inner)

    return F.flatten(F.transform(cases, lambda c: one(c, depth)[1]))


def doctest(rows: DataFrame, key: str) -> DataFrame:
    """case > subcase of a log's XML report; all expressions in it must have held. A report that isn't well formed has no results."""
    at = F.instr("_log", "<doctest")
    end = F.expr("locate('</doctest>', _log, greatest(instr(_log, '<doctest'), 1))")
    report = F.when((at > 0) & (end > 0), F.expr("substring(_log, instr(_log, '<doctest'), locate('</doctest>', _log, greatest(instr(_log, '<doctest'), 1)) + 10 - instr(_log, '<doctest'))"))
    top = f"struct<_name: string, SubCase: array<{_case(_DEEP - 1)}>>"
    x = F.from_xml(report, F.lit(f"TestCase array<{top}>, TestSuite array<struct<TestCase: array<{top}>>>, _corrupt_record string"))
    none = F.array().cast(f"array<{top}>")
    cases = F.concat(F.coalesce("_x.TestCase", none), F.coalesce(F.flatten(F.transform("_x.TestSuite", lambda s: F.coalesce(s["TestCase"], none))), none))
    found = rows.select(key, x.alias("_x")).where("_x IS NOT NULL AND _x._corrupt_record IS NULL").select(key, F.posexplode(cases).alias("_i", "_c"))
    found = found.select(key, "_i", F.col("_c._name").alias("_case"), F.posexplode(_below(F.col("_c.SubCase"), _DEEP - 1)).alias("_j", "_s"))
    status = F.when(F.forall("_s.held", lambda h: h), "PASSED").otherwise("FAILED")
    return _last(found.select(key, F.struct("_i", "_j").alias("_n"), F.concat("_case", F.lit(" > "), "_s.name").alias("test"), status.alias("status")), key)


_GO = {"PASS": "PASSED", "FAIL": "FAILED", "SKIP": "SKIPPED"}
_CRASH = r"(?i)panic:|fatal error|SIGSEGV|SIGILL|SIGFPE|SIGBUS|unexpected fault"


def go_first(rows: DataFrame, key: str) -> DataFrame:
    """Go results where the first of a name counts; a crash is an error of the test that ran last, if it has no result; output without results is one error."""
    result, line = r"^\s*--- (PASS|FAIL|SKIP): (\S+)", F.col("_l")
    run = F.last(F.when(line.rlike(r"^=== RUN\s+\S"), F.regexp_extract("_l", r"^=== RUN\s+(\S+)", 1)), ignorenulls=True).over(_so_far(key))
    told = _lines(rows, key).where(line.rlike(result) | line.rlike(r"^=== RUN\s+\S") | line.rlike(_CRASH)).withColumn("_run", F.coalesce(run, F.lit("UNKNOWN_ERROR")))
    status = F.element_at(F.create_map(*[F.lit(x) for kv in _GO.items() for x in kv]), F.regexp_extract("_l", result, 1))
    own = F.when(line.rlike(result), F.struct(F.lit(0).alias("late"), "_n", F.regexp_extract("_l", result, 2).alias("test"), status.alias("status")))
    crash = F.when(line.rlike(_CRASH), F.struct(F.lit(1).alias("late"), "_n", F.col("_run").alias("test"), F.lit("ERROR").alias("status")))
    hits = told.select(key, F.explode(F.filter(F.array(own, crash), lambda x: x.isNotNull())).alias("_h")).groupBy(key, F.col("_h.test").alias("test")).agg(F.min_by("_h.status", F.struct("_h.late", "_h._n")).alias("status"))
    silent = rows.where(F.trim(F.regexp_replace("_log", r"\s+", " ")) != "").select(key).join(hits.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    return hits.unionByName(silent.select(key, F.lit("NO_TESTS_FOUND_OR_PARSING_ERROR").alias("test"), F.lit("ERROR").alias("status")))


NESTED: dict[str, Callable[[DataFrame, str], DataFrame]] = {**{n: (lambda rows, key, form=f: headed(rows, key, form)) for n, f in HEADED.items()}, "django": django, "p5js": p5js, "doctest": doctest, "go_first": go_first}
