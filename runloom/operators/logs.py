"""Test results from the logs of test programs: (key, test, status) of each test.

Formats that tell a result by a line are rules over lines, evaluated by column expressions;
formats that carry a heading over lines are windows; those with nested headings, blocks or XML
are in nested_logs. Which format a log has is a column, so logs of many
projects are read in one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.text import without_ansi
from runloom.operators.nested_logs import NESTED
from runloom.session import gone_at_exit, scratch, written


@dataclass(frozen=True)
class Rule:
    """A line's pattern, its group for the test, and its group for the status with what the words mean; or one status."""

    pattern: str
    test: int
    status: int | str
    meaning: dict[str, str] = field(default_factory=dict)


_OK = {"PASSED": "PASSED", "FAILED": "FAILED", "SKIPPED": "SKIPPED", "ERROR": "ERROR", "XFAIL": "XFAIL"}
_GO = {"PASS": "PASSED", "FAIL": "FAILED", "SKIP": "SKIPPED", "ERR": "FAILED"}
_PYTEST = (Rule(r"^(FAILED)\s+(?:- )?(\S+)", 2, 1, _OK), Rule(r"^(PASSED|SKIPPED|ERROR|XFAIL)\s+(\S+)", 2, 1, _OK))
#: What the lines of test programs look like and what their words and marks mean. Lines are trimmed first but for PLAIN.
LINES: dict[str, tuple[Rule, ...]] = {
    "pytest": _PYTEST,
    "pytest_options": _PYTEST,
    "pytest_v2": (*_PYTEST, Rule(r"^(\S+)\s+(PASSED|FAILED|SKIPPED|ERROR|XFAIL)(?:\s.*(?:PASSED|FAILED|SKIPPED|ERROR|XFAIL))?$", 1, 2, _OK)),
    "matplotlib": _PYTEST,
    "seaborn": (Rule(r"^FAILED\S*\s+(\S+)", 1, "FAILED"), Rule(r"^(\S+)\s+PASSED ", 1, "PASSED"), Rule(r"^PASSED\S*\s+(\S+)", 1, "PASSED")),
    "sympy": (Rule(r"^(test_\S*)(?:.*) (E|F|ok)$", 1, 2, {"E": "ERROR", "F": "FAILED", "ok": "PASSED"}), Rule(r"_* (.*\.py:.*) _*", 1, "FAILED")),
    "chart_js": (Rule(r"Chrome\s[\d.]+[^\S\r\n]\(.+?\)[^\S\r\n](.*)FAILED$", 1, "FAILED"),),
    "marked": (Rule(r"^\d+\)\s(.*)", 1, "FAILED"),),
    "react_pdf": (Rule(r"^(PASS|FAIL)\s(.*)\s\([\d.]+(?:ms|\ss|s)\)", 2, 1, _GO), Rule(r"^(PASS|FAIL)\s(.*)", 2, 1, _GO)),
    "jest": (Rule(r"^(✓|✕|○)\s(.+?)(?:\s\((\d+\s*m?s)\))?$", 2, 1, {"✓": "PASSED", "✕": "FAILED", "○": "SKIPPED"}),),
    "jest_json": (Rule(r"^\[(PASSED|FAILED)\]\s(.+)$", 2, 1, _OK),),
    "vitest": (Rule(r"^(✓|×|↓)\s(.+?)(?:\s(\d+\s*m?s?|\[skipped\]))?$", 2, 1, {"✓": "PASSED", "×": "FAILED", "↓": "SKIPPED"}),),
    "tap": (Rule(r"^(ok|not ok) (\d+) (.+)$", 3, 1, {"ok": "PASSED", "not ok": "FAILED"}),),
    "redis": (Rule(r"^\[(err)\]:\s(.+?)(?:\s+in\s+\S+)?(?:\s\((\d+\s*m?s)\))?$", 2, 1, {"err": "FAILED"}), Rule(r"^\[(ok|skip|ignore)\]:\s(.+?)(?:\s\((\d+\s*m?s)\))?$", 2, 1, {"ok": "PASSED", "skip": "SKIPPED", "ignore": "SKIPPED"})),
    "jq": (Rule(r"^(PASS|FAIL):\s(.+)$", 2, 1, _GO),),
    "micropython": (Rule(r"^(pass|FAIL|skip)\s+(.+)$", 2, 1, {"pass": "PASSED", "FAIL": "FAILED", "skip": "SKIPPED"}),),
    "googletest": (Rule(r"^.*\[\s*(OK|FAILED)\s*\]\s(.*)\s\(.*\)$", 2, 1, {"OK": "PASSED", "FAILED": "FAILED"}),),
    "gotest": (Rule(r"^--- (PASS|FAIL|SKIP): (.+) \((.+)\)$", 2, 1, _GO),),
    "cargo": (Rule(r"^test\s+(\S+)\s+\.\.\.\s+(ok|FAILED)$", 1, 2, {"ok": "PASSED", "FAILED": "FAILED"}),),
    "ant": (Rule(r"^\[junit\]\s+\[(PASS|FAIL|ERR)\]\s+(.*)$", 2, 1, _GO),),
    "gradle": (Rule(r"^([^>].+)\s+(PASSED|FAILED)$", 1, 2, _OK),),
    "minitest": (Rule(r"^(.+)\. .*=.*(\.|F|E).*$", 1, 2, {".": "PASSED", "F": "FAILED", "E": "FAILED"}),),
    "cucumber": (Rule(r"^(.*) \.+(\.|F)", 1, 2, {".": "PASSED", "F": "FAILED"}),),
    "ruby_unit": (Rule(r"^(?:test: )?(.+):\s+(\.|E\b|F\b|O\b)", 1, 2, {".": "PASSED", "E": "FAILED", "F": "FAILED", "O": "SKIPPED"}),),
    "go_passed": (Rule(r"^--- (PASS):\s*(\S+)\s*\(.*\)$", 2, 1, _GO),),
    "go_nested": (Rule(r"^\s*--- (PASS|FAIL|SKIP|ERROR):\s+(.+?)\s+\(.*\)$", 2, 1, {**_GO, "ERROR": "ERROR"}),),
    "go_anywhere": tuple(Rule(rf"^(?=.*--- {w}:)\S+\s+\S+\s+(\S+)", 1, s) for w, s in (("PASS", "PASSED"), ("FAIL", "FAILED"), ("SKIP", "SKIPPED"), ("ERROR", "ERROR"))),
    "pytest_routes": tuple(Rule(rf"^(tests/.*?)\s+(?=PASSED|FAILED|SKIPPED|XFAIL|ERROR|XPASS)(?=.*(?:{w}))", 1, s) for w, s in (("PASSED|XFAIL", "PASSED"), ("FAILED|XPASS", "FAILED"), ("SKIPPED", "SKIPPED"), ("ERROR", "ERROR"))),
    "rspec_json": (Rule(r"^(.+) - (passed|failed)", 1, 2, {"passed": "PASSED", "failed": "FAILED"}),),
}
#: Formats whose lines are taken as they are.
PLAIN = {"pytest", "pytest_options", "pytest_v2", "matplotlib", "seaborn", "chart_js", "marked", "react_pdf", "go_passed"}


@dataclass(frozen=True)
class Carried:
    """A heading whose group names what follows, a line with its status, and how both make the test's name."""

    head: str
    line: Rule
    name: Callable[[Column, Column], Column]
    none: str


#: Formats with headings.
CARRIED = {
    "maven": Carried(r"^.*-Dtest=(\S+).*$", Rule(r"^.*(BUILD) (SUCCESS|FAILURE)$", 1, 2, {"SUCCESS": "PASSED", "FAILURE": "FAILED"}), lambda head, test: head, "---NO TEST NAME FOUND YET---"),
    "phpunit": Carried(r"^(\w.+) \(.+\)$", Rule(r"^\s*([✔✘↩])\s*(.*)$", 2, 1, {"✔": "PASSED", "✘": "FAILED", "↩": "SKIPPED"}), lambda head, test: F.concat(head, F.lit(" > "), test), "None"),
    "jest_suites": Carried(r"^\s*(?:PASS|FAIL)\s+(.+\.(?:test|spec)\.[jt]sx?)", Rule(r"^\s*([✓✗○])\s+(\S.+?\S)(?:\s+\((?:\d+\s*ms|skipped)\))?$", 2, 1, {"✓": "PASSED", "✗": "FAILED", "○": "SKIPPED"}), lambda head, test: F.concat_ws(" | ", F.nullif(head, F.lit("")), test), ""),
}


PARSERS = {*LINES, *CARRIED, *NESTED}

#: The format of each project's logs.
PROJECTS = {
    "redis/redis": "redis", "valkey-io/valkey": "redis", "jqlang/jq": "jq", "nlohmann/json": "doctest", "micropython/micropython": "micropython", "fmtlib/fmt": "googletest",
    "caddyserver/caddy": "gotest", "hashicorp/terraform": "gotest", "prometheus/prometheus": "gotest", "gohugoio/hugo": "gotest", "gin-gonic/gin": "gotest",
    "google/gson": "maven", "apache/druid": "maven", "javaparser/javaparser": "maven", "projectlombok/lombok": "ant", "apache/lucene": "gradle", "reactivex/rxjava": "gradle",
    "Automattic/wp-calypso": "calypso", "chartjs/Chart.js": "chart_js", "markedjs/marked": "marked", "processing/p5.js": "p5js", "diegomura/react-pdf": "react_pdf", "babel/babel": "jest",
    "vuejs/core": "vitest", "facebook/docusaurus": "jest", "mrdoob/three.js": "tap", "preactjs/preact": "karma", "axios/axios": "tap",
    "phpoffice/phpspreadsheet": "phpunit", "laravel/framework": "phpunit", "php-cs-fixer/php-cs-fixer": "phpunit", "briannesbitt/carbon": "phpunit",
    "astropy/astropy": "pytest_v2", "django/django": "django", "marshmallow-code/marshmallow": "pytest", "matplotlib/matplotlib": "matplotlib", "mwaskom/seaborn": "seaborn", "pallets/flask": "pytest",
    "psf/requests": "pytest_options", "pvlib/pvlib-python": "pytest", "pydata/xarray": "pytest", "pydicom/pydicom": "pytest_options", "pylint-dev/astroid": "pytest", "pylint-dev/pylint": "pytest_options",
    "pytest-dev/pytest": "pytest", "pyvista/pyvista": "pytest", "scikit-learn/scikit-learn": "pytest_v2", "sqlfluff/sqlfluff": "pytest", "sphinx-doc/sphinx": "pytest_v2", "sympy/sympy": "sympy",
    "burntsushi/ripgrep": "cargo", "sharkdp/bat": "cargo", "astral-sh/ruff": "cargo", "tokio-rs/tokio": "cargo", "uutils/coreutils": "cargo", "nushell/nushell": "cargo", "tokio-rs/axum": "cargo",
    "fluent/fluentd": "ruby_unit", "fastlane/fastlane": "rspec_json", "jordansissel/fpm": "rspec_json", "faker-ruby/faker": "ruby_unit", "rubocop/rubocop": "rspec_json",
}
#: Projects whose format depends on the number of the change.
BY_NUMBER = {"immutable-js/immutable-js": {"2006": "jest", "2005": "jest_json"}, "jekyll/jekyll": {"9141": "minitest", "8047": "minitest", "8167": "minitest", "8761": "cucumber", "8771": "cucumber"}}


def parser_of(repo: Column, instance_id: Column) -> Column:
    """The name of a log's format; null for a project or number that isn't known."""
    of = lambda m, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c)
    number = F.regexp_extract(instance_id, r"-(\d+)$", 1)
    out = of(PROJECTS, repo)
    for name, by in BY_NUMBER.items():
        out = F.when(repo == name, of(by, number)).otherwise(out)
    return out


def _meaning(rule: Rule, line: Column) -> Column:
    if isinstance(rule.status, str):
        return F.lit(rule.status)
    return F.element_at(F.create_map(*[F.lit(x) for kv in rule.meaning.items() for x in kv]), F.regexp_extract(line, rule.pattern, rule.status))


def _option(test: Column) -> Column:
    """A test's name, of whose option, if that is a path, the last part stays."""
    main, option = F.regexp_extract(test, r"^(.*?)\[(.*)\]", 1), F.regexp_extract(test, r"^(.*?)\[(.*)\]", 2)
    short = F.when(option.rlike(r"^/(?!/)[^*]*$"), F.concat(F.lit("/"), F.substring_index(option, "/", -1))).otherwise(option)
    return F.when(test.rlike(r"\[.*\]"), F.concat(main, F.lit("["), short, F.lit("]"))).otherwise(test)


#: What is done to the lines of a format before, and to its tests' names after they are found.
_BEFORE = {
    "pytest_v2": lambda x: F.regexp_replace(F.regexp_replace(x, r"\[(\d+)m", ""), r"[\x01-\x1f]", ""),
    "matplotlib": lambda x: F.replace(F.replace(x, F.lit("MouseButton.LEFT"), F.lit("1")), F.lit("MouseButton.RIGHT"), F.lit("3")),
    "chart_js": without_ansi,
    **dict.fromkeys(("go_anywhere", "pytest_routes"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[\p{C}\p{Zl}\p{Zp}]", ""), r"^\s+|\s+$", "")),
}
_AFTER = {"pytest_options": _option, "marked": F.trim}


def _by_lines(rows: DataFrame, key: str, n: str) -> DataFrame:
    """Results of one format, as an expression over lines."""
    line = F.col("_l") if n in PLAIN else F.regexp_replace("_l", r"^\s+|\s+$", "")
    lines = rows.select(key, F.posexplode(F.split("_log", "\n")).alias("_n", "_l")).select(key, "_n", _BEFORE.get(n, lambda x: x)(line).alias("_l"))
    hit = F.lit(None).cast("struct<test:string,status:string>")
    for rule in reversed(LINES[n]):
        test = _AFTER.get(n, lambda x: x)(F.regexp_extract("_l", rule.pattern, rule.test))
        hit = F.when(F.col("_l").rlike(rule.pattern), F.struct(test.alias("test"), _meaning(rule, F.col("_l")).alias("status"))).otherwise(hit)
    lines = lines.select(key, "_n", hit.alias("_h")).where("_h IS NOT NULL")
    return lines.groupBy(key, F.col("_h.test").alias("test")).agg(F.max_by("_h.status", "_n").alias("status"))


#: Characters of logs that one task reads, about.
PART = 4_000_000


def _deal(rows: DataFrame, key: str, chars: int) -> DataFrame:
    """rows by their key in as many parts as their characters take, so that a task's windows and groups are of bounded size however many logs there are."""
    return rows.repartition(chars // PART + 1, key)


def parse(logs: DataFrame, key: str, log: str, parser: Column | str) -> DataFrame:
    """(key, test, status); parser is the name of a format, or a column of names. Of several lines of a test the last counts.

    A null log, or one of an unknown format, has no results. Logs are written once, a folder
    for each format, so only formats that are present are planned and each reads its own; a
    format's logs are dealt by their size.
    """
    if isinstance(parser, str) and parser not in PARSERS:
        raise ValueError(f"no such format: {parser}")
    rows = logs.select(F.col(key), F.col(log).alias("_log"), (F.lit(parser) if isinstance(parser, str) else parser).alias("_p"))
    if isinstance(parser, str) and parser in LINES:
        return _by_lines(rows, key, parser)
    spark, at = logs.sparkSession, scratch(logs.sparkSession, "logs")
    rows.where(F.col("_p").isin(*PARSERS)).write.partitionBy("_p").parquet(at)
    own = rows.select(key, "_log").schema
    kept = spark.read.schema(rows.schema).parquet(gone_at_exit(spark, at))
    sizes = {r[0]: r[1] or 0 for r in kept.groupBy("_p").agg(F.sum(F.length("_log").cast("long"))).collect()}  # no more than there are formats
    parts = []
    for n in sorted(sizes):
        mine = _deal(spark.read.schema(own).parquet(f"{at}/_p={n}"), key, sizes[n])
        parts.append(_by_lines(mine, key, n) if n in LINES else parse_carried(mine, key, "_log", CARRIED[n]) if n in CARRIED else NESTED[n](mine, key))
    out = parts[0] if parts else _by_lines(rows.where(F.lit(False)), key, "pytest")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_carried(logs: DataFrame, key: str, log: str, form: Carried) -> DataFrame:
    """Each line's test is named after the last heading at or before it."""
    lines = logs.select(key, F.posexplode(F.split(log, "\n")).alias("_n", "_l"))
    lines = lines.withColumn("_l", F.regexp_replace("_l", r"\s+$", ""))
    head = F.when(F.col("_l").rlike(form.head), F.regexp_extract("_l", form.head, 1))
    lines = lines.where(F.col("_l").rlike(form.head) | F.col("_l").rlike(form.line.pattern))
    w = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_s", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit(form.none)))
    test = form.name(F.col("_s"), F.regexp_extract("_l", form.line.pattern, form.line.test))
    lines = lines.where(F.col("_l").rlike(form.line.pattern)).select(key, "_n", test.alias("test"), _meaning(form.line, F.col("_l")).alias("status"))
    return lines.groupBy(key, "test").agg(F.max_by("status", "_n").alias("status"))


def parse_json(logs: DataFrame, key: str, log: str) -> DataFrame:
    """Test results of a JSON report {"tests": [{"name", "status"}]}; words are brought to the common ones, the first of a name counts."""
    rows = logs.select(key, F.posexplode(F.from_json(log, "tests array<struct<name string, status string>>")["tests"]).alias("_n", "t"))
    s = F.lower("t.status")
    status = F.when(s.isin("passed", "pass", "ok"), "PASSED").when(s.isin("failed", "fail"), "FAILED").when(s.isin("pending", "skipped", "skip"), "SKIPPED").otherwise("ERROR")
    return rows.groupBy(key, F.col("t.name").alias("test")).agg(F.min_by(status, "_n").alias("status"))


#: Markers of a log's test output, and what a log says if a step before the tests failed.
START, END = ">>>>> Start Test Output", ">>>>> End Test Output"
BAD_CODES = (">>>>> Patch Apply Failed", ">>>>> Reset Failed", ">>>>> Tests Errored", ">>>>> Tests Timed Out")


def applied(log: Column) -> Column:
    """Whether tests ran at all: no step before them failed, and both markers are there."""
    bad = F.lit(False)
    for b in BAD_CODES:
        bad = bad | F.contains(log, F.lit(b))
    return F.coalesce(~bad & F.contains(log, F.lit(START)) & F.contains(log, F.lit(END)), F.lit(False))


def log_section(log: Column) -> Column:
    """The text between the first start marker and the end marker after it."""
    return F.substring_index(F.try_element_at(F.split(log, r"\Q" + START + r"\E"), F.lit(2)), END, 1)


def evaluated(logs: DataFrame, key: str, log: str, parser: Column | str) -> tuple[DataFrame, DataFrame]:
    """(key, applied) of each log, and the results of those where tests ran: of the marked section, or of the whole log if that has none."""
    state = logs.select(key, applied(F.col(log)).alias("applied"))
    ran = logs.where(applied(F.col(log)))
    if not isinstance(parser, str):
        ran, parser = ran.select(key, log, parser.alias("_parser")), F.col("_parser")
    ran = written(ran, "ran")
    inside = written(parse(ran.withColumn(log, log_section(F.col(log))), key, log, parser), "results")
    same = F.col(key).eqNullSafe(F.col("_k"))
    # keys first, as these are small; the logs are looked up by what is left
    none = written(ran.select(F.col(key).alias("_k")).distinct().join(inside.select(key).distinct(), same, "left_anti"), "without")
    rest = parse(ran.join(none, same, "left_semi"), key, log, parser)
    return state, inside.unionByName(rest)
