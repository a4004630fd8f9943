from runloom.operators import logs as L
from pyspark.sql import functions as F
import pytest

P, X, S, E = "PASSED", "FAILED", "SKIPPED", "ERROR"
LOGS = {
    "pytest": ("PASSED a.py::t1\nFAILED a.py::t1 - x\nERROR b\nFAILED\nnothing", {"a.py::t1": X, "b": E}),
    "pytest_options": ("PASSED t[/a/b/c]\nPASSED t[//a]\nFAILED t[x*]z\nPASSED u", {"t[/c]": P, "t[//a]": P, "t[x*]": X, "u": P}),
    "pytest_v2": ("\x1b[32mPASSED\x1b[0m a\nb.py::t PASSED [ 10%] PASSED\nc.py::u FAILED", {"a": P, "b.py::t": P, "c.py::u": X}),
    "matplotlib": ("PASSED t[MouseButton.LEFT]", {"t[1]": P}),
    "seaborn": ("a.py::t PASSED [1%]\nFAILED b - x\nPASSED c", {"a.py::t": P, "b": X, "c": P}),
    "sympy": ("____ sympy/a.py:test_x ____\ntest_b ok\ntest_c extra F\n test_d E", {"sympy/a.py:test_x": X, "test_b": P, "test_c": X, "test_d": E}),
    "django": ("test_a (x.T) ... ok\ntest_b (x.T) ... skipped 'no'\ntest_c ... noise\nok\nFAIL: test_d (y)\ntest_e ... ERROR\ntest_f ... Internal Server Error: /q/\nok", {"test_a (x.T)": P, "test_b (x.T)": S, "test_c": P, "test_d": X, "test_e": E, "test_f": P}),
    "calypso": ("x ./node_modules/.bin/jest a\n  outer\n    inner\n      ✓ one (3ms)\n    other\n      ✕ two\nTest Suites: 1\n      ✓ late", {"outer - inner - one": P, "outer - other - two": X}),
    "karma": ("   ✔ early\nStarting browser\n  A\n    B\n      ✔ one\n  C\n  ✖ two\nSUMMARY:\n   ✔ late", {"A > B > one": P, "A > two": X}),
    "p5js": ("{\n 1) gone:\n}\n  1) outer\n       inner\n         fails:\n  Error\n<a>2) in markup:</a>", {"outer:inner:fails": X}),
    "chart_js": ("Chrome 9.0 (Linux) a test FAILED\n\x1b[31mChrome 9.0 (Linux) b FAILED\x1b[0m", {"a test ": X, "b ": X}),
    "marked": ("1) bad one \nfine", {"bad one": X}),
    "react_pdf": ("PASS a.js (5ms)\nFAIL b.js\nPASS c.js (1.2 s)", {"a.js": P, "b.js": X, "c.js": P}),
    "jest": ("  ✓ adds (3 ms)\n  ✕ fails\n ○ skipped x", {"adds": P, "fails": X, "skipped x": S}),
    "jest_json": ("[PASSED] a b\n[FAILED] c", {"a b": P, "c": X}),
    "vitest": (" ✓ a > b 3ms\n × c\n ↓ d [skipped]", {"a > b": P, "c": X, "d": S}),
    "tap": ("ok 1 one\nnot ok 2 two", {"one": P, "two": X}),
    "redis": ("[ok]: a (3 ms)\n[err]: b in tests/x.tcl\n[ignore]: c", {"a": P, "b": X, "c": S}),
    "jq": ("PASS: a b\n FAIL: c", {"a b": P, "c": X}),
    "doctest": ("x <doctest><TestCase name='a'><SubCase name='s'><Expression success='true'/></SubCase><SubCase name='t'><Expression success='false'/></SubCase></TestCase></doctest> y", {"a > s": P, "a > t": X}),
    "micropython": ("pass  a.py\nFAIL  b.py\nskip  c.py", {"a.py": P, "b.py": X, "c.py": S}),
    "googletest": ("[       OK ] A.b (0 ms)\n[  FAILED  ] A.c (1 ms)", {"A.b": P, "A.c": X}),
    "gotest": ("--- PASS: T/a (0.0s)\n  --- FAIL: T/b (1s)\n--- SKIP: U (0s)", {"T/a": P, "T/b": X, "U": S}),
    "go_first": ("=== RUN   A\n--- PASS: A (0s)\n--- FAIL: A (0s)\n=== RUN   B\npanic: boom", {"A": P, "B": E}),
    "cargo": ("test m::a ... ok\ntest m::b ... FAILED\ntest m::c ... ignored", {"m::a": P, "m::b": X}),
    "maven": ("+ mvn -Dtest=A#b test\n[INFO] BUILD SUCCESS\n+ mvn -Dtest=A#c\n[INFO] BUILD FAILURE", {"A#b": P, "A#c": X}),
    "ant": (" [junit] [PASS] a\n [junit] [ERR] b", {"a": P, "b": X}),
    "gradle": ("A > b PASSED\nC > d FAILED\n> e PASSED", {"A > b": P, "C > d": X}),
    "phpunit": (" ✔ none\nSuite A (x\\y)\n ✔ one\nSuite B (z)\n ✘ two\n ↩ three", {"None > none": P, "Suite A > one": P, "Suite B > two": X, "Suite B > three": S}),
    "minitest": ("A#b. = 0.1 s = .\nA#c. = 0.1 s = F", {"A#b": P, "A#c": X}),
    "cucumber": ("features/a .....\nfeatures/b .F", {"features/a": P, "features/b": X}),
    "ruby_unit": ("test: a(X):\t.: (0.1)\n b(Y): F", {"a(X)": P, "b(Y)": X}),
    "go_passed": ("--- PASS: A (0s)\n--- FAIL: B (0s)\n    --- PASS: A/c (0s)", {"A": P}),
    "go_nested": ("--- PASS: A (0s)\n    --- ERROR: A/b c (1s)\n--- FAIL: A (0s)\n--- SKIP: no time", {"A": X, "A/b c": E}),
    "go_anywhere": ("\x07    --- PASS: A/b (0s)\n--- SKIP: C\nx --- FAIL: D", {"A/b": P, "C": S, "FAIL:": X}),
    "pytest_routes": ("tests/a.py::t PASSED [ 1%]\n\x1btests/b.py::u XPASS\ntests/c.py::v SKIPPED (x)\nunit/d.py PASSED\ntests/e.py::w FAILED", {"tests/a.py::t": P, "tests/b.py::u": X, "tests/c.py::v": S, "tests/e.py::w": X}),
    "jest_suites": ("  ✓ before all\nPASS src/a.test.ts (5 s)\n  ✓ adds up (3 ms)\n  ○ later (skipped)\n  ✓ ab\nFAIL b.spec.jsx\n  ✗ breaks", {"before all": P, "src/a.test.ts | adds up": P, "src/a.test.ts | later": S, "b.spec.jsx | breaks": X}),
    "rspec_json": ("a b - passed\nc - failed", {"a b": P, "c": X}),
}


def test_every_format_has_a_case():
    assert set(LOGS) == L.PARSERS and set(L.PROJECTS.values()) <= L.PARSERS


def test_formats(spark):
    rows = [(n, n, log) for n, (log, _) in LOGS.items()] + [("null", "pytest", None), ("empty", "django", ""), ("unknown", "no such", "PASSED x")]
    df = spark.createDataFrame(rows, "k string, parser string, log string")
    got = {}
    for r in L.parse(df, "k", "log", F.col("parser")).collect():
        got.setdefault(r.k, {})[r.test] = r.status
    assert got == {n: want for n, (_, want) in LOGS.items()}
    for n in ("pytest", "karma", "phpunit"):
        assert {r.test: r.status for r in L.parse(df.where(F.col("k") == n), "k", "log", n).collect()} == LOGS[n][1]
    with pytest.raises(ValueError):
        L.parse(df, "k", "log", "no such")


def test_projects(spark):
    rows = [("django/django", "django__django-1", "django"), ("jekyll/jekyll", "jekyll__jekyll-8761", "cucumber"), ("immutable-js/immutable-js", "i__i-2006", "jest"), ("jekyll/jekyll", "x-1", None), ("a/b", "c-1", None)]
    df = spark.createDataFrame(rows, "repo string, id string, want string")
    assert all(r.x == r.want for r in df.withColumn("x", L.parser_of(F.col("repo"), F.col("id"))).collect())


def test_log_gate(spark):
    inside, whole = f"PASSED out\n{L.START}\nPASSED in\n{L.END}\n", f"{L.START}\nnothing\n{L.END}\nPASSED out"
    rows = [("a", inside), ("b", whole), ("c", L.BAD_CODES[1] + "\n" + inside), ("d", "PASSED x"), ("e", None)]
    state, found = L.evaluated(spark.createDataFrame(rows, "k string, log string"), "k", "log", "pytest")
    assert {r.k: r.applied for r in state.collect()} == {"a": True, "b": True, "c": False, "d": False, "e": False}
    assert sorted((r.k, r.test) for r in found.collect()) == [("a", "in"), ("b", "out")]


def test_json_reports(spark):
    df = spark.createDataFrame([("k", '{"tests": [{"name": "a", "status": "passed"}, {"name": "b", "status": "pending"}, {"name": "a", "status": "failed"}]}'), ("l", "no json"), ("m", None)], "k string, log string")
    assert {r.test: r.status for r in L.parse_json(df, "k", "log").collect()} == {"a": "PASSED", "b": "SKIPPED"}


def test_logs_are_made_once_and_dealt_by_their_size(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def log(name):
        made.add(1)
        return LOGS[name][0]

    names = ("karma", "django", "jq", "phpunit")
    rows = spark.createDataFrame([(i, n) for i in range(40) for n in names], "k long, parser string")
    got = L.parse(rows.select(F.concat("parser", "k").alias("k"), "parser", log("parser").alias("log")), "k", "log", F.col("parser"))
    assert got.count() == 40 * sum(len(LOGS[n][1]) for n in names) and made.value == 160
    monkeypatch.setattr(L, "PART", 500)
    one = L.parse(rows.where("parser = 'django'").select("k", F.lit(LOGS["django"][0]).alias("log")).coalesce(1), "k", "log", "django")
    assert one.select(F.spark_partition_id().alias("p")).distinct().count() > 3


def test_sections_without_results_of_a_null_key(spark):
    text = lambda inside, after: f"{L.START}\n{inside}\n{L.END}\n{after}"
    df = spark.createDataFrame([(None, text("nothing", "PASSED a")), (1, text("PASSED b", "PASSED c")), (2, text("nothing", "FAILED d"))], "k long, log string")
    _, got = L.evaluated(df, "k", "log", "pytest")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "b", P), (2, "d", X), (None, "a", P)]
