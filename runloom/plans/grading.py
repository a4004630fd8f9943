"""Queries over expected tests, logs and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import grading as G
from runloom.operators import logs as L
from runloom.plans.tables import table


def _tests(s, d):
    li = table(s, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "p2p").otherwise("f2p")
    test = F.concat(F.lit("t"), F.col("l_linenumber"))
    return li.groupBy("l_orderkey", test.alias("test"), kind.alias("kind")).agg(F.max("l_returnflag").alias("f"))


def _expected(s, d):
    return _tests(s, d).select("l_orderkey", "test", "kind")


def _results(s, d):
    r = _tests(s, d).where("f != 'A' OR test = 't1'")
    return r.select("l_orderkey", "test", F.when(F.col("f") == "N", "PASSED").when(F.col("f") == "R", "FAILED").otherwise("SKIPPED").alias("status"))


def _graded(s, d):
    return G.graded(_expected(s, d), _results(s, d), ["l_orderkey"])


def _logs(s, d):
    """go test output made from rows, one log for each order."""
    word = F.when(F.col("l_returnflag") == "N", "PASS").when(F.col("l_returnflag") == "R", "FAIL").otherwise("SKIP")
    line = F.concat(F.lit("--- "), word, F.lit(": t"), F.col("l_partkey") % 7, F.lit(" (0.0s)"))
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("log"))


#: By order modulo 6: the project whose log format it is, and the lines of a passed, a failed and a skipped test %t of suite %s.
_FORMATS = [
    ("pallets/flask", "PASSED a.py::%t", "FAILED a.py::%t - boom", "SKIPPED a.py::%t"),
    ("axios/axios", "ok 3 %t", "not ok 3 %t", "# skip %t"),
    ("babel/babel", "  ✓ %t (5 ms)", "  ✕ %t (12 ms)", "  ○ %t"),
    ("redis/redis", "[ok]: %t (3 ms)", "[err]: %t in tests/x.tcl", "[skip]: %t"),
    ("django/django", "%t (m.T) ... ok", "%t (m.T) ... FAIL", "%t (m.T) ... skipped 'no'"),
    ("laravel/framework", "Suite %s (S)\n ✔ %t", "Suite %s (S)\n ✘ %t", "Suite %s (S)\n ↩ %t"),
]


def _format_logs(s, d):
    """Logs of six formats made from rows, one for each order, with markers around; every eleventh lacks its end, every thirteenth tells of a failed step."""
    t, suite = F.concat(F.lit("t"), F.col("l_partkey") % 7), (F.col("l_linenumber") % 2).cast("string")
    line = F.lit("")
    for i, (_, *words) in enumerate(_FORMATS):
        word = F.when(F.col("l_returnflag") == "N", words[0]).when(F.col("l_returnflag") == "R", words[1]).otherwise(words[2])
        line = F.when(F.col("l_orderkey") % 6 == i, F.replace(F.replace(word, F.lit("%t"), t), F.lit("%s"), suite)).otherwise(line)
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    k = F.col("l_orderkey")
    log = F.concat(F.when(k % 13 == 0, L.BAD_CODES[0] + "\n").otherwise(""), F.lit(L.START + "\n"), F.col("body"), F.when(k % 11 == 0, "\n").otherwise("\n" + L.END + "\nPASSED b.py::after"))
    repo = F.element_at(F.array(*[F.lit(r) for r, *_ in _FORMATS]), (k % 6 + 1).cast("int"))
    return g.select("l_orderkey", "body", log.alias("log"), L.parser_of(repo, F.lit("x-1")).alias("parser"))


#: Formats whose lines hang together. What begins a log; the lines of a passed, a failed and a skipped test %t of suite %s (number %n); what ends it; and the name each gets, if any.
_NESTED = [
    ("karma", "   ✔ early\nStarting browser\n  A\n    B", "      ✔ %t", "      ✖ %t", "    nothing", "SUMMARY:\n  ✔ late", "A > B > %t", "A > B > %t", None),
    ("calypso", "x ./node_modules/.bin/jest a", "  S%s\n    inner\n      ✓ %t (3ms)", "  S%s\n    ✕ %t", "  S%s", "Test Suites: 1\n  ✓ late", "S%s - inner - %t", "S%s - %t", None),
    ("p5js", "{\n 1) gone:\n}", "  <pre>%n) in <pre>markup</pre>:</pre>", " %n) S%s\n      %t:\n   Error at <anonymous>", "[\n 2) listed:\n]", "", None, "S%s:%t", None),
    ("django", "Creating ...", "%t (m.T) ... noise\nok", "FAIL: %t (m.T)", "%t (m.T) ... skipped 'no'", "", "%t (m.T)", "%t", "%t (m.T)"),
    ("doctest", "x <doctest>", "<TestSuite><TestCase name='S%s'><SubCase name='%t'><Expression success='true'/></SubCase></TestCase></TestSuite>", "<TestSuite><TestCase name='S%s'><SubCase name='%t'><Expression success='true'/><Expression success='false'/></SubCase></TestCase></TestSuite>", "<TestSuite/>", "</doctest>", "S%s > %t", "S%s > %t", None),
    ("go_first", "start", "=== RUN   %t\n--- PASS: %t (0s)", "=== RUN   %t\n    --- FAIL: %t (0s)", "=== RUN   %t\npanic: no", "", "%t", "%t", "%t"),
    ("go_passed", "", "--- PASS: %t (0s)", "--- FAIL: %t (0s)", "    --- PASS: %t (0s)", "", "%t", None, None),
    ("go_nested", "", "--- PASS: S%s/%t (0s)", "    --- FAIL: S%s/%t (0s)", "--- SKIP: S%s/%t (0s)", "", "S%s/%t", "S%s/%t", "S%s/%t"),
    ("go_anywhere", "", "\x07  --- PASS: %t (0s)", "--- FAIL: %t", "--- SKIP: %t now", "", "%t", "%t", "%t"),
    ("pytest_routes", "", "tests/s%s.py::%t PASSED [ 1%]", "tests/s%s.py::%t XPASS", "tests/s%s.py::%t SKIPPED (x)", "", "tests/s%s.py::%t", "tests/s%s.py::%t", "tests/s%s.py::%t"),
    ("jest_suites", "", "PASS src/s%s.test.ts\n  ✓ test %t (3 ms)", "FAIL src/s%s.test.ts (2 s)\n  ✗ test %t", "  ○ ab", "", "src/s%s.test.ts | test %t", "src/s%s.test.ts | test %t", None),
]


def _nested_logs(s, d):
    """Logs of these formats made from rows, one for each order."""
    k = F.col("l_orderkey") % len(_NESTED)
    of = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in _NESTED]), (k + 1).cast("int"))
    word = F.when(F.col("l_returnflag") == "N", of(2)).when(F.col("l_returnflag") == "R", of(3)).otherwise(of(4))
    for mark, value in (("%t", F.concat(F.lit("t"), F.col("l_partkey") % 7)), ("%s", (F.col("l_linenumber") % 2).cast("string")), ("%n", F.col("l_linenumber").cast("string"))):
        word = F.replace(word, F.lit(mark), value)
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", word.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return g.select("l_orderkey", F.concat_ws("\n", of(1), "body", of(5)).alias("log"), of(0).alias("parser"))


def _nested_sql() -> str:
    """What these logs tell; of a name the last line counts, but in go_first the first, and there a panic only if nothing else."""
    rows = ", ".join("(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in (str(i), n, p, f, k)) + ")" for i, (n, _, _, _, _, _, p, f, k) in enumerate(_NESTED))
    return f"""WITH v(i, n, p, f, k) AS (VALUES {rows}), l AS (SELECT l_orderkey, n, l_linenumber AS a, l_partkey AS b, ascii(l_returnflag) AS flag, CASE l_returnflag WHEN 'N' THEN 'PASSED' WHEN 'R' THEN 'FAILED' WHEN 'A' THEN CASE WHEN n = 'go_first' THEN 'ERROR' ELSE 'SKIPPED' END END AS status,
  replace(replace(CASE l_returnflag WHEN 'N' THEN p WHEN 'R' THEN f ELSE k END, '%t', 't' || l_partkey % 7), '%s', CAST(l_linenumber % 2 AS VARCHAR)) AS test FROM lineitem JOIN v ON CAST(i AS INT) = l_orderkey % {len(_NESTED)}),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, test ORDER BY CASE WHEN n = 'go_first' AND status = 'ERROR' THEN 1 ELSE 0 END, CASE WHEN n = 'go_first' THEN a ELSE -a END, CASE WHEN n = 'go_first' THEN b ELSE -b END, CASE WHEN n = 'go_first' THEN flag ELSE -flag END) AS nth FROM l WHERE test IS NOT NULL)
SELECT l_orderkey, test, status FROM r WHERE nth = 1"""


def _classes(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    preds = o.where("id % 5 != 0").select("id", F.when(F.col("id") % 7 == 0, " ").otherwise(F.col("o_orderpriority")).alias("patch"))
    reports = o.where("id % 11 != 0").select("id", (F.col("o_orderstatus") == "F").alias("resolved"))
    return G.run_report(o.select("id"), preds, reports, "id")


_T = """WITH t AS (SELECT l_orderkey, 't' || l_linenumber AS test, CASE WHEN l_linenumber % 2 = 0 THEN 'p2p' ELSE 'f2p' END AS kind, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT l_orderkey, test, kind, CASE WHEN f = 'A' AND test != 't1' THEN NULL WHEN f = 'N' THEN 'PASSED' WHEN f = 'R' THEN 'FAILED' ELSE 'SKIPPED' END AS status FROM t),
o AS (SELECT *, CASE WHEN status IN ('PASSED', 'XFAIL') THEN true WHEN status IS NULL OR status IN ('FAILED', 'ERROR') THEN false END AS ok FROM g)"""
_C = """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'incomplete' WHEN o_orderkey % 7 = 0 THEN 'empty' WHEN o_orderkey % 11 = 0 THEN 'error' WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'unresolved' END AS class FROM orders)"""
_F = """WITH l AS (SELECT l_orderkey, CASE l_returnflag WHEN 'N' THEN 'PASSED' WHEN 'R' THEN 'FAILED' ELSE 'SKIPPED' END AS status, l_linenumber, l_partkey, 't' || l_partkey % 7 AS t, l_returnflag AS f FROM lineitem),
r AS (SELECT l_orderkey, status, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, f) AS n,
  CASE l_orderkey % 6 WHEN 0 THEN 'a.py::' || t WHEN 4 THEN t || ' (m.T)' WHEN 5 THEN 'Suite ' || l_linenumber % 2 || ' > ' || t ELSE t END AS test FROM l WHERE NOT (l_orderkey % 6 = 1 AND status = 'SKIPPED')),
f AS (SELECT l_orderkey, test, arg_max(status, n) AS status FROM r GROUP BY 1, 2)"""
QUERIES = {
    "q_grading_expected_tests": _graded,
    "q_grading_resolution": lambda s, d: G.resolution(_graded(s, d), ["l_orderkey"]),
    "q_grading_required_passed": lambda s, d: G.all_required_passed(_expected(s, d), _results(s, d).where("status = 'PASSED'"), ["l_orderkey"]),
    "q_grading_running_accuracy": lambda s, d: G.running_accuracy(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_orderkey", F.col("o_orderstatus") == "F", "o_custkey"),
    "q_grading_run_classes": _classes,
    "q_grading_run_report": lambda s, d: G.report_counts(_classes(s, d), "id"),
    "q_grading_run_lists": lambda s, d: G.report_lists(_classes(s, d), "id").select("class", "n", F.md5(F.array_join("ids", ",").cast("binary")).alias("ids_md5")),
    "q_grading_log_lines": lambda s, d: L.parse(_logs(s, d), "l_orderkey", "log", "gotest"),
    "q_grading_log_formats": lambda s, d: L.parse(_format_logs(s, d), "l_orderkey", "body", F.col("parser")),
    "q_grading_log_nested": lambda s, d: L.parse(_nested_logs(s, d), "l_orderkey", "log", F.col("parser")),
    "q_grading_log_applied": lambda s, d: L.evaluated(_format_logs(s, d), "l_orderkey", "log", F.col("parser"))[0],
    "q_grading_log_evaluated": lambda s, d: L.evaluated(_format_logs(s, d), "l_orderkey", "log", F.col("parser"))[1],
    "q_grading_difficulty": lambda s, d: table(s, d, "orders").groupBy(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "hard").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("unknown").alias("bucket")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_resolved"), F.count(F.lit(1)).alias("n")),
}
SQL = {
    "q_grading_expected_tests": _T + " SELECT * FROM o",
    "q_grading_resolution": _T + """, r AS (SELECT l_orderkey, coalesce(count(*) FILTER (kind = 'f2p' AND ok) / nullif(CAST(count(*) FILTER (kind = 'f2p' AND ok IS NOT NULL) AS DOUBLE), 0), 1.0) AS f2p,
  coalesce(count(*) FILTER (kind = 'p2p' AND ok) / nullif(CAST(count(*) FILTER (kind = 'p2p' AND ok IS NOT NULL) AS DOUBLE), 0), 1.0) AS p2p, count(*) AS n_tests FROM o GROUP BY 1)
SELECT *, CASE WHEN f2p = 1 AND p2p = 1 THEN 'FULL' WHEN f2p > 0 AND f2p < 1 AND p2p = 1 THEN 'PARTIAL' ELSE 'NO' END AS resolution FROM r""",
    "q_grading_required_passed": _T + " SELECT l_orderkey, count(*) AS n_required, count(*) FILTER (status IS DISTINCT FROM 'PASSED') AS n_missing, count(*) FILTER (status IS DISTINCT FROM 'PASSED') = 0 AS resolved FROM o GROUP BY 1",
    "q_grading_running_accuracy": "SELECT o_custkey, o_orderkey, o_orderstatus, avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER w AS accuracy, row_number() OVER w AS seen FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "q_grading_run_classes": _C + " SELECT * FROM c",
    "q_grading_run_report": _C + " SELECT class, count(*) AS n, min(id) AS first_id FROM c GROUP BY 1",
    "q_grading_run_lists": _C + " SELECT class, count(*) AS n, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS ids_md5 FROM c GROUP BY 1",
    "q_grading_log_lines": """WITH l AS (SELECT l_orderkey, 't' || l_partkey % 7 AS test, CASE l_returnflag WHEN 'N' THEN 'PASSED' WHEN 'R' THEN 'FAILED' ELSE 'SKIPPED' END AS status, l_linenumber, l_partkey FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, status) AS n FROM l)
SELECT l_orderkey, test, arg_max(status, n) AS status FROM r GROUP BY 1, 2""",
    "q_grading_log_formats": _F + " SELECT * FROM f",
    "q_grading_log_nested": _nested_sql(),
    "q_grading_log_applied": "SELECT l_orderkey, l_orderkey % 13 != 0 AND l_orderkey % 11 != 0 AS applied FROM lineitem GROUP BY 1",
    # an order of the first format without results in its section has those of the whole log
    "q_grading_log_evaluated": _F + " SELECT * FROM f WHERE l_orderkey % 13 != 0 AND l_orderkey % 11 != 0",
    "q_grading_difficulty": "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'hard' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'unknown' END AS bucket, count(*) FILTER (o_orderstatus = 'F') AS n_resolved, count(*) AS n FROM orders GROUP BY 1",
}
