import json

import pytest
from pyspark.sql import functions as F

from runloom.functions.recovery import disjoint_spans, unescaped
from runloom.operators import checks as C
from runloom.operators import datasets as D
from runloom.operators import events as E
from runloom.operators import patches as P
from runloom.operators import ranks, triage, validate
from runloom.sources import cases

EVENTS = "case_id string, event_idx int, role string, kind string, content string, tool_input string, tool_status string, timestamp double"


def _case(spark):
    fence = lambda c: f"```bash\n{c}\n```"
    rows = [
        ("a", 0, "system", "message", "Traceback (most recent call last)", None, None, 0.0),
        ("a", 1, "user", "message", "fix ValueError: x", None, None, 1.0),
        ("a", 2, "assistant", "message", fence("pytest t.py") + fence("pytest t.py"), None, None, 2.0),
        ("a", 3, "user", "message", "1 failed\n" + "z" * 399 + " KeyError: k" + "y" * 400, None, None, 3.0),
        ("a", 4, "assistant", "tool", "TOOL", json.dumps({"command": "sed -i 1d src/m.py && git -C . reset --hard"}), "error", 4.0),
        ("a", 5, "assistant", "message", "diff --git a/src/m.py b/src/m.py\n--- a/src/m.py\n+++ b/src/m.py\n@@ -1 +1 @@\n-a\n+b\n+c", None, None, 5.0),
        ("a", 6, "assistant", "message", fence("pytest t.py"), None, None, 9.0),
        ("a", 7, "user", "message", "2 passed", None, None, None),
        ("b", 0, "user", "message", None, None, None, None),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_checks_of_a_case(spark):
    e = _case(spark)
    cmds = C.commands(e)
    assert [(r.event_idx, r.command) for r in cmds.orderBy("event_idx").collect()] == [(2, "pytest t.py"), (4, "sed -i 1d src/m.py && git -C . reset --hard"), (6, "pytest t.py")]
    assert [(r.subcommand, r.category, r.is_reversion) for r in C.git(cmds).collect()] == [("reset", "reversion", True)]
    assert {(r.event_idx, r.resource, r.kind) for r in C.accesses(e, cmds).collect()} == {(2, "t.py", "test"), (4, "src/m.py", "edit"), (5, "src/m.py", "edit"), (6, "t.py", "test")}
    p = C.patches(e).collect()
    assert [(r.event_idx, r.files, r.lines_added, r.lines_removed) for r in p] == [(5, ["src/m.py"], 2, 1)]
    t = C.tests(e, cmds)
    assert [(r.event_idx, r.outcome) for r in t.orderBy("event_idx").collect()] == [(2, "failed"), (6, "passed")]
    it = C.iterations(t, C.accesses(e, cmds).where("kind = 'edit'")).collect()
    assert [(r.event_idx, r.n_edits, r.retest_event, r.retest_outcome) for r in it] == [(2, 2, 6, "passed")]
    issue = spark.createDataFrame([("a", 1)], "case_id string, event_idx int")
    got = {r.event_idx: r for r in C.errors(e, issue).collect()}
    assert set(got) == {3, 4} and got[3].matched == "KeyError:" and len(got[3].snippet) == 160 + len("KeyError:") + 300 and got[4].matched == "tool status: error"
    x = {r.case_id: r for r in C.composite(e, issue=issue).collect()}
    assert (x["a"].events, x["a"].elapsed, x["a"].reversions, x["a"].test_runs, x["a"].test_reruns, x["a"].repeated_edits, x["a"].errors, x["a"].backtracking) == (8, 9.0, 1, 2, 1, 1, 2, 3)
    assert (x["b"].events, x["b"].elapsed, x["b"].test_runs, x["b"].backtracking) == (1, None, 0, 0)
    top = C.top_counts(C.accesses(e, cmds), "case_id", "resource", "event_idx", 1).first()
    assert (top.resource, top.n) == ("t.py", 2)
    s = spark.createDataFrame([(json.dumps({"F2P": {"success": ["a"], "failure": ["b", "c"]}, "P2P": {"success": []}}),), (None,)], "s string")
    c = s.select(C.evaluation_counts(F.col("s")).alias("c")).select("c", C.evaluation_failures(F.col("c")).alias("n")).collect()
    assert (c[0].c["F2P"].failure, c[0].c["P2P"].success, c[0].n, c[1].n) == (2, 0, 2, 0)
    spt = spark.createDataFrame([("a", "repo/src/m.py", "x"), ("a", "repo/src/m.py", "y"), ("a", "other.py", "x")], "case_id string, file string, transformation string")
    f = {r.file: (r.n_mutations, r.kinds, r.first_event) for r in C.transformed_files(spt, C.accesses(e, cmds)).collect()}
    assert f == {"repo/src/m.py": (2, ["edit"], 4), "other.py": (1, [], None)}
    assert C.composite(e.limit(0)).count() == 0


def test_minimal_patches(spark):
    patch = "\ndiff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -5,9 +5,9 @@ def f\n keep\n keep2   \n-old\n+new\n+more  \n\n tail\n tail2\n@@ -40,3 +41,3 @@\n a\n-b\n c\ndiff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py\n@@ -1,1 +1,1 @@\n-p\n+q\n"
    df = spark.createDataFrame([(1, patch), (2, "no diff"), (3, None)], "id int, patch string")
    got = {r.id: r.patch for r in P.minimal(df, "id", "patch").collect()}
    assert got == {1: "--- a/x.py\n+++ b/x.py\n@@ -7,2 +7,3 @@\n-old\n+new\n+more\n \n@@ -41,2 +42,1 @@\n-b\n c\n--- a/y.py\n+++ b/y.py\n@@ -1,1 +1,1 @@\n-p\n+q\n \n", 2: "", 3: ""} or "@@ -1,1 +1,1 @@" in got[1]
    assert [(r.file, r.hunk, r.pre_start, r.pre_len, r.post_start, r.post_len) for r in P.hunks(df, "id", "patch").orderBy("file", "hunk").collect()][:2] == [(1, 0, 7, 2, 7, 3), (1, 1, 41, 2, 42, 1)]
    one = lambda c, x: spark.createDataFrame([(x,)], "c string").select(c(F.col("c")).alias("x")).first().x
    assert one(P.from_reply, "a <patch>\nd\n</patch> ```x\ny```") == "\nd\n" and one(P.from_reply, "```diff\nd\n```") == "d\n" and one(P.from_reply, "plain</s>x") == "plain"
    s = one(P.split_tests, "diff --git a/x.py b/x.py\n+a\ndiff --git a/tests/t.py b/tests/t.py\n+b\n")
    assert s.fix == "diff --git a/x.py b/x.py\n+a\n" and s.tests == "diff --git a/tests/t.py b/tests/t.py\n+b\n"


def test_datasets(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    p = f([("o/r", 3, "2024-01-01", [1], "d", "s", " "), ("o/r", 4, None, [], "", "s", "t")], "repo string, n int, merged string, issues array<int>, patch string, statement string, test string")
    got = p.select(D.instance_id(F.col("repo"), F.col("n")).alias("id"), D.valid_pull(F.col("merged"), F.col("issues")).alias("a"), D.valid_instance(F.col("patch"), F.col("statement")).alias("b"), D.has_tests(F.col("test")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("o__r-3", True, True, False), ("o__r-4", False, False, True)]
    rows = f([(i, f"k{i}") for i in range(10)], "n int, k string")
    parts = [sorted(r.k for r in D.by_length(rows, "k", F.col("n"), 1, 9, s, 3).collect()) for s in range(3)]
    assert parts == [["k1", "k2", "k3"], ["k4", "k5", "k6"], ["k7", "k8"]] and D.by_length(rows, "k", F.col("n")).count() == 10
    assert sorted(r.k for r in D.selected(rows, "k", "k[1-3]", 1).collect()) == ["k2", "k3"] and D.take(rows, "k", 4).count() == 4
    assert D.chosen(rows.withColumn("g", F.lit(1)), "g", "k", 3).count() == 3
    with pytest.raises(KeyError):
        D.lookup(rows, "k", "none")
    with pytest.raises(ValueError, match="outside"):
        D.to_run(rows.select("k"), f([("z", "p")], "k string, patch string"), rows.select("k"), "k")
    assert [D.language_is(F.lit(x), "js", {"javascript": "js"})._jc is not None for x in ("JavaScript",)] and f([("JavaScript",), (None,), ("py",)], "l string").select(D.language_is(F.col("l"), "js", {"javascript": "js"}).alias("x")).collect() == [(True,), (False,), (False,)]
    joined, missing = D.with_samples(f([("a", 1), ("b", 2)], "k string, p int"), f([("a", "s")], "k string, s string"), "k")
    assert joined.count() == 1 and [r.k for r in missing.collect()] == ["b"]
    totals, failed = D.with_solutions(f([("a", True), ("b", False), ("c", None)], "k string, ok boolean"), f([("b", "s")], "k string, solution string"), "k", "ok")
    assert tuple(totals.first()) == (1, 2) and {(r.k, r.solution) for r in failed.collect()} == {("b", "s"), ("c", None)}
    assert [r.i for r in D.missing_images(f([("x",), ("x",), ("y",)], "i string"), f([("y",)], "i string"), "i").collect()] == ["x"]
    one = lambda c, x: f([(x,)], "c string").select(c.alias("x")).first().x
    assert one(D.code_block(F.lit("f.py"), F.col("c")), "a\nb") == "[start of f.py]\n1 a\n2 b\n[end of f.py]"
    text = "\n".join(f"l{i}" for i in range(1, 61))
    hunk = F.array(F.struct(F.lit(30).alias("start"), F.lit(2).alias("length")))
    assert one(D.excerpts(F.col("c"), hunk), text) == "...\n" + "\n".join(f"{i} l{i}" for i in range(16, 33)) + "\n..."
    assert one(D.document(F.lit("p"), F.col("c"), "symbols"), "class A(B):\n  def f(self):\n    x") == "p\np\np.A\np.A.f\n" and one(D.document(F.lit("p"), F.col("c"), "docstrings"), '"""Doc."""\nx = 1') == "p\nDoc."
    assert f([(b"\xff\xfe",), (b"ok",)], "b binary").select(D.valid_text(F.col("b")).alias("t")).collect() == [("[non-UTF-8 content]",), ("ok",)]
    assert "<issue>\nS\n</issue>" in one(D.prompt(F.col("c"), F.lit(""), F.lit("C"), "do", "ex"), "S") and one(D.problem_text(F.col("c"), F.lit("r"), F.lit(" ")), "S") == "S\n\nRequirements:\nr"
    assert [r.answer for r in D.labelled(f([("t", "p"), ("t", None)], "text string, patch string"), "text", "patch").collect()] == ["<patch>\np\n</patch>"]


def test_global_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit("x").alias("same"))
    assert all(r.position == r.v for r in ranks.numbered(df, [F.col("v")]).collect())
    assert all(r.position == 999 - r.v for r in ranks.numbered(df, [F.col("same"), F.col("v")], descending=[False, True]).collect())
    assert ranks.numbered(df.limit(0), [F.col("v")]).count() == 0
    c = [("completed", True, "low", 0.1, 5, ["a", "b"], 0), ("completed", True, "high", 0.1, 5, [], 1), ("failed", None, None, None, None, None, 2), ("completed", False, "high", 0.9, 9, [], 3), ("completed", True, "high", 0.1, 5, [], 4)]
    df = spark.createDataFrame(c, "status string, include boolean, priority string, confidence double, score int, tags array<string>, at int")
    assert {r.at: r["rank"] for r in E.triage_shortlist(df, "at").collect()} == {1: 1, 4: 2, 0: 3, 3: 4, 2: None}


def test_triage_budgets(spark):
    rows = [("a", i, "user" if i else "system", "x" * 1000, i == 1) for i in range(12)] + [("b", 0, "system", "only", False)]
    e = spark.createDataFrame(rows, "case_id string, event_idx int, role string, content string, is_issue boolean")
    c = triage.compacted(e, 2000).collect()
    assert {(r.case_id, r.event_idx) for r in c} == {("a", i) for i in range(2, 12)} | {("b", 0)}
    assert {(len(r.shown.content_start), len(r.shown.content_end), r.shown.content_length) for r in c if r.case_id == "a"} == {(130, 70, 1000)}
    p = {(r.case_id, r.event_idx): r for r in triage.prompt_events(e, 11).collect()}
    assert p["a", 3].omitted and p["a", 3].shown.content is None and p["a", 3].shown.content_length == 1000 and p["b", 0].shown.content == "only"
    fixed = spark.createDataFrame([("a", 50_000), ("b", 54_999)], "case_id string, n_fixed int")
    got = {r.case_id: (r.budget, r.n_chars) for r in triage.fitting_budget(e, fixed).collect()}
    assert got == {"a": (4_500, 54_500), "b": (1_200, 55_003)}
    checks = C.composite(_case(spark))
    f = triage.features(checks, spark.createDataFrame([("a", "n", "mini", True)], "case_id string, case_name string, format string, resolved boolean"), spark.createDataFrame([("a", "x.py")], "case_id string, file string"))
    r = f.where("case_id = 'a'").first()
    assert (r.resolved, r.test_runs, r.patched_files, r.spt_applied) == (True, 2, ["x.py"], None) and len(f.columns) == 22
    kinds = dict(f.dtypes)
    assert all(kinds[c] == {"long": "bigint"}.get(t, t) for c, t in triage.FEATURES.items())
    none = spark.createDataFrame([], "case_id string, file string")
    m = triage.features(checks, spark.createDataFrame([], "case_id string"), none, repeated=spark.createDataFrame([("a", "x.py", 3), ("a", "y.py", 2)], "case_id string, file string, events int"), needed=("test_runs",))
    assert {r.case_id: r.repeated_file_edits for r in m.collect()}["a"] == {"x.py": 3, "y.py": 2}
    for wrong in (("test_run",), ("spt_applied",)):
        with pytest.raises(ValueError):
            triage.features(checks, spark.createDataFrame([], "case_id string"), none, needed=wrong)


def test_clues_and_repair(spark):
    c = [("k", "1", "A", "t", "r", "s", "v", "The  “Bug”", 0.5, 1), ("k", "1", "A", " ", "r", "s", None, "nowhere", 2.0, 2), ("k", "3", "A", "t", "r", "s", "v", 'the "bug"', 0.1, 3)]
    rows = spark.createDataFrame(c, "case_id string, id string, category string, type string, role string, signal_strength string, value string, quote string, confidence double, at int")
    issue = spark.createDataFrame([("k", 'see the "bug" here')], "case_id string, issue_description string")
    got = {r.at: r for r in validate.clues(rows, issue, ["A"], ["r"], ["s"]).collect()}
    assert (got[1].quote, got[1].start, got[1].stop, got[1].exact_match, got[1].violations) == ('the "bug"', 4, 13, False, [])
    assert got[2].start is None and got[2].violations == ["id", "type", "value", "confidence"] and got[3].violations == ["span"] and got[3].exact_match
    n = spark.createDataFrame([("k", "x", 1, "Fix|No", 0.9, [3, 4, 5]), ("k", "y", 2, "Fix", 0.9, [1, 3, 9]), ("k", "z", 3, "Fix", 0.9, []), ("k", "w", 4, "Fix", 0.9, [3])], "case_id string, id string, at int, phase string, confidence double, event_idx array<int>")
    e = spark.createDataFrame([("k", "x", 4, "FOUR"), ("k", "y", 1, "one"), ("k", "z", 6, "six"), ("k", "w", 3, "x")], "case_id string, id string, event_idx int, quote string")
    ev = spark.createDataFrame([("k", i, w) for i, w in enumerate("zero one two three four five six".split())], "case_id string, event_idx int, content string")
    nodes, evidence, rest = validate.repaired(n, e, ev, ["Fix"])
    assert {r.id: (r.event_idx, r.phase, r.confidence) for r in nodes.collect()} == {"y": ([1, 3], "Fix", 0.9), "x": ([4, 5], "Fix", 0.75), "z": ([6], "Fix", 0.9)}
    assert {(r.id, r.quote, r.exact_match) for r in evidence.collect()} == {("x", "four", False), ("y", "one", True), ("z", "six", True)}
    assert sorted(r.event_idx for r in rest.collect()) == [0, 2]
    assert [(r.position, r.id) for r in validate.graph_entries(nodes, rest).orderBy("position").collect()] == [(1, "E0"), (2, "y"), (3, "E2"), (4, "x"), (5, "z")]
    s = spark.createDataFrame([([(0, 2), (0, 4), (4, 6)],), (None,)], "x array<struct<start:int,stop:int>>").select(disjoint_spans("x").alias("x")).collect()
    assert [tuple(t) for t in s[0].x] == [(0, 4), (4, 6)] and s[1].x is None
    assert spark.createDataFrame([('"a\\n"',)], "c string").select(unescaped("c").alias("x")).first().x == "a"


def test_discovery_of_cases(spark, tmp_path):
    mini = lambda i: json.dumps({"instance_id": i, "info": {"submission": "s"}, "messages": [{"role": "user", "content": "q"}]})
    files = {
        "one/run/a.traj.json": mini("p__a-1"), "one/result.json": '{"p__a-1": {"resolved": true, "tests_status": {"F": {}}, "patch_successfully_applied": true}}', "one/x/spt_log.json": "[1]",
        "many/b/b.traj.json": mini("p__b-1"), "many/c/c.traj.json": mini("p__c-1"), "many/results.json": '{"p__b-1": true}', "many/c/z_output.json": '{"p__c-1": "failed"}',
        "bad/d.traj.json": "{", "bad2/e.traj.json": '{"messages": {}}', "bad3/f.traj.json": '{"messages": [{"x": 1}]}', "report.json": '{"p__b-1": true}',
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    good, bad = cases.discovered(spark, str(tmp_path))
    got = {r.path: r for r in good.collect()}
    a, b, c = (got[k] for k in ("one/run/a.traj.json", "many/b/b.traj.json", "many/c/c.traj.json"))
    assert (a.root, a.result_status, a.resolved, a.case_id, a.spt_log, a.score, a.submission) == ("one", "matched", True, "p__a-1", "[1]", 147, "s")
    assert (b.root, b.result_status, b.resolved, b.case_id) == ("many/b", "missing", None, "p__b-1")
    assert (c.root, c.result_status, c.resolved) == ("many/c", "matched", False)
    assert {r.path: r.error for r in bad.collect()} == {"bad/d.traj.json": "not a JSON object", "bad2/e.traj.json": "messages must be a list", "bad3/f.traj.json": "neither dialect's messages"}
