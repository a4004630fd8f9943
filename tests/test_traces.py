import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from runloom.functions import recovery
from runloom.functions import text as X
from runloom.operators import events as E
from runloom.operators import grading as G
from runloom.operators import checks, retrieval, validate
from runloom.sources import archives, sinks, trajectories
from runloom.streaming import runs as S


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first().x


def test_git_classes(spark):
    cases = {
        "git -C repo checkout -- a.py": "reversion", "git -C repo status": "inspection", "git reset --hard": "reversion", "git reset": "index_change", "git reset a.py": "index_change", "git reset HEAD~1": "reversion",
        "git restore --staged a": "index_change", "git restore --staged --worktree a": "reversion", "git restore a": "reversion", "git clean -fd": "destructive_cleanup", "git commit -m x": "recording",
        "git checkout main": "state_change", "git checkout ABCD": "reversion", "git checkout -b topic": "state_change", "git --no-pager -c a=b log": "inspection", "git revert abc": "reversion", "git stash": "state_change", "git": None, "ls": None,
    }
    df = spark.createDataFrame(list(cases.items()), "c string, want string")
    for r in df.withColumn("got", X.git_class(F.col("c"))).collect():
        assert r.got == r.want, r.c
    assert one(spark, X.commands(F.col("c")), c="cd a && git diff; ls || true") == ["cd a", "git diff", "ls", "true"]
    assert one(spark, X.git_commands(F.col("c")), c="cd a && env git diff; ls || git  log -1 ") == ["git diff", "git  log -1"]


def test_command_kinds_and_outcomes(spark):
    kinds = {"cat x | pytest": "read", "pytest 2>&1": "test", "sed -i s/a/b/ f": "edit", "cat > f": "edit", "grep x f | cat": "search", "python -m unittest": "test", "go test ./...": "test", "ls": "other", "patch -p1 < d": "edit", "echo a > b": "other"}
    for r in spark.createDataFrame(list(kinds.items()), "c string, want string").withColumn("got", X.command_kind(F.col("c"))).collect():
        assert r.got == r.want, r.c
    said = {"3 failed, 2 passed": "failed", "0 failed, 2 passed": "failed", "2 passed": "passed", "AssertionError": "failed", "ERROR x": "error", "all tests ok": "passed", "": "unknown", "Traceback": "error"}
    for r in spark.createDataFrame(list(said.items()), "c string, want string").withColumn("got", X.test_outcome(F.col("c"))).collect():
        assert r.got == r.want, r.c
    assert one(spark, X.runs_tests(F.col("c")), c="cat x | pytest") and not one(spark, X.runs_tests(F.col("c")), c="cat mypytest")
    assert one(spark, X.shell_blocks(F.col("c")), c="a ```bash\nls\n``` b ```\nls\n``` ```sh\ncd\n```") == ["ls", "cd"]
    assert one(spark, X.file_tokens(F.col("c")), c="see a/src/x.py and (src/x.py), y.md http://h/z.py /dev/null") == ["src/x.py", "y.md", "z.py"]


def test_statement_criteria(spark):
    h = "0123456789abcdef0123456789abcdef01234567"
    cases = [(h, True), (f"/{h}", False), ("1234567", False), ("[0123456789abcdef0123456]", True), (h + "0", False), (None, False)]
    for r in spark.createDataFrame(cases, "c string, want boolean").withColumn("got", X.has_commit_hash(F.col("c"))).collect():
        assert r.got == r.want, r.c
    for text, want in {"see a.PNG": True, "b.mpeg!": True, "png": False, "x.pngs": False, ".png": False}.items():
        assert one(spark, X.has_image(F.col("c")), c=text) == want, text
    assert one(spark, X.has_link(F.col("c")), c="http://x") and not one(spark, X.has_link(F.col("c")), c="www.x") and one(spark, X.has_link(F.col("c"), "o/r"), c="www.x")
    for text, want in {"Fixes #3": True, "prefixes #3": False, "see #3": False, "https://gitlab.com/a/b/issues": True}.items():
        assert one(spark, X.has_issue_reference(F.col("c")), c=text) == want, text
    for text, want in {"pytest.raises(E, match='x')": True, "pytest.raises(E)": False, "self.assertRaises(E)": True, "assert x": False}.items():
        assert one(spark, X.asserts_on_message(F.col("c")), c=text) == want, text
    for text, want in {"a\nImportError: x": True, "import a\nerror": False, "AttributeError": True}.items():
        assert one(spark, X.has_attribute_or_import_error(F.col("c")), c=text) == want, text
    for text, want in {"+ error: x": "ok", "litellm.RateLimitError": "error", " \n": "empty", "ratelimiterror": "ok"}.items():
        assert one(spark, X.patch_class(F.col("c")), c=text) == want, text
    u = one(spark, X.issue_url(F.col("c")), c="https://github.com/o/r/issues/12#x")
    assert (u.owner, u.repo, u.number) == ("o", "r", 12) and one(spark, X.issue_url(F.col("c")), c="x") is None


def test_agent_messages(spark):
    text = "```bash\ncat ./src/a.py && sed -i s/x/y/ lib/b.py > out.py\n``` ```bash\npython test_c.py /tmp/reproduce_x.py\n```"
    assert sorted(one(spark, X.files_touched(F.col("c")), c=text)) == ["b.py", "lib/b.py", "out.py", "src/a.py"]  # a path within a path counts too
    assert one(spark, X.one_action(F.col("c")), c="x ```bash\nls -a\n```") == "ls -a" and one(spark, X.one_action(F.col("c")), c=text) is None
    assert one(spark, X.is_submission(F.col("c"), F.lit(0), ("DONE",)), c="\nDONE\nx") and not one(spark, X.is_submission(F.col("c"), F.lit(1), ("DONE",)), c="DONE")
    assert one(spark, X.over_limits(F.col("c"), F.lit(1.0), F.lit(0), F.lit(0)), c=9) is False and one(spark, X.over_limits(F.col("c"), F.lit(1.0), F.lit(9), F.lit(0)), c=9) is True
    assert one(spark, X.image_name(F.col("c"), "reg/"), c="A__b-1") == "reg/a_1776_b-1:latest"
    assert one(spark, X.minor_version(F.col("c")), c='"""__version__ = "9.9"""\n__version__ = "1.2.3"') == "1.2" and one(spark, X.minor_version(F.col("c")), c="VERSION = (3, 4, 0)") == "3.4"
    k = one(spark, X.keywords(F.col("c")), c='```json\n{"keywords": [" a", "b", "a"]}\n```')
    assert (k.keywords, k.failed) == (["a", "b"], False) and one(spark, X.keywords(F.col("c")), c="no").failed and not one(spark, X.keywords(F.col("c")), c='{"keywords": []}').failed
    assert [one(spark, X.is_test_path(F.col("c")), c=p) for p in ("src/tests/a.py", "src/contest.py", "a_test.py")] == [True, False, True]


def test_text_functions(spark):
    d = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n-a\n+b\n+c\ndiff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n"
    s = one(spark, X.diff_summary(F.col("c")), c=d)
    assert (s.files, s.lines_added, s.lines_removed, s.hunks) == (2, 2, 1, 1)
    assert "i.png" not in one(spark, X.without_binary(F.col("c")), c=d)
    assert one(spark, X.issue_references(F.col("c")), c="fixes #12 <!-- closes #3 --> Resolve #4") == ["12", "4"]
    assert one(spark, X.issue_text(F.col("c")), c="x <issue> body </issue>") == "body"
    assert one(spark, X.greedy_packing(F.array(F.lit(5), F.lit(9), F.lit(3)), 8), c="") == [0, 2]
    assert one(spark, X.packed_labels(F.array(F.lit(1), F.lit(2)), F.array(F.lit(7))), c="") == [-100, -100, 7]
    a, b = X.split_id(F.col("c"))
    assert (one(spark, a, c="p__q-1_s_7"), one(spark, b, c="p__q-1_s_7"), one(spark, b, c="x")) == ("p__q-1_s", "7", "")
    assert one(spark, X.tri_state(F.col("c")), c="maybe") is None and one(spark, X.tri_state(F.col("c")), c="Success ") is True
    assert one(spark, X.without_ansi(F.col("c")), c="\x1b[31mred\x1b[0m") == "red"


def test_recovery():
    full = {"info": {"a": "}"}, "messages": [{"role": "user", "n": i} for i in range(3)]}
    text = json.dumps(full)
    assert recovery.recovered(text)["messages"] == full["messages"]
    cut = recovery.recovered(text[:-20])
    assert cut["truncated"] and cut["info"] == {"a": "}"} and cut["messages"] == full["messages"][:2]
    assert recovery.recovered(None)["messages"] == [] and recovery.recovered("[1]")["info"] is None
    assert recovery.locate("Say  “HI”", 'they say "hi" now') == (5, 13, False)
    assert recovery.locate("abc", "xabc") == (1, 4, True) and recovery.locate("q", "x") is None
    assert recovery.spans([(3, 5), (0, 2), (0, 4), (4, 6)]) == [(0, 4), (4, 6)]
    assert [n["events"] for n in recovery.ordered_nodes([{"id": "b", "events": [3, 4, 5]}, {"id": "a", "events": [1, 3, 4]}])] == [[1, 3, 4], [5]]
    assert recovery.loose_unescape('"a\\n\\"b"') == 'a\n"b' and recovery.loose_unescape("a\\nb\\") == "a\nb\\" and recovery.loose_unescape(None) == ""
    assert recovery.locate("a – b…", "A - b") == (0, 5, False) or recovery.locate("a – b", "A - b") == (0, 5, False)
    assert recovery.locate("une fois.\n", "X. Une Fois.\nune fois.") == (3, 13, False) and recovery.locate(" b", "a B b") == (3, 5, True) and recovery.locate("\nle", "\nLe le") == (0, 3, False)
    assert recovery.locate("b\n", "İB\nb") == (1, 3, False)
    assert recovery.locate("...x y...", "ax y") == (1, 4, False) and recovery.locate("..x", "x") is None


def test_cycles_and_segments(spark):
    e = spark.createDataFrame([("c", i, k) for i, k in enumerate(["fail", "edit", "edit", "pass", "fail", "edit"])], "case string, i int, k string")
    got = [tuple(r) for r in E.cycles(e, "case", ["i"], "k", "fail", ["fail", "pass"], "edit").orderBy("test_event").collect()]
    assert got == [("c", 1, 4, "pass", 2), ("c", 5, None, None, 1)]
    assert E.segments(e, "case", ["i"], "k").agg(F.sum("n_events")).first()[0] == 6
    seen = [(r.n_seen, r.revisit) for r in E.cumulative_distinct(e, "case", ["i"], "k").orderBy("i").collect()]
    assert seen == [(1, False), (2, False), (2, True), (3, False), (3, True), (3, True)]
    a = spark.createDataFrame([("c", "src/a.py", 3), ("c", "b/src/a.py", 2), ("c", "xa.py", 1)], "case string, path string, at int")
    t = spark.createDataFrame([("c", "a.py")], "case string, target string")
    assert tuple(E.access_to_targets(a, t, "case", "path", "target", "at").first()) == ("c", "a.py", 2, 2)


def test_grading_edges(spark):
    ex = spark.createDataFrame([("i", "a", "f2p"), ("i", "b", "f2p"), ("i", "c", "p2p"), ("j", "a", "f2p")], "id string, test string, kind string")
    res = spark.createDataFrame([("i", "a", "PASSED"), ("i", "b", "SKIPPED"), ("i", "c", "XFAIL")], "id string, test string, status string")
    g = G.graded(ex, res, ["id"])
    assert {(r.id, r.test): r.ok for r in g.collect()} == {("i", "a"): True, ("i", "b"): None, ("i", "c"): True, ("j", "a"): False}
    assert {r.id: r.resolution for r in G.resolution(g, ["id"]).collect()} == {"i": "FULL", "j": "NO"}


def test_archives_and_trajectories(spark, tmp_path):
    mini = {"info": {"exit_status": "Submitted", "submission": "abc", "model_stats": {"api_calls": 2, "instance_cost": 0}, "config": {"model": {"model_name": "Qwen-x"}}}, "messages": [{"role": "user", "content": "hi", "timestamp": 10.0}, {"role": "assistant", "content": "a", "timestamp": 12.5, "extra": {"response": {"usage": {"prompt_tokens": 1000, "completion_tokens": 10}}}}]}
    oc = {"info": {"id": "s", "cost": 1.5, "tokens": {"input": 7, "output": 3, "cache": {"read": 1, "write": 2}}}, "messages": [{"info": {"role": "assistant", "time": {"created": 1e12, "completed": 1e12 + 4000}}, "parts": [{"type": "text", "text": "t"}, {"type": "tool", "tool": "bash", "state": {"status": "ok", "input": {"c": 1}, "output": "o"}}]}]}
    files = {"w/p__q-1_a/run.traj.json": json.dumps(mini), "w/p__q-1_a/spt_log.json": '[{"order":1,"transformation":"x"},{"order":2,"transformation":"x"}]', "w/p__q-1_b/s.traj.json": json.dumps(oc), "w/p__q-1_b/report/eval_results.json": '{"p__q-1": true}', "../evil__x/a.json": "{}", "w/loose__file": "x"}
    with tarfile.open(tmp_path / "r.tar.gz", "w:gz") as t:
        for n, c in files.items():
            i = tarfile.TarInfo(n)
            i.size = len(c)
            t.addfile(i, io.BytesIO(c.encode()))
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    for name in ("r.tar.gz", "r.zip"):
        s = archives.assembled(archives.load(spark, str(tmp_path / name)))
        got = {r["sample"]: r for r in s.withColumn("spt", archives.spt_breakdown(F.col("spt_log"))).withColumn("status", archives.status(s)).collect()}
        assert sorted(got) == ["p__q-1_a", "p__q-1_b"] and got["p__q-1_a"].spt == {"x": 2}
        assert (got["p__q-1_b"].status, got["p__q-1_a"].status, got["p__q-1_a"].sample_id) == ("resolved", "unknown", "a")
        with pytest.raises(Exception, match="unsafe path"):
            archives.archive(spark, str(tmp_path / name), unsafe="reject").count()
    assert archives.archive(spark, str(tmp_path / "r.zip"), "w/p__q-1_a").count() == 2 and archives.load(spark, str(tmp_path / "r.tar.gz"), "none").count() == 0
    t = trajectories.parsed(s)
    m = {r["sample"]: r for r in trajectories.metrics(t).collect()}
    a, b = m["p__q-1_a"], m["p__q-1_b"]
    assert (a.dialect, a.steps, a.exit_status, a.input_tokens) == ("mini", 2, "Submitted", 1000) and abs(a.cost - (1000 * 0.285 + 10 * 2.4) / 1e6) < 1e-12
    assert (b.dialect, b.steps, b.cost, b.input_tokens, b.cache_write_tokens) == ("opencode", 1, 1.5, 7, 2)
    e = trajectories.events(t, "sample").orderBy("sample", "event_idx").collect()
    assert [(x.id, x.duration_seconds, x.duration_is_estimated) for x in e] == [("E0", 2.5, False), ("E1", None, False), ("E0", 2.0, True), ("E1", 2.0, True)]


def test_run_records(spark, tmp_path):
    """Statuses, steps, files and costs of samples, a folder for each."""
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+error: b\n"
    bash = lambda c: {"role": "assistant", "content": f"```bash\n{c}\n```"}
    mini = {"info": {"model_stats": {"api_calls": 0, "instance_cost": 0.5}}, "messages": [{"role": "user", "content": "q"}, bash("cat src/a.py"), bash("cat src/a.py ./b.py")]}
    steps = {"info": {"sessionID": "s", "model": {"id": "Qwen"}, "tokens": {"prompt_tokens": 1000, "output": 100, "reasoning": 7}}, "messages": [{"info": {"role": "assistant"}, "parts": [{"type": "step-start"}, {"type": "text"}, {"type": "step-start"}]}]}
    text = json.dumps(mini)
    samples = {
        "p__q-1_a": {"report/eval_results.json": '{"p__q-1": false}', "preds.json": json.dumps({"model_patch": diff}), "p__q-1.traj.json": text, "x/a.traj.json": "{}", "patch.diff": diff},
        "p__q-1_b": {"report/eval_results.json": '{"p__q-1": false}', "preds.json": '[{"patch": "litellm.RateLimitError"}]', "p__q-1.traj.json": text[:-30], "patch.diff": diff},
        "p__q-1_c": {"report/eval_results.json": '{"p__q-1": false}', "patch.diff": diff, "ses.traj.json": json.dumps(steps)},
        "p__q-1_d": {"report/run.json": '{"resolved_instances": 0, "empty_patch_instances": 1}', "report/report.json": '{"resolved_instances": 1}'},
        "p__q-1_e": {"report/report.json": '{"resolved_instances": 1}', "other.json": '{"resolved_instances": 1}', "spt_log.json": '[{"transformation": "x"}, {"keywords": ["k"]}]'},
        "p__q-1_f": {"report/eval_results.json": "broken", "report/run.json": '{"resolved_instances": 2}'},
        "p__q-1_g": {"eval_results.json": '{"p__q-1": true}', "patch.diff": diff},
    }
    for sample, files in samples.items():
        for name, content in files.items():
            at = tmp_path / "w" / sample / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(content)
    got = {r.sample_id: r for r in archives.records(archives.assembled(archives.load(spark, str(tmp_path / "w"))), "mutant").collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "unresolved", "b": "error", "c": "empty", "d": "empty", "e": "unknown", "f": "resolved", "g": "unknown"}
    a, b, c, e = (got[k] for k in "abce")
    assert (a.steps, a.cost, a.exit_status, a.files_touched, a.patch_files_touched) == (2, 0.5, "unknown", 3, 1)  # a path within a path counts too
    assert (b.steps, b.exit_status, b.files_touched) == (1, "truncated", 1)
    assert (c.steps, c.exit_status, c.reasoning_tokens, c.output_tokens) == (2, "ok", 7, 100) and abs(c.cost - (1000 * 0.285 + 100 * 2.4) / 1e6) < 1e-12
    assert (e.spt, e.spt_types, e.spt_entry_count, e.steps, e.exit_status) == ({"x": 1}, "x", 2, 0, "unknown")
    assert {r.source_dir for r in got.values()} == set(samples) and {r.run_type for r in got.values()} == {"mutant"}
    o = {r["sample"][-1]: r.outcome for r in archives.outcomes(archives.load(spark, str(tmp_path / "w"))).collect()}
    assert o == {"a": "unresolved", "b": "unresolved", "c": "unresolved", "d": "empty", "e": "error", "f": "unresolved", "g": "error"}
    assert one(spark, archives.group_key(F.col("c"), F.lit("a__b_1_a__b_1")), c='{"k": true}') == "k" and one(spark, archives.group_key(F.lit(None).cast("string"), F.col("c")), c="a__b_1_a__b_1") == "a__b_1"
    for log, want in (("[]", (True, 0, None)), ("[1]", (True, 1, True)), (None, (False, None, None)), ("x", (False, None, None))):
        assert tuple(one(spark, archives.spt_metadata(F.col("c").cast("string")), c=log)) == want, log


def test_loading_of_datasets(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"instance_id": "a", "patch": "p"}\n{"instance_id": "b", "patch": "q"}\n')
    (tmp_path / "d.json").write_text('[{"instance_id": "a", "patch": "p"}]')
    (tmp_path / "f.csv").write_text('instance_id,x\na,\nb,"1\n2"\n')
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    d = archives.dataset(spark, str(tmp_path / "d.jsonl"))
    assert archives.dataset(spark, str(tmp_path / "d.jsonl"), ids("b")).first().patch == "q" and archives.dataset(spark, str(tmp_path / "d.json")).count() == 1
    with pytest.raises(ValueError, match="not in the dataset: z"):
        archives.dataset(spark, str(tmp_path / "d.jsonl"), ids("a", "z"))
    assert sorted(map(tuple, archives.frame(spark, str(tmp_path / "f.csv")).collect())) == [("a", ""), ("b", "1\n2")]
    assert sorted(r.model_patch for r in archives.predictions(spark, "gold", d).collect()) == ["p", "q"]
    assert tuple(archives.reshaped(archives.predictions(spark, "gold", d), "x").orderBy("instance_id").first()) == ("a", "p", "x")
    (tmp_path / "p.json").write_text('[{"patch": "e"}]')
    with pytest.raises(Exception, match="no instance_id"):
        archives.predictions(spark, str(tmp_path / "p.json")).collect()
    assert [r.instance_id for r in archives.without(d, ids("a").withColumnRenamed("id", "instance_id"), "instance_id").collect()] == ["b"]


def test_files_of_projects(spark):
    paths = ["a.py", "src/b.py", "src/gen/c.py", "tests/test_d.py", "setup.py", "e.txt", "src/x_pb2.py"]
    f = spark.createDataFrame([(p,) for p in paths], "path string")
    kept, n = archives.python_files(f, ("gen",), ("setup.py",), ("*_pb2.py",))
    assert sorted(r.path for r in kept.collect()) == ["a.py", "src/b.py", "tests/test_d.py"] and tuple(n.first()) == (6, 1, 1, 1, 3)
    assert archives.python_files(f)[0].count() == 6 and sorted(r.path for r in archives.code_files(kept).collect()) == ["a.py", "src/b.py"]
    g = spark.createDataFrame([("s", "b.pred", '{"model_patch": "p"}'), ("s", "c.json", "{}"), ("t", "x.patch", "raw"), ("u", "n.txt", "no")], "sample string, path string, content string")
    assert {(r["sample"], r.patch) for r in archives.gathered_patches(g).collect()} == {("s", "p"), ("t", "raw")}


def test_options():
    from runloom.options import COMPARISON, with_defaults

    got = with_defaults({"report": {"draws": 5}}, COMPARISON)
    assert got["report"] == {"min_baseline": 1, "draws": 5, "seed": 0} and got["sampling"] == COMPARISON["sampling"] and with_defaults(None, COMPARISON) == COMPARISON
    for bad, error in (({"none": 1}, KeyError), ({"report": {"x": 1}}, KeyError), ({"report": {"draws": "many"}}, TypeError)):
        with pytest.raises(error):
            with_defaults(bad, COMPARISON)


def test_results_stay_with_their_root(spark):
    c = spark.createDataFrame([("ra", "p__q-1", "ra/x.traj.json"), ("rb", "p__q-2", "rb/x.traj.json"), ("rc", "z", "rc/x")], "root string, case_id string, path string")
    r = spark.createDataFrame([("rb", "p__q-2", "rb/result.json", True, True, True), ("rc", "m", "rc/1.json", True, False, False), ("rc", "n", "rc/2.json", True, False, False)], "root string, record_id string, path string, resolved boolean, has_tests boolean, has_patch boolean")
    got = {x.case_id: (x.status, x.score) for x in archives.match_results(c, r).collect()}
    assert got["p__q-1"][0] == "missing" and got["p__q-2"] == ("matched", 147) and got["z"][0] == "ambiguous"


def test_validation(spark):
    n = spark.createDataFrame([("a", "1", "Fix", 0.5, [0, 1]), ("a", "2", "Fix", 0.5, [2]), ("b", "1", "No", 1.5, [1, 2]), ("b", "1", "Fix", 0.1, [0, 2])], "case_id string, id string, phase string, confidence double, event_idx array<int>")
    ev = spark.createDataFrame([(c, i) for c in "ab" for i in range(4)], "case_id string, event_idx int")
    un = spark.createDataFrame([("a", 3)], "case_id string, event_idx int")
    got = {r.case_id: r.violations for r in validate.graph(n, ev, un, ["Fix"]).collect()}
    assert got == {"a": [], "b": ["phases", "ids", "confidence", "order", "accounting"]}
    c = spark.createDataFrame([(True, False, 1, "Error", "d"), (False, False, 1, "error", None), (None, None, None, None, None), (True, None, 0, "error_free", "d")], "resolved boolean, patch_applied boolean, n_failures int, exit_status string, submission string")
    assert [(r.outcome, len(r.contradictions)) for r in checks.reconciled(c).collect()] == [("resolved", 3), ("unresolved", 0), ("unknown", 0), ("resolved", 0)]


def test_events_of_no_node_are_told(spark):
    n = spark.createDataFrame([("a", "1", "Fix", 0.5, [0])], "case_id string, id string, phase string, confidence double, event_idx array<int>")
    ev = spark.createDataFrame([("a", 0), ("a", 1)], "case_id string, event_idx int")
    assert validate.graph(n, ev, ev.limit(0), ["Fix"]).first().violations == ["accounting"]


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    from runloom import session

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:1", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(far)
    assert session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "s3://b/c"), sparkContext=None)) == "s3://b/c"


def test_bm25_with_common_terms_is_that_of_all_scores(spark):
    import math
    import random

    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["the", "of", "and", *(f"w{j}" for j in range(30))] if rng.random() < 0.6 else ["the", "of"]) for _ in range(rng.randint(1, 25)))) for i in range(300)] + [(900, None), (901, "")]
    queries = [(1, "the w1 w2 w3"), (2, "the of and"), (3, "w5"), (4, "nowhere"), (5, "the of w7 w7")]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "q long, qt string")
    toks = {i: (t or "").split() for i, t in docs}
    avg = sum(map(len, toks.values())) / len(toks)
    want = {}
    for i, t in queries:
        s = {}
        for term in set(t.split()):
            df = sum(term in x for x in toks.values())
            for k, x in toks.items():
                if term in x:
                    tf = x.count(term)
                    s[k] = s.get(k, 0) + math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * len(x) / avg))
        want |= {(i, r + 1): (k, round(v, 9)) for r, (k, v) in enumerate(sorted(s.items(), key=lambda y: (-round(y[1], 9), y[0]))[:5])}
    for often in (0.05, 0.3, 2.0):
        got = {(r.q, r["rank"]): (r.id, r.score) for r in retrieval.bm25(d, q, key="id", text="text", query="q", query_text="qt", k=5, often=often).collect()}
        assert set(got) == set(want) and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-9 for x in got)


def test_closure_of_cycles_and_recall(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    got = {tuple(r) for r in retrieval.closure(e).collect()}
    assert got == {(x, y) for x in "abcd" for y in "abc"}
    gold = spark.createDataFrame([("q", 1), ("q", 2), ("r", 1)], "q string, d int")
    hits = spark.createDataFrame([("q", 1), ("q", 9)], "q string, d int")
    x = retrieval.recall(gold, hits, "q", "d").first()
    assert (x.n, x.recall_avg, x.recall_all, x.recall_any) == (2, 0.25, 0.0, 0.5)


def test_streaming_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, "ok" if i % 3 else "bad") for i in range(50)], "id int, status string")
    src = str(tmp_path / "in")
    df.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = S.live_outcomes(stream).writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, S.live_outcomes(df).collect()))
    target = str(tmp_path / "out")
    for k in range(2):  # a second run adds nothing
        q = stream.writeStream.foreachBatch(lambda b, _: S.append_missing(b, target, "id")).option("checkpointLocation", str(tmp_path / f"c2{k}")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(7))


def test_samples_are_flushed_as_they_end(spark, tmp_path):
    schema = "sample string, member string, content string, ts timestamp"
    batches = [[("a", "x", "11", 100), ("b", "x", "1", 100)], [("a", "end", "111", 101), ("c", "end", "", 101)], [("d", "x", "1", 3700)], [("e", "x", "1", 7300)]]
    src = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "sample string, member string, content string, s long").select("sample", "member", "content", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    target = str(tmp_path / "out")
    q = S.flush_samples(stream, "ts", "end").writeStream.outputMode("append").foreachBatch(lambda b, i: S.append_batch(b, i, target)).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["sample"]: (r.n, r.bytes, r.complete) for r in spark.read.parquet(target).collect()}
    assert got["a"] == (2, 5, True) and got["c"] == (1, 0, True) and got["b"] == (1, 1, False)
    S.append_batch(spark.read.parquet(target + "/batch=1"), 99, target)
    n = spark.read.parquet(target).count()
    S.append_batch(spark.read.parquet(target + "/batch=1"), 99, target)
    assert spark.read.parquet(target).count() == n


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x", "f"), ("a", 2, "y", "g")], "sample string, at int, transformation string, file string")
    assert json.loads(sinks.spt_log(df, "sample", "at").first().spt_log)[1] == {"order": 2, "transformation": "y", "file": "g"}
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 2
    sinks.write_cases(df, str(tmp_path / "cases"), "at", ["transformation"])
    assert spark.read.csv(str(tmp_path / "cases/index"), header=True).count() == 2 and spark.read.json(str(tmp_path / "cases/cases/_key=1")).first().transformation == "x"
    up = archives.upsert(df.select("sample", "at"), spark.createDataFrame([("a", 9), ("b", 1)], "sample string, at int"), "sample")
    assert sorted(map(tuple, up.collect())) == [("a", 9), ("b", 1)]
    (tmp_path / "p.json").write_text('{"i": {"instance_id": "i", "model_patch": "d"}}')
    (tmp_path / "l.json").write_text('[{"instance_id": "j", "patch": "e"}]')
    (tmp_path / "ids.txt").write_text("a\n\n# no\n b \n")
    got = {tuple(r) for f in ("p.json", "l.json") for r in archives.predictions(spark, str(tmp_path / f)).select("instance_id", "model_patch").collect()}
    assert got == {("i", "d"), ("j", "e")} and sorted(r.id for r in archives.ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]


def test_recall_gold_holds_whole_items(spark, tmp_path):
    from runloom.plans import text as plans

    item = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, item), (2, "x" * 40), (3, "a\nlonger second line of an item that goes on")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, f"pre{item}post"), (2, item[:35]), (3, "y" + "x" * 41), (4, "in a\nlonger second line of an item that goes on"), (5, "none")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, plans._gold(spark, str(tmp_path)).collect())) == [(1, 1), (2, 3), (3, 4)]


def test_keyword_grep_of_all_turns(spark, tmp_path):
    from runloom.plans import text as plans

    turns = [(1, 0, "system", "the bug"), (1, 1, "user", "Fix the bug, nowhere to"), (1, 2, "assistant", "a BUG"), (1, 3, "user", "fix this bug"), (2, 0, "user", "lonely")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, plans.QUERIES["q_text_keyword_grep"](spark, str(tmp_path)).collect()))
    assert got == [(1, "bug", 2, 2), (1, "fix", 1, 3), (1, "nowhere", 0, None), (1, "the", 0, None), (2, "lonely", 0, None)]


def test_trajectories_are_parsed_once_and_files_shuffled_once(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    t = spark.createDataFrame([("a", '{"messages": [{"role": "user", "content": "x", "timestamp": 1}, {"role": "assistant", "content": "y", "timestamp": 3}]}')], "case_id string, trajectory string")
    e = trajectories.events(trajectories.parsed(t))
    assert "Exchange" not in plan(e) and "Window" not in plan(e) and "Union" not in plan(e)
    assert [(r["id"], r["event_idx"], r["duration_seconds"]) for r in e.collect()] == [("E0", 0, 2.0), ("E1", 1, None)]
    f = spark.createDataFrame([("o__c-1_2", "b/x.traj.json", "x.traj.json", "2"), ("o__c-1_2", "a/x.traj.json", "x.traj.json", "1"), ("o__c-1_2", "z/o__c-1.traj.json", "o__c-1.traj.json", "3")], "sample string, path string, member string, content string")
    a = archives.assembled(f)
    assert "Window" not in plan(a) and plan(a).count("Exchange hash") == 1
    assert tuple(a.select("instance_id", "sample_id", "trajectory", "preds", "has_report").first()) == ("o__c-1", "2", "3", None, False)
