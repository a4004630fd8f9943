"""Queries of the checks over trajectories made from events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import checks as C
from runloom.operators import patches as P
from runloom.plans.tables import table



def trajectories(s, d):
    """events as trajectories of their users: edits, test runs, what they print, reversions, reads, and talk, by a number in props."""
    e = table(s, d, "events").select(F.col("user_id").alias("case_id"), "ts", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    from pyspark.sql import Window

    e = e.withColumn("event_idx", F.row_number().over(Window.partitionBy("case_id").orderBy("ts", "event_id")) - 1)
    k = lambda n: (F.col("k") % n).cast("string")
    m = F.col("k") % 6
    run = lambda *parts: F.concat(F.lit("```bash\n"), *[p if not isinstance(p, str) else F.lit(p) for p in parts], F.lit("\n```"))
    text = (
        F.when(m == 0, run("sed -i 1d src/f", k(5), ".py"))
        .when(m == 1, run("pytest tests/t", k(3), ".py"))
        .when(m == 2, F.when(F.col("k") % 4 == 0, "it all passed").otherwise("AssertionError: no"))
        .when(m == 3, run("cd src && git checkout -- src/f", k(5), ".py"))
        .when(m == 4, run("cat src/g", k(7), ".py | head"))
        .otherwise(F.concat(F.lit("diff --git a/src/f"), k(5), F.lit(".py b/src/f"), k(5), F.lit(".py\n--- a/src/f"), k(5), F.lit(".py\n+++ b/src/f"), k(5), F.lit(".py\n@@ -1 +1,2 @@\n-x\n+y\n+z")))
    )
    return e.select("case_id", "event_idx", F.when(m.isin(2, 5), "user").otherwise("assistant").alias("role"), F.lit("message").alias("kind"), text.alias("content"), F.lit(None).cast("string").alias("tool_input"), F.lit(None).cast("string").alias("tool_status"))


_E = """WITH e AS (SELECT user_id AS case_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS event_idx, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
x AS (SELECT *, k % 6 AS m, lead(k) OVER (PARTITION BY case_id ORDER BY event_idx) AS nk FROM e),
acc AS (SELECT case_id, event_idx, 'src/f' || k % 5 || '.py' AS resource, 'edit' AS kind FROM x WHERE m IN (0, 5) UNION ALL SELECT case_id, event_idx, 'tests/t' || k % 3 || '.py', 'test' FROM x WHERE m = 1
  UNION ALL SELECT case_id, event_idx, 'src/f' || k % 5 || '.py', 'other' FROM x WHERE m = 3 UNION ALL SELECT case_id, event_idx, 'src/g' || k % 7 || '.py', 'read' FROM x WHERE m = 4),
t AS (SELECT case_id, event_idx, 'pytest tests/t' || k % 3 || '.py' AS command, CASE WHEN nk % 6 = 2 AND nk % 4 = 0 THEN 'passed' WHEN nk % 6 = 2 THEN 'failed' ELSE 'unknown' END AS outcome FROM x WHERE m = 1),
ed AS (SELECT case_id, event_idx FROM x WHERE m IN (0, 5)),
c AS (SELECT t.case_id, t.event_idx, (SELECT min(event_idx) FROM t n WHERE n.case_id = t.case_id AND n.event_idx > t.event_idx) AS nx FROM t WHERE outcome = 'failed'),
cy AS (SELECT c.case_id, c.event_idx, nx AS retest_event, (SELECT outcome FROM t WHERE t.case_id = c.case_id AND t.event_idx = nx) AS retest_outcome,
  (SELECT count(*) FROM ed WHERE ed.case_id = c.case_id AND ed.event_idx > c.event_idx AND (nx IS NULL OR ed.event_idx < nx)) AS n_edits FROM c)"""


def _accesses(s, d):
    e = trajectories(s, d)
    return C.accesses(e, C.commands(e))


def _tests(s, d):
    e = trajectories(s, d)
    return C.tests(e, C.commands(e)).drop("n")


def _iterations(s, d):
    e = trajectories(s, d)
    cmds = C.commands(e)
    return C.iterations(C.tests(e, cmds), C.accesses(e, cmds).where("kind = 'edit'")).drop("n")


def _spt(s, d):
    """Parts as mutated files of the users, against what these accessed."""
    e = trajectories(s, d)
    spt = table(s, d, "part").select((F.col("p_partkey") % 150 + 1).alias("case_id"), F.concat(F.lit("repo/src/f"), F.col("p_partkey") % 7, F.lit(".py")).alias("file"), F.col("p_brand").alias("transformation"))
    return C.transformed_files(spt, C.accesses(e, C.commands(e))).withColumn("kinds", F.array_join("kinds", ","))


def _cases(s, d):
    o = table(s, d, "orders")
    return C.reconciled(o.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("resolved"), (F.col("o_orderkey") % 5 != 0).alias("patch_applied"), (F.col("o_orderkey") % 3).alias("n_failures"), F.when(F.col("o_orderkey") % 7 == 0, "ERROR").otherwise("ok").alias("exit_status"), F.when(F.col("o_orderkey") % 2 == 0, "d").alias("submission"))).select("o_orderkey", "outcome", F.array_join("contradictions", ";").alias("contradictions"), "summary")


def _patches(s, d):
    """Patches whose hunks have as many lines as a part's numbers say."""
    p = F.col("p_partkey")
    lines = lambda mark, n, t: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(mark + t), i.cast("string"))), "\n")
    a, b = (p % 3 + 1).cast("int"), (p % 4 + 1).cast("int")
    hunk = lambda start: F.concat(F.lit("@@ -"), start.cast("string"), F.lit(",9 +"), start.cast("string"), F.lit(",9 @@ def f\n ctx\n ctx  \n"), lines("-", a, "old"), F.lit("\n"), lines("+", b, "new"), F.lit("\n after\n more\n"))
    head = F.concat(F.lit("diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n"))
    return table(s, d, "part").select("p_partkey", F.concat(head, hunk(F.lit(10)), hunk(F.lit(50) + p % 10)).alias("patch"))


QUERIES = {
    "q_checks_git": lambda s, d: C.git(C.commands(trajectories(s, d))),
    "q_checks_accesses": _accesses,
    "q_checks_patches": lambda s, d: C.patches(trajectories(s, d)).withColumn("files", F.array_join("files", ",")),
    "q_checks_repeatedly_edited": lambda s, d: C.repeatedly_edited(C.patches(trajectories(s, d))).withColumn("events", F.array_join("events", ",")),
    "q_checks_tests": _tests,
    "q_checks_iterations": _iterations,
    "q_checks_errors": lambda s, d: C.errors(trajectories(s, d)).drop("tool_status"),
    "q_checks_top_resources": lambda s, d: C.top_counts(_accesses(s, d), "case_id", "resource", "event_idx", 3),
    "q_checks_transformed_files": _spt,
    "q_checks_reconciled": _cases,
    "q_checks_composite": lambda s, d: C.composite(trajectories(s, d)),
    "q_patch_hunks": lambda s, d: P.hunks(_patches(s, d), "p_partkey", "patch").select("p_partkey", "hunk", "pre_start", "pre_len", "post_start", "post_len"),
    "q_patch_minimal": lambda s, d: P.minimal(_patches(s, d), "p_partkey", "patch"),
}
SQL = {
    "q_checks_git": _E + " SELECT case_id, event_idx, 'git checkout -- src/f' || k % 5 || '.py' AS command, 'checkout' AS subcommand, 'reversion' AS category, true AS is_reversion FROM x WHERE m = 3",
    "q_checks_accesses": _E + " SELECT * FROM acc",
    "q_checks_patches": _E + " SELECT case_id, event_idx, 'src/f' || k % 5 || '.py' AS files, 2 AS lines_added, 1 AS lines_removed FROM x WHERE m = 5",
    "q_checks_repeatedly_edited": _E + " SELECT case_id, 'src/f' || k % 5 || '.py' AS file, string_agg(event_idx, ',' ORDER BY event_idx) AS events FROM x WHERE m = 5 GROUP BY 1, 2 HAVING count(*) > 1",
    "q_checks_tests": _E + " SELECT * FROM t",
    "q_checks_iterations": _E + " SELECT * FROM cy",
    "q_checks_errors": _E + " SELECT case_id, event_idx, 'AssertionError:' AS matched, 'AssertionError: no' AS snippet FROM x WHERE m = 2 AND k % 4 != 0",
    "q_checks_top_resources": _E + ", g AS (SELECT case_id, resource, count(*) AS n, min(event_idx) AS o FROM acc GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, o, resource) AS rank FROM g) SELECT case_id, resource, n, rank FROM r WHERE rank <= 3",
    "q_checks_transformed_files": _E + """, mu AS (SELECT p_partkey % 150 + 1 AS case_id, 'src/f' || p_partkey % 7 || '.py' AS f, count(*) AS n_mutations FROM part GROUP BY 1, 2)
SELECT mu.case_id, 'repo/' || f AS file, n_mutations, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS kinds, min(event_idx) AS first_event FROM mu LEFT JOIN acc ON acc.case_id = mu.case_id AND resource = f GROUP BY 1, 2, 3""",
    "q_checks_reconciled": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'unresolved' END AS outcome,
  CASE WHEN o_orderstatus = 'F' THEN array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'patch not applied' END, CASE WHEN o_orderkey % 3 > 0 THEN 'failures remain' END, CASE WHEN o_orderkey % 7 = 0 THEN 'failed exit' END], lambda c: c IS NOT NULL), ';') ELSE '' END AS contradictions,
  CASE WHEN o_orderstatus = 'F' THEN 'resolved by the evaluator' WHEN o_orderkey % 2 = 0 THEN 'a patch was submitted and not resolved' ELSE 'no patch was submitted' END AS summary FROM orders""",
    "q_checks_composite": _E + """, g AS (SELECT case_id, resource, count(*) AS n, count(*) FILTER (kind = 'edit') AS ne FROM acc GROUP BY 1, 2), r AS (SELECT case_id, count(*) AS unique_resources, count(*) FILTER (n > 1) AS revisited_resources, count(*) FILTER (ne > 1) AS repeated_edits FROM g GROUP BY 1),
tt AS (SELECT case_id, count(*) AS test_runs, count(*) FILTER (outcome = 'failed') AS test_failures, count(*) - count(DISTINCT command) AS test_reruns FROM t GROUP BY 1), cc AS (SELECT case_id, count(*) AS test_edit_cycles, CAST(sum(n_edits) AS BIGINT) AS edits_between FROM cy GROUP BY 1),
ev AS (SELECT case_id, count(*) AS events, count(*) FILTER (m = 3) AS git_commands, count(*) FILTER (m = 3) AS reversions, count(*) FILTER (m = 5) AS patch_iterations, count(*) FILTER (m = 2 AND k % 4 != 0) AS errors FROM x GROUP BY 1)
SELECT ev.*, coalesce(unique_resources, 0) AS unique_resources, coalesce(revisited_resources, 0) AS revisited_resources, coalesce(repeated_edits, 0) AS repeated_edits, coalesce(test_runs, 0) AS test_runs, coalesce(test_failures, 0) AS test_failures, coalesce(test_reruns, 0) AS test_reruns,
  coalesce(test_edit_cycles, 0) AS test_edit_cycles, coalesce(edits_between, 0) AS edits_between, reversions + coalesce(test_edit_cycles, 0) + coalesce(repeated_edits, 0) AS backtracking FROM ev LEFT JOIN r USING (case_id) LEFT JOIN tt USING (case_id) LEFT JOIN cc USING (case_id)""",
    "q_patch_hunks": """WITH p AS (SELECT p_partkey, p_partkey % 3 + 1 AS a, p_partkey % 4 + 1 AS b FROM part)
SELECT p_partkey, h AS hunk, CASE h WHEN 0 THEN 12 ELSE 52 + p_partkey % 10 END AS pre_start, a + 1 AS pre_len, CASE h WHEN 0 THEN 12 ELSE 52 + p_partkey % 10 + b - a END AS post_start, b + 1 AS post_len FROM p, range(2) t(h)""",
    "q_patch_minimal": """WITH p AS (SELECT p_partkey, p_partkey % 3 + 1 AS a, p_partkey % 4 + 1 AS b, 52 + p_partkey % 10 AS s FROM part),
l AS (SELECT *, (SELECT string_agg('-old' || i, chr(10) ORDER BY i) FROM range(1, a + 1) t(i)) || chr(10) || (SELECT string_agg('+new' || i, chr(10) ORDER BY i) FROM range(1, b + 1) t(i)) || chr(10) || ' after' || chr(10) AS body FROM p)
SELECT p_partkey, '--- a/f.py' || chr(10) || '+++ b/f.py' || chr(10) || '@@ -12,' || a + 1 || ' +12,' || b + 1 || ' @@' || chr(10) || body || '@@ -' || s || ',' || a + 1 || ' +' || s + b - a || ',' || b + 1 || ' @@' || chr(10) || body AS patch FROM l""",
}
