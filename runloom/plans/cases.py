"""Queries of case discovery, matching of quotes, replies of models, image names, shards and totals, over rows made from the driver's tables; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import recovery
from runloom.functions import text as X
from runloom.operators import checks, datasets
from runloom.plans.tables import table
from runloom.session import gone_at_exit, scratch
from runloom.sources import archives, cases, sinks


def _c(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _case_files(s, d):
    """Files of a case for each customer: a trajectory in a folder of its own, for some in one of two, results beside or above it, a log and a patch."""
    k = F.col("c_custkey")
    top = _c("n", F.col("c_nationkey"), "/c__", k)
    f = lambda keep, path, content: F.when(keep, F.struct(path.alias("path"), content.alias("content")))
    result = _c('{"c__', k, '": {"resolved": ', F.when(k % 2 == 0, "true").otherwise("false"), ', "tests_status": {"F2P": {"success": ["a"], "failure": []}}, "patch_successfully_applied": true}}')
    all_ = F.array(
        f(F.lit(True), _c(top, "/run/a.traj.json"), F.lit("{}")),
        f(k % 5 == 0, _c(top, "/more/b.traj.json"), F.lit("{}")),
        f(k % 3 == 0, _c(top, "/run/result.json"), result),
        f(k % 3 == 1, _c(top, "/result.json"), result),
        f(k % 4 == 0, _c(top, "/run/spt_log.json"), F.lit("[]")),
        f(F.lit(True), _c(top, "/notes.txt"), F.lit("x")),
    )
    return table(s, d, "customer").select(F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("f")).select("f.*")


def _roots(s, d):
    return cases.roots(_case_files(s, d))


def _case_results(s, d):
    found = _case_files(s, d)
    roots = cases.roots(found)
    r = cases.result_records(found, roots)
    logs = cases.artifact(found, roots, "spt_log.json").select("root", F.col("path").alias("log"))
    return r.join(logs, "root", "left").select("root", "path", "record_id", "n_records", "resolved", "has_tests", "has_patch", "patch_applied", "log")


def _located(s, d):
    """Where a piece of each turn stands in it, asked for in lower case."""
    c = table(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    q = c.withColumn("quote", F.lower(F.trim(F.substring("text", 5, 20))))
    return q.select("conv_id", "turn", recovery.locate_quote("quote", "text").alias("x")).select("conv_id", "turn", "x.start", "x.stop", "x.exact")


def _spans(s, d):
    """Of the spans of each order those that a greedy choice keeps."""
    a = F.col("l_partkey") % 60
    span = F.struct(a.cast("int").alias("start"), (a + F.col("l_quantity") % 13).cast("int").alias("stop"))
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(span).alias("spans"))
    kept = recovery.disjoint_spans("spans")
    return g.select("l_orderkey", F.array_join(F.transform(kept, lambda x: F.concat_ws("-", x["start"], x["stop"])), ",").alias("kept"))


def _replies(s, d):
    """What is read from messages and outputs: the one command, submissions, limits, keywords of a reply, text without escapes."""
    k = F.col("o_orderkey")
    block = lambda n: _c("```bash\nls ", n, "\n```\n")
    message = F.when(k % 3 == 0, block(k)).when(k % 3 == 1, _c(block(k), block(k + 1))).otherwise("no command")
    output = F.when(k % 4 == 0, _c("\n DONE \nrest ", k)).otherwise(_c("x\nDONE"))
    reply = F.when(k % 5 == 0, "no JSON").when(k % 5 == 1, _c('```json\n{"keywords": ["a", " b', k, ' ", "a", ""]}\n```')).otherwise(_c('Sure: {"keywords": ["w', k, '"], "x": {}} there'))
    words = X.keywords(reply)
    color = _c("\x1b[31mred\x1b[0m ", k, "\x1b[2K")
    url = F.when(k % 6 == 0, _c("see https://github.com/a/b", k % 10, "/issues/", k)).when(k % 6 == 1, _c("https://github.com/a/b/pull/", k, "#x")).otherwise("https://github.com/a/b")
    escaped = F.when(k % 2 == 0, _c('"line\\n', k, '\\"q\\""')).otherwise(_c("  line\\n", k, "\\tt "))
    u = X.issue_url(url)
    return table(s, d, "orders").select(
        "o_orderkey", X.one_action(message).alias("action"), X.is_submission(output, F.when(k % 8 == 0, 1).otherwise(0), ("DONE",)).alias("submitted"), X.over_limits((k % 100).cast("int"), F.col("o_totalprice"), F.lit(90), F.lit(300_000.0)).alias("over"),
        F.array_join(words["keywords"], "|").alias("keywords"), words["failed"].alias("failed"), X.without_ansi(color).alias("plain"), F.concat_ws("/", u["owner"], u["repo"], u["number"]).alias("issue"), recovery.unescaped(escaped).alias("unescaped"),
    )


def _names(s, d):
    """Names, paths and words brought to one form."""
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, _c("./a/src/f", k, ".py")).when(k % 3 == 1, _c("tests/t", k, ".py")).otherwise(_c("b/lib/testing_e2e", k, ".js"))
    word = F.element_at(F.array(*map(F.lit, ("Passed", " fail ", "1.0", "0", "maybe", "TRUE", "success"))), (k % 7 + 1).cast("int"))
    return table(s, d, "part").select(
        "p_partkey", X.image_name(_c("Org__repo-", k), "reg/x."). alias("image"), X.normalized_path(path).alias("path"), X.is_test_path(path).alias("test"), X.tri_state(word).alias("state"), X.identifier(_c(" Instance_A__b-", k, F.when(k % 2 == 0, "_miniswe-sample").otherwise(""))).alias("id"),
        X.event_ordinal(F.when(k % 4 == 0, F.lit("Ex")).otherwise(_c("E", k))).alias("ordinal"), X.shortened(F.col("p_name"), 12).alias("short"), X.shortened(F.col("p_name"), 12, True).alias("short_left"), F.array_join(X.issue_references(_c("Fixes #", k, " <!-- closes #1 --> and resolved  #", k + 1, " prefix #3")), ",").alias("refs"),
        F.array_join(X.packed_labels(F.array(k, k), F.array(k + 1)), ",").alias("labels"), X.issue_text(F.when(k % 2 == 0, _c("intro <issue>\n body ", k, " </issue> end")).otherwise(_c(" whole ", k, " "))).alias("issue"),
    )


def _shards(s, d):
    """Customers in two shards that overlap; a key's first shard by name counts."""
    c, at = table(s, d, "customer"), scratch(s, "shards")
    for name, rows in (("a", c.where("c_custkey % 3 != 0")), ("b", c.where("c_custkey % 3 != 1"))):
        rows.select("c_custkey", F.lit(name).alias("shard"), "c_name").write.json(f"{at}/{name}")
    return datasets.merged_shards(s, gone_at_exit(s, at), "c_custkey").select("c_custkey", "shard", "c_name")


def _frames(s, d):
    """A table as CSV with quotes and line breaks, read back as text."""
    c, at = table(s, d, "customer"), scratch(s, "frame")
    sinks.write_report(c.select("c_custkey", F.concat("c_name", F.lit(' said "x",\n'), "c_mktsegment").alias("note"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("half")), at)
    return archives.frame(s, gone_at_exit(s, at)).select(F.col("c_custkey").cast("long").alias("c_custkey"), "note", "half")


def _solutions(s, d):
    """Orders as results, customers as their solutions: totals, and failures with a solution."""
    r = table(s, d, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("key"), (F.col("o_orderstatus") == "F").alias("ok"))
    sol = table(s, d, "customer").where("c_custkey % 4 != 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("solution"))
    totals, failed = datasets.with_solutions(r, sol, "key", "ok")
    return failed.groupBy(F.col("solution").isNotNull().alias("solved")).agg(F.count(F.lit(1)).alias("n"), F.min("task").alias("first")).join(F.broadcast(totals))


def _evaluations(s, d):
    """Successes and failures by group of each order's tests, and all failures."""
    li = table(s, d, "lineitem")
    t = _c("t", F.col("l_partkey") % 9)
    of = lambda flag: F.to_json(F.struct(F.array_sort(F.collect_list(F.when(flag & (F.col("l_linestatus") == "F"), t))).alias("success"), F.array_sort(F.collect_list(F.when(flag & (F.col("l_linestatus") != "F"), t))).alias("failure")))
    g = li.groupBy("l_orderkey").agg(F.concat(F.lit('{"F2P": '), of(F.col("l_returnflag") == "N"), F.lit(', "P2P": '), of(F.col("l_returnflag") != "N"), F.lit("}")).alias("status"))
    n = g.withColumn("n", checks.evaluation_counts(F.col("status")))
    return n.select("l_orderkey", *[F.col("n")[x][y].cast("long").alias(f"{x.lower()}_{y}") for x in ("F2P", "P2P") for y in ("success", "failure")], checks.evaluation_failures(F.col("n")).cast("long").alias("failures"))


def _samples(s, d):
    """Patches with their samples, and those without; images that are missing; remaining ids are in another query."""
    p = table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("patch"))
    sm = table(s, d, "customer").where("c_custkey % 5 != 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("sample"))
    joined, none = datasets.with_samples(p, sm, "id")
    images = datasets.missing_images(p.select(_c("img-", F.col("id") % 50).alias("image")), sm.select(_c("img-", F.col("sample")).alias("image")), "image")
    rows = joined.groupBy(F.lit("joined").alias("kind"), F.col("sample").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(none.select(F.lit("no sample").alias("kind"), F.col("id").cast("string").alias("name"), F.lit(1).cast("long").alias("n"))).unionByName(images.select(F.lit("missing image").alias("kind"), F.col("image").alias("name"), F.lit(1).cast("long").alias("n")))


QUERIES = {
    "q_cases_roots": _roots, "q_cases_results": _case_results, "q_text_located": _located, "q_text_spans": _spans, "q_text_replies": _replies, "q_text_names": _names, "q_data_shards": _shards, "q_sinks_frame": _frames,
    "q_data_solutions": _solutions, "q_checks_evaluations": _evaluations, "q_data_samples": _samples,
}

_CASES = """WITH c AS (SELECT c_custkey AS k, 'n' || c_nationkey || '/c__' || c_custkey AS top FROM customer),
t AS (SELECT k, top, top || '/run/a.traj.json' AS path, CASE WHEN k % 5 = 0 THEN top || '/run' WHEN k % 3 = 0 THEN top || '/run' WHEN k % 3 = 1 THEN top ELSE NULL END AS root, CASE WHEN k % 5 = 0 THEN k % 3 = 0 ELSE k % 3 < 2 END AS has FROM c
UNION ALL SELECT k, top, top || '/more/b.traj.json', top || '/more', false FROM c WHERE k % 5 = 0),
n AS (SELECT split_part(top, '/', 1) AS nation, count(*) + count(*) FILTER (k % 5 = 0) AS n FROM c GROUP BY 1),
r AS (SELECT t.k, t.path, coalesce(t.root, CASE WHEN n.n = 1 THEN n.nation ELSE top END) AS root, has AS has_results FROM t JOIN n ON n.nation = split_part(top, '/', 1))"""
SQL = {
    "q_cases_roots": _CASES + " SELECT path, root, has_results FROM r",
    "q_cases_results": _CASES + """ SELECT root, CASE WHEN k % 3 = 0 THEN top || '/run/result.json' ELSE top || '/result.json' END AS path, 'c__' || k AS record_id, 1 AS n_records, k % 2 = 0 AS resolved, true AS has_tests, true AS has_patch, true AS patch_applied,
CASE WHEN k % 4 = 0 THEN top || '/run/spt_log.json' END AS log FROM r JOIN c USING (k) WHERE has_results""",
    "q_text_located": """WITH q AS (SELECT conv_id, turn, coalesce(text, '') AS t, lower(trim(substr(coalesce(text, ''), 5, 20))) AS q FROM conversations),
p AS (SELECT *, strpos(t, q) AS a, strpos(lower(t), q) AS b FROM q) SELECT conv_id, turn, CASE WHEN q = '' THEN NULL WHEN a > 0 THEN a - 1 WHEN b > 0 THEN b - 1 END AS start, CASE WHEN q = '' THEN NULL WHEN a > 0 THEN a - 1 + length(q) WHEN b > 0 THEN b - 1 + length(q) END AS stop, CASE WHEN q = '' THEN NULL WHEN a > 0 THEN true WHEN b > 0 THEN false END AS exact FROM p""",
    "q_text_spans": """WITH RECURSIVE s AS (SELECT l_orderkey AS k, CAST(l_partkey % 60 AS INT) AS a, CAST(l_partkey % 60 + CAST(l_quantity AS INT) % 13 AS INT) AS b FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a, b DESC) AS i FROM s WHERE a < b),
r AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, -1 AS e, '' AS kept FROM s UNION ALL SELECT n.k, n.i, CASE WHEN n.a >= r.e THEN n.b ELSE r.e END, CASE WHEN n.a >= r.e THEN r.kept || CASE WHEN r.kept = '' THEN '' ELSE ',' END || n.a || '-' || n.b ELSE r.kept END FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1)
SELECT k AS l_orderkey, arg_max(kept, i) AS kept FROM r GROUP BY 1""",
    "q_text_replies": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ls ' || o_orderkey END AS action, o_orderkey % 8 = 4 AS submitted, o_orderkey % 100 >= 90 OR o_totalprice >= 300000 AS over,
CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a|b' || o_orderkey ELSE 'w' || o_orderkey END AS keywords, o_orderkey % 5 = 0 AS failed, 'red ' || o_orderkey AS plain,
CASE o_orderkey % 6 WHEN 0 THEN 'a/b' || o_orderkey % 10 || '/' || o_orderkey WHEN 1 THEN 'a/b/' || o_orderkey ELSE '' END AS issue, CASE WHEN o_orderkey % 2 = 0 THEN 'line' || chr(10) || o_orderkey || '"q"' ELSE 'line' || chr(10) || o_orderkey || chr(9) || 't' END AS unescaped FROM orders""",
    "q_text_names": """SELECT p_partkey, 'reg/x.org_1776_repo-' || p_partkey || ':latest' AS image, CASE p_partkey % 3 WHEN 0 THEN 'src/f' || p_partkey || '.py' WHEN 1 THEN 'tests/t' || p_partkey || '.py' ELSE 'lib/testing_e2e' || p_partkey || '.js' END AS path, p_partkey % 3 != 0 AS test,
CASE p_partkey % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN NULL ELSE true END AS state, 'a__b-' || p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE p_partkey END AS ordinal,
CASE WHEN length(p_name) > 12 THEN left(p_name, 11) || '…' ELSE rpad(p_name, 12, ' ') END AS short, CASE WHEN length(p_name) > 12 THEN '…' || right(p_name, 11) ELSE rpad(p_name, 12, ' ') END AS short_left,
p_partkey || ',' || p_partkey + 1 AS refs, '-100,-100,' || p_partkey + 1 AS labels, CASE WHEN p_partkey % 2 = 0 THEN 'body ' || p_partkey ELSE 'whole ' || p_partkey END AS issue FROM part""",
    "q_data_shards": "SELECT c_custkey, CASE WHEN c_custkey % 3 != 0 THEN 'a' ELSE 'b' END AS shard, c_name FROM customer",
    "q_sinks_frame": """SELECT c_custkey, c_name || ' said "x",' || chr(10) || c_mktsegment AS note, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS half FROM customer""",
    "q_data_solutions": """SELECT c_custkey IS NOT NULL AS solved, count(*) AS n, min(o_orderkey) AS first, (SELECT count(*) FILTER (o_orderstatus = 'F') FROM orders) AS passed, (SELECT count(*) FILTER (o_orderstatus != 'F') FROM orders) AS failed
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 != 0 WHERE o_orderstatus != 'F' GROUP BY 1""",
    "q_checks_evaluations": """SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS f2p_success, count(*) FILTER (l_returnflag = 'N' AND l_linestatus != 'F') AS f2p_failure,
count(*) FILTER (l_returnflag != 'N' AND l_linestatus = 'F') AS p2p_success, count(*) FILTER (l_returnflag != 'N' AND l_linestatus != 'F') AS p2p_failure, count(*) FILTER (l_linestatus != 'F') AS failures FROM lineitem GROUP BY 1""",
    "q_data_samples": """SELECT 'joined' AS kind, CAST(c_nationkey AS VARCHAR) AS name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 5 != 0 GROUP BY 2
UNION ALL SELECT DISTINCT 'no sample', CAST(o_custkey AS VARCHAR), 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 != 0)
UNION ALL SELECT DISTINCT 'missing image', 'img-' || o_custkey % 50, 1 FROM orders WHERE o_custkey % 50 NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 5 != 0)""",
}
