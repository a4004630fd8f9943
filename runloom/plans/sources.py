"""Queries of run records, trajectories, result matching, validation and closures, over files and graphs made from the driver's tables; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import syntax
from runloom.operators import datasets, retrieval, validate
from runloom.plans.tables import spread, table
from runloom.session import gone_at_exit, scratch
from runloom.sources import archives, trajectories


def _k():
    return F.col("o_orderkey")


def _message(role, content, i):
    return F.concat(F.lit('{"role": "' + role + '", "timestamp": '), i, F.lit(', "content": "'), content, F.lit('"}'))


def _trajectory():
    """A user's message and one to three of an agent; every thirteenth is cut."""
    k = _k()
    own = F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda i: _message("assistant", F.concat(F.lit("```bash\\ncat src/f"), k % 5, F.lit(".py\\n```")), (i * 1.5).cast("string")))
    messages = F.array_join(F.concat(F.array(_message("user", F.lit("q"), F.lit("0.0"))), own), ", ")
    info = F.concat(F.lit('{"info": {"exit_status": "Submitted", "submission": "abc", "model_stats": {"api_calls": '), k % 7, F.lit(', "instance_cost": '), ((k % 100) / 4).cast("string"), F.lit('}}, "messages": ['), messages, F.lit("]}"))
    return F.when(k % 13 == 0, F.expr("x").substr(F.lit(1), F.length("x") - 10)).otherwise(F.col("x")), info


def files(s, d):
    """The files of a sample folder for each order: report, predictions, trajectory, log of transformations, patch."""
    k, (traj, info) = _k(), _trajectory()
    o = spread(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")).withColumn("x", info).withColumn("x", traj)
    patch = F.when(k % 7 == 0, "ThrottlingException").when(k % 4 == 0, " ").otherwise("diff")
    entries = F.array_join(F.concat(F.array_repeat(F.concat(F.lit('{"transformation": "t'), k % 2, F.lit('"}')), (k % 3).cast("int")), F.when(k % 6 == 0, F.array(F.lit('{"keywords": []}'))).otherwise(F.array().cast("array<string>"))), ", ")
    f = lambda keep, path, content: F.when(keep, F.struct(F.lit(path).alias("path"), content.alias("content")))
    all_ = F.array(
        f(k % 11 != 0, "report/eval_results.json", F.concat(F.lit('{"x": '), F.when(F.col("o_orderstatus") == "F", "true").otherwise("false"), F.lit("}"))),
        f(k % 5 != 0, "preds.json", F.concat(F.lit('{"model_patch": "'), patch, F.lit('"}'))),
        f(F.lit(True), "run/a.traj.json", F.col("x")),
        f(F.lit(True), "spt_log.json", F.concat(F.lit("["), entries, F.lit("]"))),
        f(k % 4 != 1, "report/report.json", F.concat(F.lit('{"x": {"patch_is_None": '), F.when(k % 5 == 0, "true").otherwise("false"), F.lit(', "patch_successfully_applied": '), F.when(k % 3 == 0, "false").otherwise("true"), F.lit(', "resolved": '), F.when(F.col("o_orderstatus") == "F", "true").otherwise("false"), F.lit("}}"))),
        f(k % 2 == 0, "patch.diff", F.lit("diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b")),
    )
    sample = F.concat(F.lit("o__c-"), "o_custkey", F.lit("_"), "o_orderkey")
    return o.select(sample.alias("sample"), F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("f")).select("sample", "f.path", F.substring_index("f.path", "/", -1).alias("member"), "f.content")


def _records(s, d):
    r = archives.records(archives.assembled(files(s, d)), "mutant")
    return r.select("instance_id", "sample_id", "status", "steps", "cost", "exit_status", "submission_length", "files_touched", "patch_files_touched", "spt_types", "spt_entry_count")


def _events(s, d):
    t = trajectories.parsed(archives.assembled(files(s, d)))
    return trajectories.events(t, "sample").select("sample", "id", "role", F.length("content").cast("long").alias("n_chars"), "timestamp", "duration_seconds")


def _match(s, d):
    """Customers as cases, their orders as result records of their own root."""
    c = table(s, d, "customer")
    root = lambda k: F.concat(F.lit("x/instance_c__r-"), k.cast("string"))
    cases = c.select(root(F.col("c_custkey")).alias("root"), F.concat(F.lit("C__r-"), "c_custkey").alias("case_id"))
    k = _k()
    r = table(s, d, "orders").select(root(F.col("o_custkey")).alias("root"), F.concat(F.lit("f"), k, F.lit(".json")).alias("path"), F.when(k % 3 == 0, F.concat(F.lit("c__r-"), "o_custkey")).otherwise(F.concat(F.lit("other-"), k)).alias("record_id"), F.lit(2).alias("n_records"), (F.col("o_orderstatus") == "F").alias("resolved"), (k % 2 == 0).alias("has_tests"), F.lit(True).alias("has_patch"))
    return archives.match_results(cases, r)


def _users(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("case_id")).groupBy("case_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


def _graph(s, d):
    """Two nodes for each user: the first ten events, and those from the tenth or, for every third user, from the eighth on; the last event is left to the unclassified ones but for every fourth user."""
    u = _users(s, d).where("n >= 12")
    c = F.col("case_id")
    a = u.select("case_id", F.lit("a").alias("id"), F.lit("Fix").alias("phase"), F.lit(0.5).alias("confidence"), F.sequence(F.lit(0), F.lit(9)).alias("event_idx"))
    b = u.select("case_id", F.when(c % 5 == 0, "a").otherwise("b").alias("id"), F.when(c % 7 == 0, "Lost").otherwise("Fix").alias("phase"), F.lit(0.9).alias("confidence"), F.sequence(F.when(c % 3 == 0, 8).otherwise(10), F.col("n") - 2).alias("event_idx"))
    e = u.select("case_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("event_idx"))
    rest = u.where("case_id % 4 != 0").select("case_id", (F.col("n") - 1).alias("event_idx"))
    return validate.graph(a.unionByName(b), e, rest, ["Fix"]).withColumn("violations", F.array_join("violations", ","))


def _evidence(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("case_id"), F.concat(F.lit("E"), "turn").alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    q = c.select("case_id", F.col("id").alias("event_id"), F.concat(F.substring("content", 3, 12), F.when(F.col("case_id") % 4 == 0, "zqz").otherwise("")).alias("quote"))
    return validate.evidence(q, c)


def _closure(s, d):
    """Each part leads to that of half its number, and the first to the sixth: chains that end in a cycle."""
    k = F.col("p_partkey")
    return retrieval.closure(table(s, d, "part").select(k.alias("src"), F.when(k == 1, 6).otherwise(F.floor(k / 2)).cast("long").alias("dst")))


def _python_files(s, d):
    """A Python file for each part, ten to a package: absolute and relative imports, one inside a function, symbols with docstrings; every eleventh is broken."""
    k = F.col("p_partkey")
    ten = lambda c: F.floor(c / 10).cast("string")
    half, near, far = F.floor(k / 2), k - k % 10 + (k + 3) % 10, F.floor(k / 20)
    lines = F.array(
        F.concat(F.lit('"""Part '), k, F.lit('."""')),
        F.concat(F.lit("import os, p"), ten(half), F.lit(".m"), half),
        F.when(k % 3 == 0, F.concat(F.lit("from .m"), near, F.lit(" import name"))).otherwise(""),
        F.when(k % 4 == 1, F.concat(F.lit("from ..p"), far, F.lit(" import (\n    x,\n    y,\n)"))).otherwise(""),
        F.concat(F.lit("LIMIT = "), k),
        F.concat(F.lit("class C"), k, F.lit(':\n    """A class."""\n    def run(self):\n        import p0.m1\n        def inner():\n            \'\'\'Inner.\'\'\'\n')),
        F.when(k % 11 == 0, "def broken(:").otherwise(""),
    )
    return spread(table(s, d, "part").select("p_partkey")).select("p_partkey", F.lit("r").alias("repo"), F.concat(F.lit("src/p"), ten(k), F.lit("/m"), k, F.lit(".py")).alias("path"), F.array_join(lines, "\n").alias("content"))


def _imports(s, d):
    return syntax.import_edges(_python_files(s, d)).select("src", "dst")


def _symbols(s, d):
    doc = lambda style: F.md5(datasets.document(F.col("path"), F.col("content"), style).cast("binary")).alias(style)
    return _python_files(s, d).select("path", doc("docstrings"), doc("symbols"))


def _archived(s, d):
    """Turns of conversations as files of samples, packed as zip, tar and tar.gz files, and read back in ranges: files, characters and a digest of each sample."""
    c = table(s, d, "conversations").select("conv_id", F.concat(F.lit("c__"), "conv_id").alias("sample"), F.concat(F.lit("run/turns/"), "turn", F.lit(".txt")).alias("path"), F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("content"))
    at = scratch(s, "archives")
    for i, kind in enumerate(("zip", "tar", "tar.gz")):
        archives.pack(c.where(F.col("conv_id") % 3 == i), at, kind)
    files = archives.archive(s, gone_at_exit(s, at), members=("*.txt",), partition_bytes=1 << 20)
    each = F.sort_array(F.collect_list(F.struct("path", "content")))
    out = files.groupBy("sample").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("content")).cast("long").alias("n_chars"), each.alias("x"))
    return out.select("sample", "n_files", "n_chars", F.md5(F.array_join(F.transform("x", lambda f: F.concat(f["path"], F.lit("="), f["content"])), "|").cast("binary")).alias("digest"))


def _sessions(s, d):
    """Sessions of the other dialect from orders: a question, and one to three turns with a step and a tool each; for some no cost is logged."""
    k = _k()
    turn = F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda i: F.concat(F.lit('{"info": {"role": "assistant", "time": {"created": '), (i * 2000 + 1_700_000_000_000).cast("string"), F.lit(', "completed": '), (i * 2000 + 1_700_000_003_000).cast("string"), F.lit('}}, "parts": [{"type": "step-start"}, {"type": "tool", "tool": "bash", "state": {"status": "completed", "input": {"command": "ls"}, "output": "out '), k, F.lit('"}}]}')))
    question = F.array(F.lit('{"info": {"role": "user", "time": {"created": 1700000000000}}, "parts": [{"type": "text", "text": "why?"}]}'))
    model = F.when(k % 2 == 0, "Qwen3-coder").otherwise("other")
    info = F.concat(F.lit('{"info": {"id": "ses_'), k, F.lit('", "cost": '), F.when(k % 4 < 2, "0").otherwise(((k % 50) / 8).cast("string")), F.lit(', "model": {"id": "'), model, F.lit('", "providerID": "lab"}, "tokens": {"input": '), k % 5000, F.lit(', "output": '), k % 700, F.lit(', "reasoning": '), k % 11, F.lit(', "cache": {"read": '), k % 13, F.lit(', "write": '), k % 17, F.lit('}}}, "messages": ['), F.array_join(F.concat(question, turn), ", "), F.lit("]}"))
    return trajectories.parsed(spread(table(s, d, "orders").select("o_orderkey")).select(F.concat(F.lit("s-"), k).alias("sample"), info.alias("trajectory")))


def _session_metrics(s, d):
    t = trajectories.model_metadata(trajectories.metrics(_sessions(s, d)))
    return t.select("sample", "dialect", "steps", F.round("cost", 9).alias("cost"), "exit_status", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", F.col("metadata.model").alias("model"), F.col("metadata.provider").alias("provider"), F.round("metadata.cost", 6).alias("logged"))


def _session_events(s, d):
    e = trajectories.events(_sessions(s, d), "sample")
    return e.select("sample", "id", "role", "kind", F.length("content").cast("long").alias("n_chars"), "tool_name", "tool_status", "tool_output", "timestamp", "duration_seconds", "duration_is_estimated")


QUERIES = {"q_sources_sessions": _session_metrics, "q_sources_session_events": _session_events, "q_sources_archive": _archived, "q_source_imports": _imports, "q_source_documents": _symbols, "q_sources_records": _records, "q_sources_outcomes": lambda s, d: archives.outcomes(files(s, d)), "q_sources_events": _events, "q_sources_match_results": _match, "q_validate_graph": _graph, "q_validate_evidence": _evidence, "q_retrieval_closure": _closure}
SQL = {
    "q_sources_sessions": """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 < 2 THEN 0 ELSE (o_orderkey % 50) / 8.0 END AS c FROM orders)
SELECT 's-' || k AS sample, 'opencode' AS dialect, k % 3 + 1 AS steps, round(CASE WHEN c = 0 AND k % 2 = 0 THEN ((k % 5000) * 0.285 + (k % 700) * 2.4) / 1e6 ELSE c END, 9) AS cost, 'ok' AS exit_status,
k % 5000 AS input_tokens, k % 700 AS output_tokens, k % 13 AS cache_read_tokens, k % 17 AS cache_write_tokens, k % 11 AS reasoning_tokens, CASE WHEN k % 2 = 0 THEN 'Qwen3-coder' ELSE 'other' END AS model, 'lab' AS provider, round(c, 6) AS logged FROM o""",
    "q_sources_session_events": """WITH o AS (SELECT o_orderkey AS k, i, p FROM orders, range(4) t(i), range(2) u(p) WHERE i <= o_orderkey % 3 + 1 AND (i > 0 OR p = 0))
SELECT 's-' || k AS sample, 'E' || CASE WHEN i = 0 THEN 0 ELSE 2 * i - 1 + p END AS id, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN i = 0 THEN 'text' WHEN p = 0 THEN 'step-start' ELSE 'tool' END AS kind,
CASE WHEN i = 0 THEN 4 WHEN p = 0 THEN 0 ELSE length('TOOL: bash' || chr(10) || 'INPUT:' || chr(10) || '{"command": "ls"}' || chr(10) || 'OUTPUT:' || chr(10) || 'out ' || k) END AS n_chars,
CASE WHEN i > 0 AND p = 1 THEN 'bash' END AS tool_name, CASE WHEN i > 0 AND p = 1 THEN 'completed' END AS tool_status, CASE WHEN i > 0 AND p = 1 THEN 'out ' || k END AS tool_output,
CAST(1700000000 + 2 * i AS DOUBLE) AS timestamp, CASE WHEN i > 0 THEN CAST(1.5 AS DOUBLE) END AS duration_seconds, i > 0 AS duration_is_estimated FROM o""",
    "q_sources_archive": """WITH c AS (SELECT 'c__' || conv_id AS sample, 'run/turns/' || turn || '.txt' AS path, coalesce(role, '') || chr(10) || coalesce(text, '') AS content FROM conversations)
SELECT sample, count(*) AS n_files, CAST(sum(length(content)) AS BIGINT) AS n_chars, md5(string_agg(path || '=' || content, '|' ORDER BY path, content)) AS digest FROM c GROUP BY 1""",
    "q_sources_records": """WITH o AS (SELECT o_orderkey AS k, *, CAST(o_orderkey % 3 + 1 - CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS turns, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS pf FROM orders)
SELECT 'o__c-' || o_custkey AS instance_id, CAST(k AS VARCHAR) AS sample_id,
  CASE WHEN k % 11 = 0 THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'resolved' WHEN k % 5 = 0 THEN 'empty' WHEN k % 7 = 0 THEN 'error' WHEN k % 4 = 0 THEN 'empty' ELSE 'unresolved' END AS status,
  CASE WHEN k % 7 > 0 THEN k % 7 ELSE turns END AS steps, (k % 100) / 4.0 AS cost, CASE WHEN k % 13 = 0 THEN 'truncated' ELSE 'Submitted' END AS exit_status, 3 AS submission_length,
  CASE WHEN k % 13 = 0 THEN pf ELSE 2 END AS files_touched, pf AS patch_files_touched, CASE WHEN k % 3 = 0 THEN '' ELSE 't' || k % 2 END AS spt_types, k % 3 + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS spt_entry_count FROM o""",
    "q_sources_outcomes": """SELECT 'o__c-' || o_custkey || '_' || o_orderkey AS sample, CASE WHEN o_orderkey % 11 != 0 THEN 'unresolved' WHEN o_orderkey % 4 = 1 THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'empty' WHEN o_orderkey % 3 = 0 THEN 'error' WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'unresolved' END AS outcome FROM orders""",
    "q_sources_events": """WITH o AS (SELECT o_orderkey AS k, 'o__c-' || o_custkey || '_' || o_orderkey AS sample, o_orderkey % 3 + 1 - CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS turns FROM orders), e AS (SELECT o.*, i FROM o, range(4) t(i) WHERE i <= turns)
SELECT sample, 'E' || i AS id, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN i = 0 THEN 1 ELSE length('```bash' || chr(10) || 'cat src/f0.py' || chr(10) || '```') END AS n_chars, CAST(i * 1.5 AS DOUBLE) AS timestamp, CASE WHEN i < turns THEN CAST(1.5 AS DOUBLE) END AS duration_seconds FROM e""",
    "q_sources_match_results": """WITH r AS (SELECT o_custkey AS c, 'f' || o_orderkey || '.json' AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'c__r-' || o_custkey ELSE 'other-' || o_orderkey END AS record_id, o_orderstatus = 'F' AS resolved,
  CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END + 10 + CASE WHEN o_orderkey % 2 = 0 THEN 30 ELSE 0 END + 5 AS score FROM orders),
n AS (SELECT *, row_number() OVER w AS i, lead(score) OVER w AS s2, lead(record_id) OVER w AS r2 FROM r WINDOW w AS (PARTITION BY c ORDER BY score DESC, path, record_id))
SELECT 'C__r-' || c_custkey AS case_id, CASE WHEN score IS NULL THEN 'missing' WHEN s2 = score AND r2 != record_id THEN 'ambiguous' ELSE 'matched' END AS status,
  CASE WHEN NOT coalesce(s2 = score AND r2 != record_id, false) THEN record_id END AS record_id, CASE WHEN NOT coalesce(s2 = score AND r2 != record_id, false) THEN resolved END AS resolved, CASE WHEN NOT coalesce(s2 = score AND r2 != record_id, false) THEN score END AS score
FROM customer LEFT JOIN n ON c = c_custkey AND i = 1""",
    "q_validate_graph": """WITH u AS (SELECT user_id AS c, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 12)
SELECT c AS case_id, array_to_string(list_filter([CASE WHEN c % 7 = 0 THEN 'phases' END, CASE WHEN c % 5 = 0 THEN 'ids' END, CASE WHEN c % 3 = 0 THEN 'order' END, CASE WHEN c % 3 = 0 OR c % 4 = 0 THEN 'accounting' END], lambda x: x IS NOT NULL), ',') AS violations FROM u""",
    "q_validate_evidence": "WITH c AS (SELECT conv_id AS case_id, 'E' || turn AS event_id, coalesce(text, '') AS t FROM conversations), q AS (SELECT *, substr(t, 3, 12) || CASE WHEN case_id % 4 = 0 THEN 'zqz' ELSE '' END AS quote FROM c) SELECT case_id, event_id, quote, contains(t, quote) AS found FROM q",
    "q_retrieval_closure": "WITH RECURSIVE e AS (SELECT p_partkey AS a, CASE WHEN p_partkey = 1 THEN 6 ELSE p_partkey // 2 END AS b FROM part), r AS (SELECT * FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT * FROM r",
    "q_source_imports": """WITH f AS (SELECT p_partkey AS k, 'src/p' || p_partkey // 10 || '/m' || p_partkey || '.py' AS path FROM part), s AS (SELECT * FROM f WHERE k % 11 != 0),
e AS (SELECT s.k, f.k AS t FROM s JOIN f ON f.k = s.k // 2 UNION SELECT s.k, f.k FROM s JOIN f ON s.k % 3 = 0 AND f.k = s.k - s.k % 10 + (s.k + 3) % 10 UNION SELECT s.k, f.k FROM s JOIN f ON s.k % 4 = 1 AND f.k // 10 = s.k // 20)
SELECT a.path AS src, b.path AS dst FROM e JOIN f a ON a.k = e.k JOIN f b ON b.k = t WHERE e.k != t""",
    "q_source_documents": """WITH f AS (SELECT p_partkey AS k, 'src/p' || p_partkey // 10 || '/m' || p_partkey AS p FROM part), x AS (SELECT *, p || '.py' AS path, 'src.p' || k // 10 || '.m' || k AS m, chr(10) AS n,
'\"\"\"Part ' || k || '.\"\"\"' || chr(10) || 'import os, p' || (k // 2) // 10 || '.m' || k // 2 || chr(10) || CASE WHEN k % 3 = 0 THEN 'from .m' || (k - k % 10 + (k + 3) % 10) || ' import name' ELSE '' END || chr(10) || CASE WHEN k % 4 = 1 THEN 'from ..p' || k // 20 || ' import (' || chr(10) || '    x,' || chr(10) || '    y,' || chr(10) || ')' ELSE '' END || chr(10) || 'LIMIT = ' || k || chr(10) || 'class C' || k || ':' || chr(10) || '    \"\"\"A class.\"\"\"' || chr(10) || '    def run(self):' || chr(10) || '        import p0.m1' || chr(10) || '        def inner():' || chr(10) || '            ''''''Inner.''''''' || chr(10) || chr(10) || CASE WHEN k % 11 = 0 THEN 'def broken(:' ELSE '' END AS c FROM f)
SELECT path, md5(path || n || CASE WHEN k % 11 = 0 THEN c ELSE 'Part ' || k || '.' || n || n || 'C' || k || n || 'A class.' || n || n || 'inner' || n || 'Inner.' END) AS docstrings,
md5(path || n || CASE WHEN k % 11 = 0 THEN c ELSE m || n || 'Part ' || k || '.' || n || n || m || '.LIMIT' || n || m || '.C' || k || n || 'A class.' || n || n || m || '.C' || k || '.run' || n || m || '.C' || k || '.run.inner' || n || 'Inner.' || n || n END) AS symbols FROM x""",
}
