"""Queries of dataset building and triage over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import datasets as D
from runloom.operators import mutants, validate
from runloom.operators import triage as T
from runloom.plans.tables import spread, table


def _hints(s, d):
    """Orders as pull requests, their lines as comments on two issues each; the first commit is 60 days after the order."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("pull"), F.date_add(F.col("o_orderdate").cast("date"), 60).alias("committed")).where("pull % 9 != 0")
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("pull"), (F.col("l_linenumber") % 2).alias("issue_at"), F.struct("l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("d")).alias("at"), F.col("l_shipdate").cast("date").alias("updated"), F.col("l_partkey").cast("string").alias("body"))
    return D.hints(li, o)


def _statements(s, d):
    links = table(s, d, "lineitem").select(F.col("l_orderkey").alias("pull"), F.struct("l_linenumber", "l_partkey").alias("at"), F.col("l_partkey").alias("issue"))
    issues = table(s, d, "part").where("p_partkey % 5 != 0").select(F.col("p_partkey").alias("issue"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("body"))
    return D.statements(links, issues)


def _gold(s, d):
    p = table(s, d, "part")
    files = lambda: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("src/f"), ((F.col("p_partkey") + i) % 5).cast("string"), F.when(i == 3, ".txt").otherwise(".py")))
    patch = F.array_join(F.transform(files(), lambda x: F.concat(F.lit("--- a/"), x, F.lit("\n+++ b/"), x, F.lit("\n@@ -1 +1 @@\n-a\n+b"))), "\n")
    repo = p.select("p_partkey", F.explode(F.array(F.lit("src/f0.py"), F.lit("src/f1.py"), F.lit("src/f2.py"))).alias("file"))
    return D.gold_files(p.select("p_partkey", patch.alias("patch")), repo, "p_partkey", "patch")


def _with_hits(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_totalprice", "o_orderkey")), asc=False).alias("hits"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return D.with_hits(c, o, "o_custkey", 2).select("o_custkey", F.array_join(F.transform("hits", lambda h: h["o_orderkey"].cast("string")), ",").alias("hits"))


def _to_run(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("o_orderpriority")).alias("patch"))
    return D.to_run(o.select("id"), o.where("id % 3 != 0").select("id", "patch"), o.where("o_orderstatus = 'F'"), "id")


def _funnel(s, d):
    from runloom.functions.text import has_link, n_words

    n = n_words(F.col("text"))
    return D.funnel(table(s, d, "documents"), {"long_enough": n >= 40, "short_enough": n <= 2000, "no_link": ~has_link(F.col("text"))})


def _cut(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("created_at"))
    return D.cut_pulls(o, "o_custkey", [F.desc("created_at"), F.desc("o_orderkey")], most=5, since="1995-01-01").select("o_custkey", "o_orderkey")


def _affordable(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return D.affordable(o, "o_custkey", ["o_orderkey"], F.col("cents"), F.col("cents"), 30_000_000, 80_000_000).select("o_custkey", "o_orderkey", "total_cost")


def _code(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey", F.concat(F.lit("f"), F.col("l_linenumber"), F.lit(".py")).alias("file")).agg(F.concat(F.min("l_returnflag"), F.lit("\n"), F.max("l_linestatus")).alias("text"))
    return D.code_text(li, "l_orderkey", "file", "text")


def _solved(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    hard = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "hard").when(F.col("o_orderpriority") == "3-MEDIUM", "medium")
    got = D.solved_by_difficulty(o.where("o_orderstatus = 'F'"), o.select("id", hard.alias("bucket")).where("bucket IS NOT NULL"), "id")
    return got.select("bucket", "n", F.element_at("ids", 1).alias("first_id"))


def _repos(s, d):
    c = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("repo"))
    train, held = D.split_by_repo(c, table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("repo")))
    return train.withColumn("side", F.lit("train")).unionByName(held.withColumn("side", F.lit("eval")))


def _splits(s, d):
    doc = table(s, d, "documents").select("doc_id", "lang", "n_chars")
    return D.random_split(D.even_parts(doc, "lang", ["n_chars", "doc_id"], 4), "doc_id", 0.1)


def _messages(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("case_id"), "turn", "role", F.col("text").alias("content"), (F.col("turn") == 0).alias("is_issue"))


def _shown(df):
    return df.select("case_id", "turn", *[F.coalesce(F.length(f"shown.{c}"), F.lit(0)).alias(n) for n, c in (("n_whole", "content"), ("n_start", "content_start"), ("n_end", "content_end"))], F.coalesce("shown.content_length", F.lit(0)).alias("n_length"))


_CUSTOMERS = r"Customer#0{5,6}\d*[13]"
#: What is wrong with a conversation's answer, by its id modulo their number; the last two find their quotes.
_WRONG = ("include", "priority_low", "score", "confidence", "tags", "rationale", "metadata_evidence", "trajectory_evidence", "event", "quote", "why", "", "")


def _triage_answers(s, d):
    """An answer for each conversation, with a quote of its last message's end, held against messages whose two ends are shown."""
    shown = T.prompt_events(_messages(s, d), 900).select("case_id", F.concat(F.lit("E"), "turn").alias("id"), "shown")
    last = _messages(s, d).groupBy("case_id").agg(F.max(F.struct("turn", F.coalesce("content", F.lit("")).alias("content"))).alias("x"))
    wrong = F.element_at(F.array(*map(F.lit, _WRONG)), (F.pmod("case_id", F.lit(len(_WRONG))) + 1).cast("int"))
    w = lambda n, bad, good: F.when(F.col("w") == n, F.lit(bad)).otherwise(F.lit(good))
    quote = F.when(F.col("w") == "quote", "zqz#").otherwise(F.right("x.content", F.lit(5)))
    item = F.to_json(F.struct(F.when(F.col("w") == "event", "E999").otherwise(F.concat(F.lit("E"), "x.turn")).alias("event_id"), quote.alias("quote"), w("why", " ", "so").alias("why")))
    fields = [
        F.concat(F.lit('"include": '), w("include", '"yes"', "true")), F.concat(F.lit('"priority": '), w("priority_low", '"low"', '"high"')), F.concat(F.lit('"score": '), w("score", "50.5", "50")), F.concat(F.lit('"confidence": '), w("confidence", '"0.5"', "0.5")),
        F.concat(F.lit('"tags": '), w("tags", '["a", " "]', "[]")), F.concat(F.lit('"rationale": '), w("rationale", '" "', '"since"')), F.concat(F.lit('"metadata_evidence": '), w("metadata_evidence", "[1]", '["x"]')), F.concat(F.lit('"trajectory_evidence": ['), F.when(F.col("w") == "trajectory_evidence", "").otherwise(item), F.lit("]")),
    ]
    answers = last.withColumn("w", wrong).select("case_id", F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")).alias("response"))
    out = validate.triage_answers(answers, shown)
    e = F.element_at("evidence", 1)
    return out.select("case_id", F.array_join("violations", ",").alias("violations"), F.size("evidence").alias("n_found"), F.when(F.size("evidence") > 0, e["part"]).alias("part"), F.when(F.size("evidence") > 0, e["start"].cast("long")).alias("start"))


_POOL = ["rename_variable", "swap_operands", "dead_string_assignment", "dead_method_injection", "unroll_loop", "string_literal_splitter"]


def _mutants(s, d):
    """Customers as mutants of their nation's repository, whose suppliers are its files; four of seven have keywords."""
    m = spread(table(s, d, "customer").select(F.col("c_custkey").alias("mutant_id"), F.col("c_nationkey").alias("instance_id")))
    k = F.col("c_custkey")
    words = F.array(*[F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(f"{p}{i}."), k % 13, F.lit("w")).alias("word"), F.lit(i).alias("i")) for i in range(7) for kind, p in (("string_literals", "s"), ("methods", "a.m"))])
    keywords = table(s, d, "customer").where("c_custkey % 7 < 4").select(k.alias("mutant_id"), F.explode(F.filter(words, lambda x: x["i"] < k % 9)).alias("x")).select("mutant_id", "x.kind", "x.word")
    files = table(s, d, "supplier").select(F.col("s_nationkey").alias("instance_id"), F.concat(F.lit("src/f"), "s_suppkey", F.lit(".py")).alias("path"), (F.col("s_suppkey") % 9 == 0).alias("required"))
    draws = mutants.targeted(mutants.drawn(m, _POOL), keywords).join(m, "mutant_id").withColumn("_p", F.round("p_file", 6))
    out = mutants.placed(draws, files, injected=3)
    return out.select("mutant_id", "nth", "name", "target", F.col("_p").alias("p_file"), "path", "required")


def _h(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


_MUTANTS_SQL = f"""WITH pool AS (SELECT unnest([{', '.join(f"'{n}'" for n in _POOL)}]) AS name),
dr AS (SELECT c_custkey AS m, c_nationkey AS g, name, row_number() OVER (PARTITION BY c_custkey ORDER BY {_h("'draw0'", "c_custkey", "name")}, name) AS nth, {_h("'p0'", "c_custkey", "name")} / 4294967296.0 AS p FROM customer, pool),
kw AS (SELECT c_custkey AS m, kind, CASE kind WHEN 'methods' THEN 'a.m' ELSE 's' END || i || '.' || c_custkey % 13 || 'w' AS word FROM customer, range(7) t(i), (VALUES ('string_literals'), ('methods')) AS kinds(kind) WHERE c_custkey % 7 < 4 AND i < c_custkey % 9),
ta AS (SELECT dr.*, word, row_number() OVER (PARTITION BY dr.m, nth ORDER BY {_h("'word0'", "dr.m", "name", "word")}, word) AS a FROM dr LEFT JOIN kw ON kw.m = dr.m AND kind = CASE name WHEN 'dead_string_assignment' THEN 'string_literals' WHEN 'dead_method_injection' THEN 'methods' END WHERE nth <= 3),
tt AS (SELECT m, g, name, nth, p, CASE WHEN name = 'dead_method_injection' THEN split_part(word, '.', -1) ELSE word END AS target FROM ta WHERE a <= 5),
f AS (SELECT s_nationkey AS g, 'src/f' || s_suppkey || '.py' AS path, s_suppkey % 9 = 0 AS required FROM supplier), n AS (SELECT g, count(*) FILTER (required) AS req FROM f GROUP BY 1),
u AS (SELECT tt.*, path, required, req, {_h("'file0'", "m", "name", "target", "path")} / 4294967296.0 AS u FROM tt JOIN f USING (g) JOIN n USING (g)),
k AS (SELECT *, row_number() OVER (PARTITION BY m, nth, name, target, required ORDER BY u, path) AS a FROM u WHERE required OR u <= p)
SELECT m AS mutant_id, CAST(nth AS INT) AS nth, name, target, round(p, 6) AS p_file, path, required FROM k WHERE required OR name NOT IN ('dead_string_assignment', 'dead_method_injection') OR a <= 3 - req"""


QUERIES = {
    "q_validate_triage": _triage_answers,
    "q_sampling_mutants": _mutants,
    "q_data_hints": _hints,
    "q_data_statements": _statements,
    "q_data_gold_files": _gold,
    "q_data_with_hits": _with_hits,
    "q_data_to_run": _to_run,
    "q_data_cut_pulls": _cut,
    "q_data_affordable": _affordable,
    "q_data_code_text": _code,
    "q_data_solved_by_difficulty": _solved,
    "q_data_split_by_repo": _repos,
    "q_data_splits": _splits,
    "q_text_funnel": _funnel,
    "q_data_by_length": lambda s, d: D.by_length(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), 100, 5000, 1, 3).select("doc_id", "length", "position"),
    "q_data_selected": lambda s, d: D.selected(table(s, d, "customer").select(F.col("c_name").alias("id")), "id", _CUSTOMERS, 3, 40, "x"),
    "q_data_chosen": lambda s, d: D.chosen(table(s, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 0, share=0.3),
    "q_data_by_version": lambda s, d: D.by_version(table(s, d, "part"), "p_size", "p_partkey").select("p_size", "n", F.array_join("ids", ",").alias("ids")),
    "q_data_differences": lambda s, d: D.differences(table(s, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("v")), table(s, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).otherwise("X").alias("v")), ["o_orderkey"], "v"),
    "q_data_status_totals": lambda s, d: D.status_totals(table(s, d, "orders"), "o_orderstatus", ["F", "O", "P"]),
    "q_data_costs_within": lambda s, d: D.costs_within(table(s, d, "orders").select(F.round(F.col("o_totalprice") * 100).cast("long").alias("c"), F.lit(1).alias("n")), "c", "n", 10, 0),
    "q_triage_compacted": lambda s, d: _shown(T.compacted(_messages(s, d), 2000)),
    "q_triage_prompt_events": lambda s, d: _shown(T.prompt_events(_messages(s, d), 900)),
    "q_triage_budget": lambda s, d: T.fitting_budget(_messages(s, d), _messages(s, d).groupBy("case_id").agg((F.max("turn") * 100 + 54_000).alias("n_fixed"))),
}
_M = "WITH m AS (SELECT conv_id AS case_id, turn, role, coalesce(length(text), 0) AS n FROM conversations), o AS (SELECT *, coalesce(role, '') != 'system' AND turn != 0 AS own FROM m), c AS (SELECT * FROM (SELECT *, bool_or(own) OVER (PARTITION BY case_id) AS has FROM o) WHERE own OR NOT has)"
_B = [28_000, 12_000, 9_000, 6_000, 4_500, 3_000, 2_000, 1_200]
SQL = {
    "q_sampling_mutants": _MUTANTS_SQL,
    "q_validate_triage": f"""WITH m AS (SELECT conv_id AS c, turn, coalesce(text, '') AS t, least(12000, 900 // count(*) OVER (PARTITION BY conv_id)) AS b FROM conversations),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn DESC, t DESC) AS n FROM m) WHERE n = 1),
x AS (SELECT c, t, right(t, 5) AS q, [{', '.join(f"'{w}'" for w in _WRONG)}][c % {len(_WRONG)} + 1] AS w, CASE WHEN length(t) > b THEN left(t, b // 2) END AS s, CASE WHEN length(t) > b THEN right(t, b - b // 2) END AS e FROM l),
p AS (SELECT *, CASE WHEN w IN ('trajectory_evidence', 'event', 'quote') OR q = '' THEN NULL WHEN s IS NULL THEN 'content' WHEN contains(s, q) THEN 'content_start' ELSE 'content_end' END AS part FROM x)
SELECT c AS case_id, CASE WHEN w = '' AND q = '' THEN 'quote' ELSE w END AS violations, CASE WHEN part IS NULL THEN 0 ELSE 1 END AS n_found, part,
  CASE part WHEN 'content' THEN strpos(t, q) - 1 WHEN 'content_start' THEN strpos(s, q) - 1 WHEN 'content_end' THEN length(t) - length(e) + strpos(e, q) - 1 END AS start FROM p""",
    "q_data_hints": """WITH c AS (SELECT l_orderkey AS pull, l_linenumber % 2 AS i, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS u, coalesce(CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) + 60 AND o_orderkey % 9 != 0, false) AS ok FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT *, min(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY pull, i ORDER BY l_linenumber, l_partkey, u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM c),
b AS (SELECT pull, i, coalesce(string_agg(CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber, l_partkey, u) FILTER (a = 1), '') AS t FROM r GROUP BY 1, 2)
SELECT pull, string_agg(t, chr(10) ORDER BY i) AS hints_text FROM b GROUP BY 1""",
    "q_data_statements": """SELECT l_orderkey AS pull, coalesce(string_agg(p_name || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END || chr(10), '' ORDER BY l_linenumber, l_partkey) FILTER (p_partkey IS NOT NULL), '') AS problem_statement
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 != 0) ON p_partkey = l_partkey GROUP BY 1""",
    "q_data_gold_files": "SELECT p_partkey, CAST(i AS INTEGER) AS at, 'src/f' || (p_partkey + i) % 5 || '.py' AS file FROM part, range(3) t(i) WHERE (p_partkey + i) % 5 < 3",
    "q_data_with_hits": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS n FROM orders) SELECT c_custkey AS o_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n), '') AS hits FROM customer LEFT JOIN r ON o_custkey = c_custkey AND n <= 2 GROUP BY 1",
    "q_data_to_run": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 != 0 AND o_orderkey % 7 != 0 AND o_orderstatus != 'F'",
    "q_data_cut_pulls": """WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS i, CAST(o_orderdate AS DATE) < DATE '1995-01-01' AS old FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC)),
q AS (SELECT *, max(CASE WHEN i >= 5 OR old THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM p) SELECT o_custkey, o_orderkey FROM q WHERE coalesce(s, 0) = 0""",
    "q_data_affordable": "WITH o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders), r AS (SELECT o_custkey, o_orderkey, CAST(sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS total_cost FROM o WHERE c <= 30000000) SELECT * FROM r WHERE total_cost <= 80000000",
    "q_data_code_text": """WITH f AS (SELECT l_orderkey, 'f' || l_linenumber || '.py' AS f, min(l_returnflag) AS a, max(l_linestatus) AS b FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg('[start of ' || f || ']' || chr(10) || '1 ' || a || chr(10) || '2 ' || b || chr(10) || '[end of ' || f || ']', chr(10) ORDER BY f) AS code FROM f GROUP BY 1""",
    "q_data_solved_by_difficulty": "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'hard' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'unknown' END AS bucket, count(*) AS n, min(o_orderkey) AS first_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "q_data_split_by_repo": "SELECT c_custkey, c_nationkey AS repo, CASE WHEN n_regionkey = 1 THEN 'eval' ELSE 'train' END AS side FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    "q_data_splits": "SELECT doc_id, lang, n_chars, ntile(4) OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS part, CAST('0x' || substr(md5('split|' || doc_id), 1, 8) AS BIGINT) % 1000000 < 100000 AS validation FROM documents",
    "q_text_funnel": "WITH t AS (SELECT len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x != '')) AS n, regexp_matches(text, 'https?://(www\\.)?\\S+') AS l FROM documents) SELECT count(*) AS total, count(*) FILTER (n >= 40) AS long_enough, count(*) FILTER (n BETWEEN 40 AND 2000) AS short_enough, count(*) FILTER (n BETWEEN 40 AND 2000 AND NOT l) AS no_link FROM t",
    "q_data_by_length": "WITH r AS (SELECT doc_id, n_chars AS length, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position, ntile(3) OVER (ORDER BY n_chars, doc_id) AS part FROM documents WHERE n_chars >= 100 AND n_chars < 5000) SELECT doc_id, length, position FROM r WHERE part = 2",
    "q_data_selected": f"WITH r AS (SELECT c_name AS id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('x|' || c_name), 1, 8) AS BIGINT), c_name) - 1 AS position FROM customer WHERE regexp_matches(c_name, '^{_CUSTOMERS}')) SELECT * FROM r WHERE position >= 3 AND position < 40",
    "q_data_chosen": "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CAST('0x' || substr(md5('choose|' || p_brand || '|' || p_partkey), 1, 8) AS BIGINT), p_partkey) AS pick, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey, pick FROM r WHERE pick <= ceil(n * CAST(0.3 AS DOUBLE))",
    "q_data_by_version": "SELECT p_size, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1",
    "q_data_differences": "WITH a AS (SELECT o_orderkey, o_orderstatus AS l FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE 'X' END AS r FROM orders WHERE o_orderkey % 3 = 0) SELECT o_orderkey, l AS \"left\", r AS \"right\" FROM a FULL JOIN b USING (o_orderkey) WHERE l IS DISTINCT FROM r",
    "q_data_status_totals": "SELECT count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) AS total FROM orders",
    "q_data_costs_within": "SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cost, count(*) AS calls, sum(CAST(round(o_totalprice * 100) AS BIGINT)) >= 10 AS exceeded FROM orders",
    "q_triage_compacted": _M + ", b AS (SELECT *, CAST(greatest(180, least(850, 2000 // count(*) OVER (PARTITION BY case_id))) AS BIGINT) AS b FROM c) SELECT case_id, turn, CASE WHEN n <= b THEN n ELSE 0 END AS n_whole, CASE WHEN n > b THEN CAST(floor(b * CAST(0.65 AS DOUBLE)) AS BIGINT) ELSE 0 END AS n_start, CASE WHEN n > b THEN b - CAST(floor(b * CAST(0.65 AS DOUBLE)) AS BIGINT) ELSE 0 END AS n_end, CASE WHEN n > b THEN n ELSE 0 END AS n_length FROM b",
    "q_triage_prompt_events": _M + ", b AS (SELECT *, least(12000, 900 // count(*) OVER (PARTITION BY case_id)) AS b FROM m) SELECT case_id, turn, CASE WHEN n <= b THEN n ELSE 0 END AS n_whole, CASE WHEN n > b THEN b // 2 ELSE 0 END AS n_start, CASE WHEN n > b THEN b - b // 2 ELSE 0 END AS n_end, CASE WHEN n > b OR b = 0 THEN n ELSE 0 END AS n_length FROM b",
    "q_triage_budget": _M + ", f AS (SELECT case_id, max(turn) * 100 + 54000 AS n_fixed FROM m GROUP BY 1), k AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS k FROM c), "
    + f"x AS (SELECT case_id, b, CAST(sum(least(n, greatest(180, least(850, b // k)))) AS BIGINT) AS t FROM k, (SELECT unnest({_B}) AS b) GROUP BY 1, 2), y AS (SELECT case_id, b, t + n_fixed AS t FROM x JOIN f USING (case_id)) "
    + "SELECT case_id, coalesce(max(b) FILTER (t <= 55000), 1200) AS budget, coalesce(arg_max(t, b) FILTER (t <= 55000), min(t)) AS n_chars FROM y GROUP BY 1",
}
