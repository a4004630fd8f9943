"""Queries over texts, diffs, retrieval and sampling, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runloom.functions import charset
from runloom.functions import text as X
from runloom.operators import datasets, index, retrieval
from runloom.operators.runs import hashed
from runloom.plans.tables import table
from runloom.session import gone_at_exit, scratch


def _criteria(s, d):
    """Criteria of statements over pages, each followed by what some of them lack: a commit, a picture, a reference."""
    k = F.col("page_id")
    more = F.concat(F.when(k % 3 == 0, F.concat(F.lit(" "), F.sha1(k.cast("string").cast("binary")))).otherwise(""), F.when(k % 4 == 0, " see shot.PNG").otherwise(""), F.when(k % 5 == 0, " fixes #12").otherwise(""))
    p = table(s, d, "pages").select("page_id", "url", F.concat(F.regexp_replace(F.coalesce("html", F.lit("")), "[0-9#./]", " "), more).alias("t"))
    t = F.col("t")
    return p.select("page_id", X.n_words(t).alias("n_words"), X.has_link(F.col("url")).alias("link"), X.has_image(t).alias("image"), X.has_commit_hash(t).alias("commit_hash"), X.has_issue_reference(t).alias("reference"))


def _patch():
    k = F.col("p_partkey").cast("string")
    return F.concat(F.lit("diff --git a/src/f"), k, F.lit(".py b/src/f"), k, F.lit(".py\n--- a/src/f"), k, F.lit(".py\n+++ b/src/f"), k, F.lit(".py\n@@ -1,2 +1,3 @@\n-"), F.col("p_name"), F.lit("\n+"), F.col("p_brand"), F.lit("\n+"), F.col("p_type"))


def _patch_filters(s, d):
    """Limits of patches with one to three hunks, of which every fifth creates its file; assertions on messages; errors of imports in logs."""
    k = F.col("p_partkey")
    hunks = F.array_join(F.array_repeat(F.lit("@@ -1 +1 @@\n-a\n+b"), (k % 3 + 1).cast("int")), "\n")
    patch = F.concat(F.when(k % 5 == 0, "diff --git a/f b/f\nnew file mode 100644\n--- /dev/null\n+++ b/f\n").otherwise("diff --git a/f b/f\n--- a/f\n+++ b/f\n"), hunks)
    test = F.element_at(F.array(F.lit("assert x"), F.lit("with pytest.raises(E, match='x')"), F.lit("with pytest.raises(E)"), F.lit("self.assertRaises(E)")), (k % 4 + 1).cast("int"))
    log = F.element_at(F.array(F.lit("import a"), F.lit("x\nImportError: y"), F.lit("cannot import: failed"), F.lit("import a\nerror"), F.lit("attribute"), F.lit("failed")), (k % 6 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", X.patch_limits(patch).alias("x"), X.asserts_on_message(test).alias("asserts"), X.has_attribute_or_import_error(log).alias("import_error")).select("p_partkey", "x.*", "asserts", "import_error")


def _diffs(s, d):
    return table(s, d, "part").select("p_partkey", _patch().alias("patch")).select("p_partkey", X.diff_summary(F.col("patch")).alias("x"), X.patch_class(F.col("patch")).alias("class"), F.element_at(X.patch_files(F.col("patch")), 1).alias("file")).select("p_partkey", "x.*", "class", "file")


def _compaction(s, d):
    c = table(s, d, "conversations")
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    budget = F.greatest(F.lit(180), F.least(F.lit(850), F.floor(F.lit(2000) / n)))
    return c.select("conv_id", "turn", F.length(X.head_tail(F.col("text"), budget)).cast("long").alias("n_chars"), F.left(X.truncated(F.col("text"), 100), F.lit(80)).alias("head"))


def _grep(s, d):
    """Words of three letters or more of the first user turn, in every other turn but system ones; 0 where none has it."""
    c = table(s, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    first = c.where("role = 'user'").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    words = first.select("conv_id", F.col("turn").alias("_issue"), F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x) >= 3))).alias("keyword"))
    t = c.where("role IS NULL OR role != 'system'").select(F.col("conv_id").alias("_c"), "turn", F.lower("text").alias("_t"))
    j = words.join(t, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") != F.col("_issue")) & F.col("_t").contains(F.col("keyword")), "left")
    return j.groupBy("conv_id", "keyword").agg(F.count("turn").alias("n"), F.min("turn").alias("first_turn"))


def _packing(s, d):
    o = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("x"))
    return o.select("l_orderkey", F.array_join(X.greedy_packing(F.transform("x", lambda e: e["q"]), 60), ",").alias("taken"))


_PACK_SQL = """WITH RECURSIVE n AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS i FROM lineitem),
r AS (SELECT l_orderkey, i, CASE WHEN q <= 60 THEN q ELSE 0 END AS used, CASE WHEN q <= 60 THEN CAST(i AS VARCHAR) ELSE '' END AS taken FROM n WHERE i = 0
UNION ALL SELECT n.l_orderkey, n.i, r.used + CASE WHEN r.used + n.q <= 60 THEN n.q ELSE 0 END, CASE WHEN r.used + n.q <= 60 THEN r.taken || CASE WHEN r.taken = '' THEN '' ELSE ',' END || n.i ELSE r.taken END FROM r JOIN n ON n.l_orderkey = r.l_orderkey AND n.i = r.i + 1)
SELECT l_orderkey, arg_max(taken, i) AS taken FROM r GROUP BY 1"""
_BM = """WITH dt AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x != '') AS t FROM documents), nn AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt),
q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x != ''))) AS term FROM benchmark),
x AS (SELECT doc_id, len(t) AS size, unnest(t) AS term FROM dt), p AS (SELECT doc_id, size, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), s AS (SELECT p.term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * size / avgdl)) AS s FROM p JOIN f USING (term), nn),
g AS (SELECT item_id, doc_id, round(sum(s), 9) AS score FROM s JOIN q USING (term) GROUP BY 1, 2), h AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM g)"""


def _bm25(s, d):
    return retrieval.bm25(table(s, d, "documents"), table(s, d, "benchmark"), key="doc_id", text="text", query="item_id", query_text="text")


def _indexed(s, d):
    """The same by an index that is kept: documents come into it in two generations."""
    at, docs = scratch(s, "index"), table(s, d, "documents")
    for half in (0, 1):
        index.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half), at, key="doc_id", text="text", buckets=16)
    found = index.search(s, gone_at_exit(s, at), table(s, d, "benchmark"), query="item_id", text="text")
    return found.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "score", "rank")


def _gold(s, d):
    """Documents that hold the whole text of an item."""
    item = table(s, d, "benchmark").select("item_id", F.col("text").alias("k"))
    return retrieval.holding(table(s, d, "documents").select("doc_id", "text"), item, "doc_id", "item_id")


def _prompts(s, d):
    """Prompts made from parts: a readme, a file, one that never ends, one around another; patches of up to three files."""
    k = F.col("p_partkey")
    block = lambda f, body: F.concat(F.lit("[start of "), f, F.lit("]\n"), body, F.lit("\n[end of "), f, F.lit("]\n"))
    of = lambda p, n: F.concat(F.lit(f"src/{p}"), n, F.lit(".py"))
    text = F.concat(F.lit("premise\n"), F.when(k % 2 == 0, block(F.lit("README.md"), F.lit("read"))).otherwise(""), F.when(k % 10 != 3, block(of("f", k), F.col("p_name"))).otherwise(""), F.when(k % 3 == 0, "[start of src/g.py]\nnever closed\n").otherwise(""), F.when(k % 10 != 3, block(of("h", k % 5), block(F.lit("src/inner.py"), F.lit("x")))).otherwise(""))
    side = lambda f: F.concat(F.lit("--- a/"), f, F.lit("\n+++ b/"), f, F.lit("\n@@ -1 +1 @@\n-a\n+b\n"))
    patch = F.concat(F.when(k % 4 != 0, side(of("f", k))).otherwise(""), F.when(k % 7 < 5, side(of("h", k % 7))).otherwise(""), F.when(k % 5 == 1, side(F.lit("src/inner.py"))).otherwise(""))
    rows = table(s, d, "part").select("p_partkey", text.alias("text"), patch.alias("patch"))
    return retrieval.prompt_recalls(rows, "p_partkey", "text", "patch")


def _encodings(s, d):
    """Documents as bytes in one of five encodings, or no text at all; only those that all of these can write."""
    own = table(s, d, "documents").where(F.col("text").rlike(r"^[\x{09}\x{0A}\x{0D}\x{20}-\x{7E}\x{A1}-\x{FF}]*$"))
    k = F.col("doc_id") % 6
    mark = F.encode("text", "UTF-16")
    raw = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.encode("text", "ISO-8859-1")).when(k == 2, mark).when(k == 3, F.encode("text", "UTF-16LE")).when(k == 4, F.encode("text", "UTF-16BE")).otherwise(F.unhex(F.concat(F.lit("00"), F.sha2("text", 256), F.lit("0102"))))
    return own.select("doc_id", charset.read_text(raw).alias("x")).select("doc_id", F.md5(F.col("x.text").cast("binary")).alias("text_md5"))


def _shards(s, d):
    """Contiguous shards of equal size within a language, and a seeded order."""
    doc = table(s, d, "documents")
    return doc.select("doc_id", "lang", F.ntile(4).over(Window.partitionBy("lang").orderBy("n_chars", "doc_id")).alias("shard"), (hashed(F.lit("split"), F.col("doc_id")) % 10 == 0).alias("validation"))


def _label_split(s, d):
    """Labelled against unlabelled documents by source."""
    doc, lab = table(s, d, "documents"), table(s, d, "labels").select("doc_id", "quality", "toxic")
    j = doc.join(lab, "doc_id", "left")
    return j.groupBy("source").agg(F.count("quality").alias("labelled"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("quality_rate"), F.count_if(F.col("toxic") == 1).alias("toxic"))


_WORDS = r"len(list_filter(string_split_regex(trim({c}), '\s+'), lambda x: x != ''))"
QUERIES = {
    "q_text_criteria": _criteria, "q_text_diff_summary": _diffs, "q_text_compaction": _compaction, "q_text_keyword_grep": _grep, "q_text_context_packing": _packing,
    "q_retrieval_prompts": _prompts, "q_text_encodings": _encodings,
    "q_retrieval_bm25": _bm25, "q_retrieval_index": _indexed, "q_retrieval_recall": lambda s, d: retrieval.recall(_gold(s, d), _bm25(s, d), "item_id", "doc_id"),
    "q_sampling_shards": _shards, "q_text_label_split": _label_split,
    "q_sets_common_users": lambda s, d: table(s, d, "events").select(F.col("user_id").alias("id")).intersect(table(s, d, "customer").select(F.col("c_custkey").alias("id"))),
    "q_sets_remaining": lambda s, d: datasets.remaining(table(s, d, "customer").select(F.col("c_custkey").alias("id")), table(s, d, "events").select(F.col("user_id").alias("id")), "id"),
    "q_cost_by_rate": lambda s, d: datasets.token_costs(table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("props")).cast("long").alias("n_in")), {"view": (285e-9, 2.4e-6), "click": (1e-6, 4e-6), "error": (0.0, 5e-6)}, "event_type", F.col("n_in"), F.col("n")).withColumn("cost", F.round("cost", 9)),
    "q_text_patch_filters": _patch_filters,
    "q_data_language": lambda s, d: table(s, d, "documents").select("doc_id", datasets.language_is(F.col("lang"), "en", {"de": "en"}).alias("same")),
    "q_data_take": lambda s, d: datasets.take(table(s, d, "documents").select("doc_id"), "doc_id", 50),
}
SQL = {
    "q_retrieval_prompts": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 3 THEN 0 ELSE 2 END AS n_retrieved, CASE WHEN p_partkey % 4 != 0 THEN 1 ELSE 0 END AS f, CASE WHEN p_partkey % 7 < 5 THEN 1 ELSE 0 END AS h, CASE WHEN p_partkey % 5 = 1 THEN 1 ELSE 0 END AS i FROM part)
SELECT k AS p_partkey, n_retrieved, f + h + i AS n_gold, CASE WHEN n_retrieved = 0 THEN 0 ELSE f + CASE WHEN h = 1 AND k % 7 = k % 5 THEN 1 ELSE 0 END END / CAST(f + h + i AS DOUBLE) AS recall FROM p WHERE f + h + i > 0""",
    "q_text_encodings": r"""SELECT doc_id, md5(CASE WHEN doc_id % 6 = 5 THEN '[BINARY DATA FILE]' ELSE text END) AS text_md5 FROM documents WHERE regexp_matches(text, '^[\x{09}\x{0A}\x{0D}\x{20}-\x{7E}\x{A1}-\x{FF}]*$')""",
    "q_text_criteria": r"""WITH p AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '[0-9#./]', ' ', 'g') || CASE WHEN page_id % 3 = 0 THEN ' ' || sha1(CAST(page_id AS VARCHAR)) ELSE '' END || CASE WHEN page_id % 4 = 0 THEN ' see shot.PNG' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN ' fixes #12' ELSE '' END AS t FROM pages)
SELECT page_id, len(list_filter(string_split_regex(trim(t), '\s+'), lambda x: x != '')) AS n_words, coalesce(regexp_matches(url, 'https?://(www\.)?\S+'), false) AS link, page_id % 4 = 0 AS image, page_id % 3 = 0 AS commit_hash, page_id % 5 = 0 AS reference FROM p""",
    "q_text_diff_summary": "SELECT p_partkey, 1 AS files, 2 AS lines_added, 1 AS lines_removed, 1 AS hunks, 'ok' AS class, 'src/f' || p_partkey || '.py' AS file FROM part",
    "q_text_compaction": """WITH c AS (SELECT *, greatest(180, least(850, 2000 // count(*) OVER (PARTITION BY conv_id))) AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN length(text) > b THEN b + 3 ELSE length(text) END AS n_chars, left(CASE WHEN length(text) > 100 THEN left(text, 82) || chr(10) || '...[truncated]' ELSE text END, 80) AS head FROM c""",
    "q_text_context_packing": _PACK_SQL,
    "q_retrieval_recall": _BM + """, z AS (SELECT item_id, doc_id, r.doc_id IS NOT NULL AS hit FROM (SELECT item_id, documents.doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) WHERE benchmark.text != '') g LEFT JOIN (SELECT * FROM h WHERE rank <= 20) r USING (item_id, doc_id)),
y AS (SELECT item_id, count(*) FILTER (hit) / CAST(count(*) AS DOUBLE) AS r FROM z GROUP BY 1)
SELECT count(*) AS n, avg(r) AS recall_avg, avg(CASE WHEN r = 1 THEN 1 ELSE 0 END) AS recall_all, avg(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS recall_any FROM y""",
    "q_retrieval_index": _BM + " SELECT * FROM h WHERE rank <= 20",
    "q_retrieval_bm25": _BM + " SELECT * FROM h WHERE rank <= 20",
    "q_sampling_shards": "SELECT doc_id, lang, ntile(4) OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS shard, CAST('0x' || substr(md5('split|' || doc_id), 1, 8) AS BIGINT) % 10 = 0 AS validation FROM documents",
    "q_text_label_split": "SELECT source, count(quality) AS labelled, count(*) FILTER (quality IS NULL) AS unlabelled, coalesce(avg(quality), 0.0) AS quality_rate, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "q_sets_common_users": "SELECT user_id AS id FROM events INTERSECT SELECT c_custkey FROM customer",
    "q_sets_remaining": "SELECT c_custkey AS id FROM customer ANTI JOIN events ON user_id = c_custkey",
    "q_cost_by_rate": "WITH g AS (SELECT event_type, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS n_in FROM events GROUP BY 1) SELECT *, round(CASE event_type WHEN 'view' THEN n_in * 285e-9 + n * 2.4e-6 WHEN 'click' THEN n_in * 1e-6 + n * 4e-6 WHEN 'error' THEN n * 5e-6 END, 9) AS cost FROM g",
    "q_text_patch_filters": """SELECT p_partkey, 1 - CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS files, p_partkey % 3 + 1 AS hunks, (p_partkey % 3 + 1) * 2 AS lines, p_partkey % 5 = 0 AS other_files, p_partkey % 4 IN (1, 3) AS asserts, p_partkey % 6 IN (1, 2) AS import_error FROM part""",
    "q_data_language": "SELECT doc_id, coalesce(lower(lang) IN ('en', 'de'), false) AS same FROM documents",
    "q_data_take": "SELECT doc_id FROM documents ORDER BY CAST('0x' || substr(md5('take|' || doc_id), 1, 8) AS BIGINT), doc_id LIMIT 50",
    "q_text_keyword_grep": r"""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n = 1),
w AS (SELECT conv_id, turn AS issue, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: length(x) >= 3))) AS keyword FROM f)
SELECT w.conv_id, keyword, count(c.turn) AS n, min(c.turn) AS first_turn FROM w LEFT JOIN conversations c ON c.conv_id = w.conv_id AND c.turn != issue AND coalesce(role, '') != 'system' AND contains(lower(text), keyword) GROUP BY 1, 2""",
}
