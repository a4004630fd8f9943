"""Lexical retrieval over a corpus, recall, and context under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Of BM25.
K1, B = 0.9, 0.4


def terms(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def postings(docs: DataFrame, keys: list[str], text: Column, seen: Observation | None = None) -> DataFrame:
    """The index: keys, size, term, tf. A text's terms are sorted and counted within its row, so nothing is shuffled. seen gets the number of documents, n, and the sum of their sizes, size, as the postings are made."""
    t = docs.select(*keys, F.sort_array(terms(text)).alias("_t")).select(*keys, F.size("_t").alias("size"), "_t")
    if seen is not None:
        t = t.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.col("size"), F.lit(0)).cast("long")).alias("size"))
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.col("size"), F.lit(1))), lambda i: ~F.get("_t", i).eqNullSafe(F.get("_t", i - 1)))
    # outer, as Spark would else ask first if there are any, and make the arrays once more for that
    t = t.withColumn("_ends", ends).select("*", F.posexplode_outer("_ends").alias("_j", "_e"))
    tf = F.col("_e") - F.coalesce(F.get("_ends", F.col("_j") - 1), F.lit(0))
    return t.select(*keys, "size", F.get("_t", F.col("_e") - 1).alias("term"), tf.alias("tf")).where("term IS NOT NULL")


def weight(tf: str, size: str, k1: float = K1, b: float = B) -> Column:
    """What a term adds to a score, from idf and avgdl."""
    return F.col("idf") * F.col(tf) / (F.col(tf) + k1 * (1 - b + b * F.col(size) / F.col("avgdl")))


def best(lists: DataFrame, of: DataFrame, on: list[str], k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The k best documents of each query: query, key, score, rank; ties by key. The result is that of scoring all.

    lists: on (term and what else names a list), key, size, tf. of, a written table: query, on,
    idf, avgdl, most (no document gets more from the term) and common. Terms that aren't
    common admit documents. The 5 * k best of each query by these are scored in full: their
    kth best score is a bound that the k best must reach. A document that has only such
    common terms as can't reach it together is never made; others drop out where their score
    and what the common terms may add don't reach it. What is left meets the common terms'
    postings by document, so no row is made for a document and a term that it lacks.
    """
    from runloom.session import broadcast_if_small, written

    def small(df: DataFrame, most: int = 16 << 20) -> DataFrame:
        return broadcast_if_small(written(df, "searched"), most)

    def scores(own: DataFrame) -> DataFrame:
        return lists.join(small(own), on).groupBy("query", "key").agg(F.sum(weight("tf", "size", k1, b)).alias("score"))

    def full(some: DataFrame, own: DataFrame) -> DataFrame:
        """some, a written table, with the scores by its queries' own terms added; lists meet it by document."""
        own = small(own.select("query", *on, "idf", "avgdl"))
        mine = lists.join(small(own.select(on).distinct()), on, "left_semi")
        more = mine.join(broadcast_if_small(some.select("query", "key"), 1 << 20), "key").join(own, ["query", *on])
        more = more.groupBy("query", "key").agg(F.sum(weight("tf", "size", k1, b)).alias("more"))
        return some.join(more, ["query", "key"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")

    top = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    common = of.where("common")
    rare = written(scores(of.where("NOT common")), "rare")
    leads = written(rare.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= 5 * k).drop("rank"), "leads")
    bound = full(leads, common).withColumn("rank", F.row_number().over(top)).where(F.col("rank") == k)
    bound = written(bound.select("query", (F.col("score") - 1e-8).alias("bound")), "bound")
    less = Window.partitionBy("query").orderBy("most", *on)
    common = written(common.join(bound, "query", "left").withColumn("late", F.coalesce(F.sum("most").over(less) < F.col("bound"), F.lit(False))).drop("bound"), "common")
    adds = common.groupBy("query").agg(F.sum("most").alias("all"), F.coalesce(F.sum(F.when(F.col("late"), F.col("most"))), F.lit(0.0)).alias("more"))
    room = broadcast_if_small(written(bound.join(adds, "query", "left").na.fill(0.0, ["all", "more"]), "room"))
    # what drops out here can't come back with its whole score, and so not into the k best
    first = rare.join(room, "query", "left").where("bound IS NULL OR score + all >= bound").select("query", "key", "score")
    first = first.unionByName(scores(common.where("NOT late"))).groupBy("query", "key").agg(F.sum("score").alias("score"))
    first = written(first.join(room, "query", "left").where("bound IS NULL OR score + more >= bound").select("query", "key", "score"), "first")
    out = full(first, common.where("late")).withColumn("score", F.round("score", 9))
    return out.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, *, key: str, text: str, query: str, query_text: str, k: int = 20, k1: float = K1, b: float = B, often: float = 0.05) -> DataFrame:
    """The k best documents of each query: query, key, score, rank; ties by key.

    k1 and b are 0.9 and 0.4. Documents are read once: their number and sizes are counted as
    the postings are made. The corpus is cut to the queries' terms, and these postings are written once. A term that
    more than the share `often` of all documents have isn't scored for all of them (best).
    """
    from runloom.session import broadcast_if_small, written

    q = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term"))
    q = written(q, "query-terms")
    needed = broadcast_if_small(written(q.select("term").distinct(), "needed"))
    seen = Observation()
    p = postings(docs.select(F.col(key).alias("key"), F.col(text).alias("_text")), ["key"], F.col("_text"), seen)
    p = written(p.join(needed, "term", "left_semi"), "postings")
    of = seen.get
    n = docs.sparkSession.range(1).select(F.lit(of["n"]).alias("n"), F.lit((of["size"] or 0) / of["n"] if of["n"] else None).cast("double").alias("avgdl"))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("size").alias("min_size")).join(F.broadcast(n))
    df = df.withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    w = df.select("term", "idf", "avgdl", weight("max_tf", "min_size", k1, b).alias("most"), (F.col("df") > F.greatest(F.lit(k), F.col("n") * often)).alias("common"))
    found = best(p, written(q.join(w, "term"), "weights"), ["term"], k, k1, b)
    return found.select(F.col("query").alias(query), F.col("key").alias(key), "score", "rank")


def recall(gold: DataFrame, hits: DataFrame, query: str, key: str) -> DataFrame:
    """Average, all and any recall over the queries that have gold documents; no hits count as none found."""
    j = gold.select(query, key).distinct().join(hits.select(query, key).distinct().withColumn("_h", F.lit(1)), [query, key], "left")
    r = j.groupBy(query).agg((F.count("_h") / F.count(F.lit(1))).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("recall_avg"), F.avg((F.col("r") == 1).cast("int")).alias("recall_all"), F.avg((F.col("r") > 0).cast("int")).alias("recall_any"))


def holding(docs: DataFrame, items: DataFrame, key: str, item: str) -> DataFrame:
    """(item, key) of documents (key, text) that hold the whole text of an item (item, k); empty items are left out.

    Documents and items meet by the item's longest inner word, as a word at either of its ends
    may go on in the document. Items of one or two words have none: they meet by their first
    characters, four at most, with each such piece of a document. What meets is compared.
    """
    items = items.where("k != ''")
    words = F.split("k", r"[ \n]")
    inner = F.filter(words, lambda x, i: (i > 0) & (i < F.size(words) - 1) & (x != ""))
    items = items.withColumn("_w", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"])
    found = docs.select(key, "text", F.explode(F.array_distinct(F.split("text", r"[ \n]"))).alias("_w")).join(items.where("_w IS NOT NULL"), "_w").select(item, key, "text", "k")
    short = items.where("_w IS NULL").withColumn("_n", F.least(F.length("k"), F.lit(4)))
    for n in (r[0] for r in short.select("_n").distinct().orderBy("_n").collect()):  # up to four lengths
        pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(n))))
        own = short.where(F.col("_n") == n).select(item, "k", F.substring("k", 1, n).alias("_w"))
        found = found.unionByName(docs.select(key, "text", F.explode(pieces).alias("_w")).join(own, "_w").select(item, key, "text", "k"))
    return found.where(F.contains("text", F.col("k"))).select(item, key).distinct()


def prompt_files(text: Column) -> Column:
    """The files whose blocks `[start of f]` to `[end of f]` a prompt holds, each once; a block in a block is part of its text. A readme that comes first isn't one of them."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\[start of ([\w.\-/]+)\]\n[\s\S]+?\n\[end of \1\]"), F.lit(1))
    rest = F.when(F.contains(F.lower(F.get(found, 0)), F.lit("readme")), F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)
    return F.array_distinct(F.coalesce(rest, F.array().cast("array<string>")))


def patched_files(patch: Column) -> Column:
    """The files that a patch has old sides of, each once."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(patch, F.lit(r"--- a/(.+)"), F.lit(1)), F.array().cast("array<string>")))


def prompt_recalls(rows: DataFrame, key: str, text: str, patch: str) -> DataFrame:
    """(key, n_retrieved, n_gold, recall) of prompts by the files of their gold patches; without retrieved files 0. Rows whose patch names no file are left out."""
    r = rows.select(key, prompt_files(F.col(text)).alias("_r"), patched_files(F.col(patch)).alias("_g")).where(F.size("_g") > 0)
    return r.select(key, F.size("_r").alias("n_retrieved"), F.size("_g").alias("n_gold"), (F.size(F.array_intersect("_r", "_g")) / F.size("_g")).alias("recall"))


def recall_summary(recalls: DataFrame) -> DataFrame:
    """One row: n, and in per cent recall_avg, recall_all and recall_any."""
    r = F.col("recall")
    per = lambda c: F.round(100 * F.avg(c), 2)
    return recalls.agg(F.count(F.lit(1)).alias("n"), per(r).alias("recall_avg"), per((r == 1).cast("int")).alias("recall_all"), per((r > 0).cast("int")).alias("recall_any"))


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", most: int = 10_000) -> DataFrame:
    """All pairs (a, b) that imports connect, over any number of steps; cycles do no harm.

    Each round joins only the pairs that the last one found with the edges, and drops those
    known already, so it ends after as many rounds as the longest shortest path has steps.
    A graph with longer ones than `most` is an error.
    """
    from runloom.session import written

    e = written(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct(), "closure")
    new, parts = e, [e]
    for _ in range(most):
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        step = new.select("a", F.col("b").alias("_via")).join(e.select(F.col("a").alias("_via"), "b"), "_via").select("a", "b").distinct()
        new = written(step.join(known, ["a", "b"], "left_anti"), "closure")
        if new.isEmpty():
            return known
        parts.append(new)
        if len(parts) > 8:  # few tables to read in each round
            parts = [written(known.unionByName(new), "closure")]
    raise ValueError(f"paths of more than {most} steps")


def reached(edges: DataFrame, start: DataFrame, on: list[str], src: str = "src", dst: str = "dst", most: int = 10_000) -> DataFrame:
    """(on, start, node): what can be reached from each start (columns on, start) over edges (columns on, src, dst), itself included.

    Unlike closure() it goes on from the starts only. Each round looks at what the last one
    found and drops what is known.
    """
    from runloom.session import written

    e = written(edges.select(*on, F.col(src).alias("_via"), F.col(dst).alias("node")).distinct(), "edges")
    new = written(start.select(*on, "start").distinct().withColumn("node", F.col("start")), "reached")
    known = new
    for i in range(most):
        step = new.select(*on, "start", F.col("node").alias("_via")).join(e, [*on, "_via"]).select(*on, "start", "node").distinct()
        new = written(step.join(known, [*on, "start", "node"], "left_anti"), "reached")
        if new.isEmpty():
            return known
        known = known.unionByName(new) if i % 8 else written(known.unionByName(new), "reached")
    raise ValueError(f"paths of more than {most} steps")
