"""The kept index against a plain BM25, its generations, collections, resumption, and cut queries."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runloom.operators import index, retrieval


def tokens(t):
    return [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]


def plain(docs, queries, k):
    """docs: (collection, key, text); queries: (query, collection, text)."""
    out = {}
    for q, c, text in queries:
        own = [(key, Counter(tokens(t)), len(tokens(t))) for cc, key, t in docs if cc == c]
        if not own:
            continue
        avg, scores = sum(s for _, _, s in own) / len(own), Counter()
        for term in set(tokens(text)):
            df = sum(1 for _, tf, _ in own if term in tf)
            for key, tf, size in own:
                if term in tf:
                    scores[key] += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf[term] / (tf[term] + 0.9 * (0.6 + 0.4 * size / avg))
        best = sorted(((-round(s, 9), key) for key, s in scores.items()))[:k]
        out[q] = [(key, -s) for s, key in best]
    return out


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(9)
    words, odds = [f"w{i}" for i in range(400)], [1 / (i + 1) for i in range(400)]
    text = lambda n: " ".join(draw.choices(words, odds, k=n))
    docs = [("ab"[i % 3 == 0], i, text(draw.randrange(1, 90))) for i in range(900)] + [("a", 900, None), ("a", 901, ""), ("b", 902, "w1 " * 500)]
    queries = [(i, "ab"[i % 2], text(draw.randrange(1, 25))) for i in range(30)] + [(30, "none", "w1 w2"), (31, "a", "unheard"), (32, "a", None), (33, "a", "w0 w1 w2")]
    return docs, queries


@pytest.fixture(scope="module")
def made(spark, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    rows = spark.createDataFrame(corpus[0] + [("a", None, "w1 w2")], "c string, id long, text string")
    for g in range(3):
        index.add(rows.where(F.pmod(F.coalesce("id", F.lit(0)), F.lit(3)) == g), f"{at}/i", key="id", text="text", collection="c", buckets=8)
    return f"{at}/i"


def close(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-9)
        assert [k for k, _ in got[q]] == [k for k, _ in want[q]], q


def test_search_is_that_of_scoring_all(spark, corpus, made):
    docs, queries = corpus
    q = spark.createDataFrame(queries, "q long, c string, t string")
    for k, often in ((5, 0.05), (5, 0.3), (900, 0.0)):
        got = {}
        for r in index.search(spark, made, q, query="q", text="t", collection="c", k=k, often=often).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r["key"], r["score"]))
        close(got, {x: y for x, y in plain(docs, queries, k).items() if y})


def test_postings_are_neither_shuffled_nor_written_twice(spark, corpus, tmp_path, monkeypatch):
    from runloom import session
    from runloom.operators import retrieval

    tables, write = [], session.written

    def seen(df, name="table"):
        tables.append((name, (out := write(df, name)).count()))
        return out

    monkeypatch.setattr(session, "written", seen)
    monkeypatch.setattr(index, "written", seen)
    docs, queries = spark.createDataFrame(corpus[0], "c string, id long, text string"), spark.createDataFrame(corpus[1], "q long, c string, t string")
    index.add(docs, str(tmp_path / "i"), key="id", text="text", collection="c", buckets=2)
    assert not tables
    index.search(spark, str(tmp_path / "i"), queries, query="q", text="t", collection="c", k=5)
    assert max(n for _, n in tables) <= docs.count() * queries.count() / 2  # documents and queries, not their terms
    some = spark.createDataFrame([(1, "b a b"), (2, "c"), (3, ""), (4, None)], "id long, text string")
    p = retrieval.postings(some, ["id"], F.col("text"))
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in p.collect()) == [(1, 3, "a", 1), (1, 3, "b", 2), (2, 1, "c", 1)]


def test_an_unfinished_generation_does_not_count(spark, corpus, made, tmp_path):
    q = spark.createDataFrame([(1, "a", "w3 w5")], "q long, c string, t string")
    run = lambda: index.search(spark, made, q, query="q", text="t", collection="c").collect()
    before = run()
    for part in ("collections", "terms", "postings"):
        own = spark.read.parquet(f"{made}/{part}")
        own.withColumn("generation", F.lit("half-written")).write.mode("append").partitionBy("generation", *(["bucket"] if "bucket" in own.columns else [])).parquet(f"{made}/{part}")
    assert run() == before


def test_hits_are_appended_once(spark, corpus, made, tmp_path):
    q = spark.createDataFrame(corpus[1], "q long, c string, t string")
    out = str(tmp_path / "hits")
    index.search_into(spark, made, q.where("q < 10"), out, query="q", text="t", collection="c", k=3)
    index.search_into(spark, made, q, out, query="q", text="t", collection="c", k=3)
    lines = [json.loads(x) for f in (tmp_path / "hits").glob("*.json") for x in f.read_text().splitlines()]
    want = plain(*corpus, 3)
    assert sorted(int(x["query"]) for x in lines) == sorted(i for i, hits in want.items() if hits)
    close({int(x["query"]): [(h["docid"], h["score"]) for h in x["hits"]] for x in lines}, {i: h for i, h in want.items() if h})


def test_long_queries_are_cut_by_fifths(spark):
    texts = [" ".join(f"t{i}" for i in range(n)) for n in (3, 10, 11, 200, 5000)] + ["x " * 500, ""]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(index.shrunk(F.col("t"), 10).alias("s")).collect()]

    def want(t):
        while len(set(tokens(t))) > 10:
            t = t[: int(round(len(t) * 0.8))]
        return t

    assert got == [want(t) for t in texts]


def test_documents_that_hold_items(spark):
    from runloom.operators import retrieval

    docs = [(1, "the quick brown fox"), (2, "prequick brownish"), (3, "a\nb c"), (4, ""), (5, None), (6, "xyz")]
    items = [(1, "quick brown"), (2, "the quick brown"), (3, "b"), (4, ""), (5, None), (6, "xyz"), (7, "\nb"), (8, "quick  brown"), (9, "o")]
    d, i = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item long, k string")
    got = sorted(tuple(r) for r in retrieval.holding(d, i, "id", "item").collect())
    assert got == sorted((n, m) for n, k in items for m, t in docs if k and t and k in t)


def test_documents_are_read_once_for_scores(spark):
    """Sizes are counted as the postings are made; a null text has size 0 and counts as a document."""
    rows = [(1, "a b a c"), (2, "b c d"), (3, None), (4, ""), (5, "a a a e f g")]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(rows, "id int, text string").mapInArrow(counted, "id int, text string")
    queries = spark.createDataFrame([("q", "a b")], "q string, text string")
    got = retrieval.bm25(docs, queries, key="id", text="text", query="q", query_text="text").collect()
    assert read.value == len(rows)
    sizes = {i: len((x or "").split()) for i, x in rows}
    avg = sum(sizes.values()) / len(rows)
    want = {}
    for term in "ab":
        tf = {i: (x or "").split().count(term) for i, x in rows}
        df = sum(n > 0 for n in tf.values())
        for i, n in tf.items():
            if n:
                want[i] = want.get(i, 0) + math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * n / (n + 0.9 * (0.6 + 0.4 * sizes[i] / avg))
    assert {r["id"]: r["score"] for r in got} == {i: round(x, 9) for i, x in want.items()}
