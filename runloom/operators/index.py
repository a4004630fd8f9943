"""A kept inverted index: sorted postings and each term's best values, added to in generations, searched by BM25 without scoring what can't win."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators.retrieval import best, postings, terms, weight
from runloom.session import broadcast_if_small, written

#: Terms that are filtered on by name in the files; clauses of a query.
NAMED, CLAUSES = 2_000, 1_024
_ALL = "_"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A part of the index, as far as its generations are complete; there are few of these."""
    done = [r["generation"] for r in spark.read.parquet(f"{path}/complete").select("generation").collect()]
    return spark.read.parquet(f"{path}/{part}").where(F.col("generation").isin(done))


def add(docs: DataFrame, path: str, *, key: str, text: str, collection: str | None = None, buckets: int = 64) -> str:
    """Puts documents into the index at path, which is made if it isn't there; the name of the generation.

    An index holds any number of collections, each with statistics of its own; without a column
    for them there is one. A generation counts as soon as all of it is written, so a job that
    fails leaves the index as it was. Each task writes the postings of its documents to folders
    by a hash of their term and, in these, in order of terms: postings are never shuffled, and
    no list is put together in one task. A term's number of documents in a generation, largest
    frequency and smallest size are kept beside them. A document that is added twice counts
    twice. A null text has no terms; documents with a null key are left out.
    """
    spark, generation = docs.sparkSession, uuid.uuid4().hex
    own = F.lit(_ALL) if collection is None else F.col(collection).cast("string")
    t = docs.where(F.col(key).isNotNull()).select(own.alias("collection"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sizes = t.groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(terms(F.col("_text"))).cast("long")).alias("size"))
    sizes.withColumn("generation", F.lit(generation)).write.mode("append").partitionBy("generation").parquet(f"{path}/collections")
    p = postings(t, ["collection", "key"], F.col("_text")).withColumn("bucket", _bucket(F.col("term"), buckets))
    p.sortWithinPartitions("bucket", "collection", "term").write.partitionBy("bucket").parquet(f"{path}/postings/generation={generation}")
    p = spark.read.schema(p.schema).parquet(f"{path}/postings/generation={generation}")
    df = p.groupBy("bucket", "collection", "term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("size").alias("min_size")).withColumn("generation", F.lit(generation))
    df.repartition("bucket").sortWithinPartitions("bucket", "collection", "term").write.mode("append").partitionBy("generation", "bucket").parquet(f"{path}/terms")
    spark.range(1).select(F.lit(generation).alias("generation"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("append").parquet(f"{path}/complete")
    return generation


def shrunk(text: Column, most: int = CLAUSES) -> Column:
    """A query's text, cut by a fifth of its characters as often as it has more than `most` different terms."""
    many = lambda t: F.size(F.array_distinct(terms(t))) > most
    cut = lambda t: F.left(t, F.bround(F.length(t) * 0.8).cast("int"))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log(F.length(text) + 1.0) / F.log(F.lit(1.25))) + 4).cast("int"))
    return F.when(many(text), F.aggregate(steps, text, lambda t, _: F.when(many(t), cut(t)).otherwise(t))).otherwise(text)


def search(spark: SparkSession, path: str, queries: DataFrame, *, query: str, text: str, collection: str | None = None, k: int = 20, often: float = 0.05, most_terms: int = CLAUSES) -> DataFrame:
    """The k best documents of each query in its collection: query, key, score, rank; ties by key.

    Only folders of the queries' terms are read, and where these are few only their places in
    the files. Queries whose collection the index lacks have no rows. Terms that few documents
    have admit candidates; what the others can add is bounded by each term's best values
    (retrieval.best). The result is that of scoring all.
    """
    own = F.lit(_ALL) if collection is None else F.col(collection).cast("string")
    buckets = spark.read.parquet(f"{path}/complete").agg(F.max("buckets")).first()[0]
    q = queries.select(F.col(query).alias("query"), own.alias("collection"), F.explode(F.array_distinct(terms(shrunk(F.col(text), most_terms)))).alias("term"))
    q = written(q.withColumn("bucket", _bucket(F.col("term"), buckets)), "query-terms")
    needed = [r[0] for r in q.select("bucket").distinct().collect()]  # no more than the index has buckets
    named = [r[0] for r in q.select("term").distinct().limit(NAMED + 1).collect()]
    pick = F.col("bucket").isin(needed) & (F.col("term").isin(named) if len(named) <= NAMED else F.lit(True))
    total = _read(spark, path, "collections").groupBy("collection").agg(F.sum("n").alias("n"), (F.sum("size") / F.sum("n")).alias("avgdl"))
    asked = broadcast_if_small(written(q.select("collection", "term").distinct(), "asked"))
    found = _read(spark, path, "terms").where(pick).join(asked, ["collection", "term"])
    df = found.groupBy("collection", "term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_size").alias("min_size")).join(total, "collection")
    df = df.withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    df = df.select("collection", "term", "idf", "avgdl", weight("max_tf", "min_size").alias("most"), (F.col("df") > F.greatest(F.lit(k), F.col("n") * often)).alias("common"))
    of = written(q.join(df, ["collection", "term"]).select("query", "collection", "term", "idf", "avgdl", "most", "common"), "weights")
    key = F.col("key") if collection is None else F.struct("key", "collection")
    lists = _read(spark, path, "postings").where(pick).select("collection", "term", key.alias("key"), "size", "tf")
    found = best(lists, of, ["collection", "term"], k)
    return found.select("query", (F.col("key") if collection is None else F.col("key.key")).alias("key"), "score", "rank")


def search_into(spark: SparkSession, path: str, queries: DataFrame, out: str, *, query: str, **options) -> None:
    """Searches for the queries that out, lines of JSON (query, hits), doesn't have yet, and appends theirs; queries that aren't in the index are skipped."""
    from pyspark.errors import AnalysisException

    try:
        had = spark.read.schema("query string").json(out).select(F.col("query").alias("_had")).distinct()
        queries = queries.join(had, F.col(query).cast("string") == F.col("_had"), "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    hits = search(spark, path, queries, query=query, **options).orderBy("query", "rank")
    each = F.transform(F.sort_array(F.collect_list(F.struct("rank", "key", "score"))), lambda h: F.struct(h["key"].alias("docid"), h["score"].alias("score")))
    hits.groupBy(F.col("query").cast("string").alias("query")).agg(each.alias("hits")).write.mode("append").json(out)
