"""Operator 2. LM scoring by the marginal likelihood of a subword lattice."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.base import small_batches, table, text_runs, written
from runloom.llm.lattice import WordLattice
from runloom.llm.vocabulary import PATH, load

#: Words of the broadcast part of the model; all others are joined.
HEAD = 1 << 17
_LN10 = math.log(10)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's words with their counts in training and in all documents."""

    def rows(train: Counter, rest: Counter):
        words = list(train.keys() | rest.keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()), pa.array([train[w] + rest[w] for w in words], pa.int64())], names=["word", "c", "n"])

    train, rest = Counter(), Counter()
    for batch, texts in text_runs(batches, 1):
        for text, out in zip(texts, batch.column(0).to_pylist(), strict=True):
            to = rest if out else train
            to.update(text.lower().split())
            to[b""] += 1
        if len(train) + len(rest) > 500_000:
            yield from rows(train, rest)
            train, rest = Counter(), Counter()
    if train or rest:
        yield from rows(train, rest)


def _weighed(model, words: float, distinct: float, discount: float):
    """log10 of each word's probability: over all segmentations into pieces alone, and with the word's own arc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model.value
        for batch in batches:
            own = batch.column(0).to_pylist()
            lp = lattice.run([w.decode("utf-8", "replace") for w in own])
            arc, rest = word_arcs(np.asarray(batch.column(1), dtype=float), words, distinct, discount)
            both = np.logaddexp(arc, lp + rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(both / _LN10), pa.array(lp / _LN10)], names=["word", "c", "n", "lp", "lv"])

    return run


def word_arcs(c: np.ndarray, words: float, distinct: float, discount: float) -> tuple[np.ndarray, float]:
    """Natural logs of the weight of the arc that spans a whole training word, and of what is left for the paths of pieces.

    The arc has the word's share of the training words, less an absolute discount; the
    discounts of all distinct words are the weight of the pieces' paths. -inf: no arc.
    """
    if not words:
        return np.full(len(c), -np.inf), 0.0
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(c - discount, 0.0) / words), math.log(discount * distinct / words)


class _Head(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


_ROWS = "row long, sums struct<id: long, out: boolean, tokens: long, known: long, base: double, score: double, pieces: double>, word binary, tf long"


def _scored(head):
    """A document's sums over the words of the head, and a row for each other word of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, lp, lv = head.value
        index = _Head(zip(words, range(len(words)), strict=True))
        # the last number stands for words outside the head: they add nothing here
        base, lp, lv, known = np.append(np.log10(c + 0.5), 0.0), np.append(lp, 0.0), np.append(lv, 0.0), np.append(c > 0, False)
        get = index.__getitem__
        for batch, texts in text_runs(batches, 3):
            docs = [t.lower().split() for t in texts]
            sizes = np.fromiter(map(len, docs), np.int64, len(docs))
            ids = np.fromiter(map(get, chain.from_iterable(docs)), np.int32, int(sizes.sum()))
            of = np.repeat(np.arange(len(docs)), sizes)
            add = lambda x: np.bincount(of, x[ids], len(docs)).astype(float)  # noqa: E731, B023 (counts of nothing are whole numbers)
            at = np.cumsum(np.append(0, sizes))
            rows, own, tf, lead = [], [], [], []
            number = batch.column(0).to_pylist()
            for i, d in enumerate(docs):
                part = np.flatnonzero(ids[at[i] : at[i + 1]] < 0).tolist()
                rest = Counter([d[j] for j in part]) if part else {b" %d" % number[i]: 0}  # no word holds a space
                rows += [number[i]] * len(rest)
                own += rest.keys()
                tf += rest.values()
                lead += [i] + [-1] * (len(rest) - 1)
            lead = np.array(lead)
            none = lead < 0
            take = np.where(none, 0, lead)
            numbers = [("tokens", sizes + 1), ("known", add(known).astype(np.int64)), ("base", add(base)), ("score", add(lp)), ("pieces", add(lv))]
            fields = [("id", batch.column(1).take(pa.array(take))), ("out", batch.column(2).take(pa.array(take))), *((n, pa.array(x[take])) for n, x in numbers)]
            sums = pa.StructArray.from_arrays([x for _, x in fields], names=[n for n, _ in fields], mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), sums, pa.array(own, pa.binary()), pa.array(tf, pa.int64())], names=["row", "sums", "word", "tf"])

    return run


def _most_frequent(weighed: DataFrame, head: int) -> DataFrame:
    """At most `head` of the most frequent words: those above a frequency that counts by its logarithm give, so no task sees all tasks' words."""
    step = F.floor(F.log2("n") * 64)
    left, least = head, None
    for r in sorted(weighed.groupBy(step.alias("k")).count().collect(), key=lambda r: -r["k"]):  # 4,096 rows at most
        left -= r["count"]
        if left < 0:
            break
        least = r["k"]
    return weighed.where(step >= least) if least is not None else weighed.limit(0)


def lm_scores(docs: DataFrame, held_out, *, key: str = "doc_id", text: str = "text", vocabulary: str = PATH, head: int = HEAD) -> DataFrame:
    """One row for each document: key, held_out, n_tokens, n_known, train_tokens, base_score, score, pieces_score.

    Tokens are words (A-Z lower-cased, split at ASCII white space) and an end. A word's
    probability is the sum over all paths through its lattice: every segmentation into pieces
    of an existing vocabulary, weighted by that vocabulary's scores, and for a word of the
    training documents (those for which the column held_out is false) one more arc, over the
    whole word, with its discounted share of their words. A text is its words in order, each
    followed by an end or not, so `score` is the log10 of the marginal probability over all
    paths of the whole text. pieces_score is the same without the words' own arcs: the
    vocabulary's scores alone. base_score is the additively smoothed unigram score.

    Each distinct word goes through the lattice once, one forward pass in log space. Counts
    are of all documents and are never cut off: up to `head` of the most frequent words are
    broadcast, which bounds that by a number of words, and all others are joined.

    A null text is empty; an empty text is an end. A null key is scored like any other.
    Repeated rows are scored each by itself. An empty table gives no rows; without training
    documents words have their pieces' weight. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(key).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("out"), F.col(text).alias("text"))
    counts = rows.select("out", "text").mapInArrow(_counted, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    counts = written(counts, "counts")
    is_end = F.col("word") == F.lit(b"")
    t = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum(F.when(is_end, F.col("c"))), F.lit(0)).alias("ends"),
        F.count_if((F.col("c") > 0) & ~is_end).alias("words"), F.count_if((F.col("c") == 1) & ~is_end).alias("n1"), F.count_if((F.col("c") == 2) & ~is_end).alias("n2"),
    ).first()
    discount = discount_of(t.n1, t.n2)
    model = spark.sparkContext.broadcast(WordLattice(load(vocabulary)))
    weighed = counts.where(~is_end).mapInArrow(_weighed(model, float(t.n - t.ends), float(t.words), discount), "word binary, c long, n long, lp double, lv double")
    weighed = written(weighed, "weighed")
    top = _most_frequent(weighed, head).select("word", "c", "lp", "lv").toArrow()
    top = spark.sparkContext.broadcast((top.column("word").to_pylist(), *(np.asarray(top.column(k), dtype=float) for k in ("c", "lp", "lv"))))
    stop = t.ends / t.n if t.words else 0.5
    parts = rows.select(F.monotonically_increasing_id().alias("row"), "id", "out", "text").mapInArrow(_scored(top), _ROWS)
    j = parts.join(weighed.select("word", "c", "lp", "lv"), "word", "left")
    tail = lambda x: F.sum(F.col("tf") * F.coalesce(x, F.lit(0.0)))
    j = j.groupBy("row").agg(
        F.max("sums").alias("s"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        tail(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("base"), tail(F.col("lp")).alias("score"), tail(F.col("lv")).alias("pieces"),
    )
    norm = math.log10(t.n + 0.5 * (t.v + 1))
    ends = (F.col("s.tokens") - 1) * math.log10(1 - stop) + math.log10(stop)
    return j.select(
        F.col("s.id").alias(key),
        F.col("s.out").alias("held_out"),
        F.col("s.tokens").alias("n_tokens"),
        (F.col("s.known") + F.col("known") + int(t.ends > 0)).alias("n_known"),
        F.lit(t.n).cast("long").alias("train_tokens"),
        (F.col("s.base") + F.col("base") + math.log10(t.ends + 0.5) - F.col("s.tokens") * norm).alias("base_score"),
        (F.col("s.score") + F.col("score") + ends).alias("score"),
        (F.col("s.pieces") + F.col("pieces") + ends).alias("pieces_score"),
    )


def discount_of(once: int, twice: int) -> float:
    """The absolute discount, from how many words were seen once and twice."""
    return min(0.9, max(0.1, once / (once + 2 * twice) if once else 0.5))


def crc_fold(key: str, folds: int):
    """crc32 of the key as text, modulo folds; of a null key 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), crc_fold("doc_id", 5) == 1)
