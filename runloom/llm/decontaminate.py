"""Operator 4. Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.base import broadcast_if_small, bytes_of, table, written

WINDOW = 13
#: What stands between words: ASCII characters other than letters and digits.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The most bytes of windows that are broadcast.
_BROADCAST = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    """Words by their gaps: several times as fast as to match each word."""
    return F.array_remove(F.split(text, _GAP), "")


def _words(text: Column) -> Column:
    """Exact words: only A-Z are lower-cased."""
    return _split(F.translate(text, _UPPER, _LOWER))


def _folded(text: Column) -> Column:
    """The same words with every letter lower-cased, which is much faster.

    Equal exact words have equal folded ones wherever they stand: the one lower-casing that
    looks at a letter's neighbours is that of the Greek capital sigma, and final sigmas go.
    """
    return _split(F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3")))


def benchmark_windows(items: DataFrame, *, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Each distinct window once: words, and the ids of its items as strings."""
    w = items.select(F.col(item).cast("string").alias("_item"), _words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - window + 1, F.lit(1)))
    w = w.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, window))).alias("words"))
    return w.groupBy("words").agg(F.collect_set("_item").alias("items"))


def contamination(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: key, n_words, n_hit, items (sorted ids as strings), contaminated.

    A benchmark window is contained in a document exactly if all its words follow each other
    there, so one word of it, its rarest, is the whole necessary prefix of the window's set.
    Words are ordered by their count over all documents, ties by themselves. A document's
    words are joined with these prefix words; the word's position fixes where the window
    would start, and it must fit between the document's ends (position and length bound).
    The words there are then compared with the window's, letter for letter, in the same scan:
    only windows that do occur are shuffled, and no text is.

    The windows by their prefix words are broadcast if they take up to 64 MB; else the
    documents' words meet them by a shuffle, and texts with a candidate are looked up again.
    A null text has no words and isn't contaminated. A null item id marks words as hit but
    has no id to list. Documents that agree in key and text have equal results. Empty tables
    of documents give no rows, of items no hits; other columns are not looked at.
    """
    wins = written(benchmark_windows(items, item=item, text=item_text, window=window), "windows")
    at = wins.select("words", "items", F.posexplode("words").alias("_p", "_exact")).withColumn("_word", F.element_at(_folded(F.col("_exact")), 1))
    vocab = written(at.select("_word").distinct(), "vocab")
    seen = docs.select(F.explode_outer(_folded(F.col(text))).alias("_word")).join(broadcast_if_small(vocab, 16 << 20), "_word").groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    seen = written(vocab.join(seen, "_word", "left").select("_word", F.coalesce("_n", F.lit(0)).alias("_n")), "rarity")
    prefix = at.join(seen, "_word").groupBy("words").agg(F.min(F.struct("_n", "_word", "_p")).alias("_r"), F.first("items").alias("items"))
    prefix = written(prefix.select("_r._word", "_r._p", F.size("words").alias("_size"), F.array_join("words", " ").alias("_window"), "items"), "prefix")

    ids = [F.col(key).alias("_key"), F.xxhash64(text).alias("_h")]
    small = bytes_of(prefix) <= _BROADCAST
    both = docs.select(*ids, _split(F.col(text)).alias("_w"), _folded(F.col(text)).alias("_f"))
    if small:
        # The arrays only pass through: they are read for candidates, and not copied for each
        # word. Outer, as else a filter is inferred that splits each text once more.
        found = both.select("_key", "_h", "_w", F.posexplode_outer("_f").alias("_at", "_word")).join(F.broadcast(prefix), "_word")
    else:
        places = both.select("_key", "_h", F.posexplode_outer("_f").alias("_at", "_word")).join(prefix, "_word").select("_key", "_h", "_at", "_p", "_size", "_window", "items")
        places = written(places.where((F.col("_at") >= F.col("_p"))), "candidates")
        found = places.join(both.select(F.col("_key").alias("_k2"), F.col("_h").alias("_h2"), "_w"), F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_h") == F.col("_h2")))
    start = F.col("_at") - F.col("_p")
    found = found.where((start >= 0) & (start + F.col("_size") <= F.size("_w")))
    found = found.where(F.translate(F.array_join(F.slice("_w", start + 1, F.col("_size")), " "), _UPPER, _LOWER) == F.col("_window"))
    hits = found.select("_key", "_h", start.alias("_start"), "_size", "items").groupBy("_key", "_h").agg(F.collect_set(F.struct("_start", "_size")).alias("_hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"))
    covered = F.array_distinct(F.flatten(F.transform("_hits", lambda c: F.sequence(c["_start"], c["_start"] + c["_size"] - 1))))
    hits = hits.select(F.col("_key").alias("_k2"), F.col("_h").alias("_h2"), F.size(covered).cast("long").alias("_n_hit"), F.array_sort("_items").alias("_items"))
    out = docs.select(*ids, F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(_split(F.col(text)))).cast("long").alias("n_words"))
    out = out.join(hits, F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_h") == F.col("_h2")), "left")
    out = out.select("_key", "n_words", F.coalesce("_n_hit", F.lit(0)).alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"))
    return out.select(F.col("_key").alias(key), "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT item, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 13 + 2, 2))) t(i) WHERE len(w) > 0
), k AS (SELECT DISTINCT k FROM q), p AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM d, k, unnest(range(1, len(w) - k + 2)) t(i) WHERE len(w) >= k
), h AS (
  SELECT p.doc_id, p.i, p.k, q.item FROM p JOIN q ON p.k = q.k AND p.s = q.s
), c AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + k)) t(j) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
