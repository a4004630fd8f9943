"""A corpus pipeline: language ID, near-duplicates, repeated passages, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame with the columns of documents; the last returns encoded documents. Results between
stages are Parquet tables.

In every stage any column may be null; other columns of docs are left out, whatever their
names; an empty table gives an empty one; and rows don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm import decontaminate, language, neardup, pieces, substring
from runloom.llm.base import broadcast_if_small, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was recognised; those without a letter, null texts too, go. Labels of `documents` are learned from, never used to predict.

    Where nothing can be learned no language is recognised, so all go. Repeated rows and null
    keys are looked at each by itself.
    """
    found = language.detect(docs, language.training_rows(docs), keep={c: F.col(c) for c in COLUMNS[2:]}, keep_text=True)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id.

    Rows that repeat a key are one document, and stay or go together. Null and empty texts
    are nobody's duplicates, and rows with a null key take no part: all of these stay.
    """
    stay = written(neardup.near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id").distinct(), "kept")
    hinted = broadcast_if_small(stay)
    return docs.join(hinted, docs["doc_id"].eqNullSafe(hinted["doc_id"]), "left_semi").select(*COLUMNS)


def substring_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one has; texts without any, null ones too, are left as they are.

    A null key is before all others. Rows that repeat key and text are equally early, and are
    cut alike.
    """
    cut = substring.remove_repeats(docs, keep=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark passages.

    A key goes with all its rows if any of them is contaminated, null as a key like any other.
    A null text isn't contaminated; an empty benchmark contaminates nothing.
    """
    items = table(spark, sf_dir, "benchmark")
    bad = written(decontaminate.contamination(docs, items).where("contaminated").select("doc_id").distinct(), "contaminated")
    hinted = broadcast_if_small(bad)
    return docs.join(hinted, docs["doc_id"].eqNullSafe(hinted["doc_id"]), "left_anti").select(*COLUMNS)


def encoding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as ids of subword pieces, from which their texts can be read back; a null text has null ids. Repeated rows and null keys are coded each by itself."""
    return pieces.encode(docs, keep=("lang", "source")).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: Cross-parsing and best segmentations have no form in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
