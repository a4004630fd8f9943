"""Operator 3. Language ID by cross-parsing: suffix automata of labelled text give longest matches, the language with the fewest normalised phrases wins."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.base import held, small_batches, table, text_runs
from runloom.llm.scoring import crc_fold

UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")


class SuffixAutomaton:
    """The least automaton of all substrings of a text."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for ch in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and ch not in self.next[p]:
                self.next[p][ch] = new
                p = link[p]
            if p != -1:
                q = self.next[p][ch]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p].get(ch) == q:
                        self.next[p][ch] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new

        # a state is its dictionary of characters; those near the root come first, so they lie together
        order, near = [0], {0: {}}
        for i in order:
            order += [to for to in self.next[i].values() if near.setdefault(to, new := {}) is new]
        for i in order:
            near[i].update((ch, near[to]) for ch, to in self.next[i].items())
        self.root = near[0]
        del self.next

    def phrases(self, text: str) -> int:
        """How many longest matches, one after the other, make up text; a character that the automaton lacks is a phrase."""
        n, root = 0, self.root
        state = root
        for ch in text:
            if ch in state:
                state = state[ch]
            else:
                if state is not root:
                    n += 1
                if ch in root:
                    state = root[ch]
                else:
                    n += 1
                    state = root
        return n + (state is not root)


def normalised(text: str) -> str:
    """The words of a text (runs of letters) in lower case, with a space around each; empty if it has no letter."""
    words = _WORDS.findall(text.lower())
    if not words or not (words[0].isalpha() or any(ch.isalpha() for w in words for ch in w)):
        return ""
    return f" {' '.join(words)} "


class CrossParser:
    """The automata of all languages, and what a phrase costs in each: the bits that name a place in its sample."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.automata = [SuffixAutomaton(samples[x]) for x in self.langs]
        self.cost = np.array([math.log2(len(samples[x]) + 2) for x in self.langs])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the best language's number (-1: no letter, or nothing was learned) and a score."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        texts = [normalised(t) for t in texts] if self.langs else []
        own = [i for i, t in enumerate(texts) if t]
        # one automaton after the other, so that the states in use stay near the processor
        phrases = [[a.phrases(texts[i]) for i in own] for a in self.automata]
        for i, n in zip(own, zip(*phrases, strict=True), strict=True):
            n = np.array(n) * self.cost
            order = np.argsort(n, kind="stable")
            best[i] = order[0]
            score[i] = 1.0 if len(n) == 1 else float((n[order[1]] - n[order[0]]) / n[order[1]])
        return best, score


def _predicted(model, drop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = model.value
        parser = held(("language", *sorted(samples.items())), lambda: CrossParser(samples))
        for rows, texts in text_runs(batches, 0):
            best, score = parser.of([t.decode("utf-8", "replace") for t in texts])
            langs = [parser.langs[i] if i >= 0 else UNKNOWN for i in best.tolist()]
            yield pa.RecordBatch.from_arrays([*rows.columns[drop:], pa.array(langs, pa.string()), pa.array(score)], names=[*rows.schema.names[drop:], "_lang", "_score"])

    return run


def labelled_sample(rows: DataFrame, *, docs: int = 48, chars: int = 400, all_chars: int = 60_000, lang_chars: int = 4_000, labels: int = 1000) -> dict[str, str]:
    """A bounded sample of rows (id, text, lang) as normalised text by language.

    Of each language the documents with the least hashes of id and text are taken, `docs` at
    most, rows that agree in both once, and `chars` characters of each. A language has its
    share of `all_chars` characters at most, or `lang_chars` if that is more, so many languages
    don't starve each other: some 300 bytes of memory a character. Languages are the `labels`
    most frequent ones, ties by name: no other is ever predicted. So at most docs * labels
    rows of `chars` characters come to the driver.
    """
    h = F.xxhash64(F.lit(5), "id", "text")
    some = rows.select("lang", F.substring("text", 1, chars).alias("text"), h.alias("h"))
    known = some.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("d")).orderBy(F.desc("n"), "lang").limit(labels)
    # by rate three times as many rows as are needed, so that few are ranked
    rates = known.select("lang", F.least(F.lit(1.0), 3.0 * docs / F.greatest("d", F.lit(1))).alias("rate"))
    some = some.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    some = some.groupBy("lang", "h").agg(F.min("text").alias("text"))
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("at") <= docs).orderBy("lang", "at").select("lang", "text").collect()
    out: dict[str, list[str]] = {}
    for r in some:
        out.setdefault(r["lang"], []).append(" ".join(_WORDS.findall(r["text"].lower())))
    share = max(all_chars // len(out), lang_chars) if out else 0
    return {k: f" {' '.join(v)} "[:share] for k, v in out.items() if any(v)}


def detect(docs: DataFrame, training: DataFrame, *, key: str = "doc_id", text: str = "text", keep: dict | None = None, keep_text: bool = False, sample: dict | None = None) -> DataFrame:
    """One row for each document: key, with keep_text the text, keep's columns (name: expression), lang_pred, score.

    training has the columns id, text and lang; rows with a null text or lang are left out.
    Each language's sample becomes a suffix automaton; sample has other bounds for it than
    labelled_sample's own. A document's whole text, as words (runs of letters in lower case)
    with spaces between, is cut into longest matches by each automaton; phrases times the bits
    to name a place in the sample are the language's cost, and the least cost wins, ties going
    to the first language by name. score is the winner's lead over the second as a share of
    the second's cost.

    A text that is null or has no letter, or any if nothing was learned, is `und` with score
    0. Equal texts have equal results; repeated rows and null keys each have theirs. An empty
    table gives no rows. Other columns of docs are not looked at.
    """
    samples = labelled_sample(training.where("text IS NOT NULL AND lang IS NOT NULL"), **(sample or {}))
    model = docs.sparkSession.sparkContext.broadcast(samples)
    others = {"_key": F.col(key)} | {f"_k{i}": e for i, e in enumerate((keep or {}).values())}
    rows = small_batches(docs).select(F.col(text).alias("_text"), *[e.alias(n) for n, e in others.items()])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    drop = 0 if keep_text else 1
    out = rows.mapInArrow(_predicted(model, drop), ", ".join([f"{c} {kinds[c]}" for c in rows.columns[drop:]] + ["_lang string", "_score double"]))
    return out.select(F.col("_key").alias(key), *([F.col("_text").alias(text)] if keep_text else []), *[F.col(f"_k{i}").alias(n) for i, n in enumerate(keep or {})], F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_fold("doc_id", 3) != 1).select(F.col("doc_id").alias("id"), "text", "lang")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs, training_rows(docs), keep={"held_out": crc_fold("doc_id", 3) == 1})
