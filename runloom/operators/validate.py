"""Checks of annotated phase graphs and triage answers, as violations by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.recovery import locate_quote


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds an array of the names of the rules that a row breaks; a rule that is null is broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("violations", broken)


def graph(nodes: DataFrame, events: DataFrame, unclassified: DataFrame, phases: list[str]) -> DataFrame:
    """By case the broken rules: known phases, unique node ids, confidence, events in order and apart, every event accounted for once.

    nodes: case_id, id, phase, confidence, event_idx (array). events: case_id, event_idx.
    """
    n = nodes.withColumns({"_lo": F.array_min("event_idx"), "_hi": F.array_max("event_idx")})
    n = n.withColumn("_before", F.max("_hi").over(Window.partitionBy("case_id").orderBy("_lo", "id").rowsBetween(Window.unboundedPreceding, -1)))
    by = n.groupBy("case_id").agg(
        F.bool_and(F.col("phase").isin(phases)).alias("phases"),
        (F.count("id") == F.count_distinct("id")).alias("ids"),
        F.bool_and(F.col("confidence").between(0, 1)).alias("confidence"),
        F.bool_and(F.col("_before").isNull() | (F.col("_before") < F.col("_lo"))).alias("order"),
    )
    used = nodes.select("case_id", F.explode("event_idx").alias("event_idx")).unionByName(unclassified.select("case_id", "event_idx")).groupBy("case_id", "event_idx").agg(F.count(F.lit(1)).alias("_k"))
    full = events.select("case_id", "event_idx", F.lit(1).alias("_e")).join(used, ["case_id", "event_idx"], "full_outer")
    once = full.groupBy("case_id").agg(F.bool_and((F.coalesce("_k", F.lit(0)) == 1) & F.col("_e").isNotNull()).alias("_once"))
    j = once.join(by, "case_id", "left")
    return violations(j, {"phases": F.col("phases"), "ids": F.col("ids"), "confidence": F.col("confidence"), "order": F.col("order"), "accounting": F.col("_once")}).select("case_id", "violations")


def evidence(quotes: DataFrame, events: DataFrame) -> DataFrame:
    """Quotes with `found`: the event that they name holds them."""
    j = quotes.join(events.select("case_id", F.col("id").alias("event_id"), "content"), ["case_id", "event_id"], "left")
    return j.withColumn("found", F.coalesce(F.contains("content", F.col("quote")), F.lit(False))).drop("content")


def triage(rows: DataFrame) -> DataFrame:
    """Adds violations of triage answers: score, confidence, priority, and an inclusion of low priority."""
    return violations(rows, {"score": F.col("score").between(0, 100), "confidence": F.col("confidence").between(0, 1), "priority": F.col("priority").isin("high", "medium", "low"), "include": ~(F.col("include") & (F.col("priority") == "low"))})


def triage_answers(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """(case_id, violations, evidence) of answers (case_id, response: JSON text), held against the events as the prompt showed them.

    shown: case_id, id, and the struct shown of triage.compacted() or prompt_events(): an
    event's content, or its two ends with the length of all of it. Types are strict: a number
    in quotes is none, a fraction is no score. Rules: object, include (true or false), priority
    (high, medium, low), priority_low (not for what is included), score (a whole number from 0
    to 100), confidence (0 to 1), tags and metadata_evidence (lists of texts that aren't blank),
    rationale, trajectory_evidence (a list of objects, not empty), and of each of these event
    (shown), quote (in what is shown of it) and why.

    evidence has those whose quote was found, in order: event_id, quote, part (content,
    content_start or content_end), start and stop in the event's whole content. In a content
    shown whole a quote may differ in case, spaces, quotes or dashes; it becomes the text's
    own. A null response, or one that isn't JSON, breaks object alone.
    """
    v = answers.select("case_id", F.try_parse_json("response").alias("_v"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    get = lambda path, t: F.try_variant_get("_v", path, t)
    is_text = lambda path: F.coalesce(kind(path) == "STRING", F.lit(False)) & F.coalesce(get(path, "string").rlike(r"\S"), F.lit(False))
    number = lambda path, *kinds: F.coalesce(kind(path).rlike("^(?:" + "|".join(kinds) + ")"), F.lit(False))
    texts = lambda path: kind(path).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(get(path, "array<string>"), lambda x: F.coalesce(x.rlike(r"\S"), F.lit(False)))
    priority, include = F.when(kind("$.priority") == "STRING", get("$.priority", "string")), F.when(kind("$.include") == "BOOLEAN", get("$.include", "boolean"))
    items = get("$.trajectory_evidence", "array<variant>")
    top = {
        "include": include.isNotNull(),
        "priority": priority.isin("high", "medium", "low"),
        "priority_low": ~(F.coalesce(include, F.lit(False)) & F.coalesce(priority == "low", F.lit(False))),
        "score": number("$.score", "BIGINT$") & get("$.score", "long").between(0, 100),
        "confidence": number("$.confidence", "BIGINT$", "DOUBLE$", "DECIMAL") & get("$.confidence", "double").between(0, 1),
        "tags": texts("$.tags"),
        "rationale": is_text("$.rationale"),
        "metadata_evidence": texts("$.metadata_evidence"),
        "trajectory_evidence": kind("$.trajectory_evidence").startswith("ARRAY") & (F.size(items) > 0) & F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))),
    }
    whole = kind("$").startswith("OBJECT")
    checked = violations(v.withColumn("_items", items), {"object": whole} | {n: ~F.coalesce(whole, F.lit(False)) | ok for n, ok in top.items()})

    part = lambda path: F.when(F.schema_of_variant(F.try_variant_get("_i", path, "variant")) == "STRING", F.try_variant_get("_i", path, "string"))
    each = checked.select("case_id", F.posexplode("_items").alias("_at", "_i")).where(F.coalesce(F.schema_of_variant("_i").startswith("OBJECT"), F.lit(False)))
    each = each.select("case_id", "_at", part("$.event_id").alias("event_id"), part("$.quote").alias("quote"), part("$.why").alias("why"))
    j = each.join(shown.select("case_id", F.col("id").alias("event_id"), "shown", F.lit(True).alias("_known")), ["case_id", "event_id"], "left")
    inside = lambda c: F.coalesce(F.contains(F.col(f"shown.{c}"), F.col("quote")) & (F.col("quote") != ""), F.lit(False))
    folded = locate_quote("quote", "shown.content")
    j = j.withColumn("_folded", F.when(F.col("_known") & (F.col("quote") != "") & F.col("shown.content").isNotNull() & ~inside("content"), folded))
    at = lambda c: F.instr(F.col(f"shown.{c}"), F.col("quote")) - 1
    size = F.length("quote")
    found = lambda c, start: F.struct(F.col("quote").alias("quote"), F.lit(c).alias("part"), start.cast("int").alias("start"), (start + size).cast("int").alias("stop"))
    own = F.struct(F.substring(F.col("shown.content"), F.col("_folded.start") + 1, F.col("_folded.stop") - F.col("_folded.start")).alias("quote"), F.lit("content").alias("part"), F.col("_folded.start").alias("start"), F.col("_folded.stop").alias("stop"))
    back = F.col("shown.content_length") - F.length("shown.content_end")
    place = F.when(inside("content"), found("content", at("content"))).when(inside("content_start"), found("content_start", at("content_start"))).when(inside("content_end"), found("content_end", back + at("content_end"))).when(F.col("_folded.start").isNotNull(), own)
    j = j.withColumn("_place", place)
    broken = lambda ok: F.bool_and(F.coalesce(ok, F.lit(False)))
    per = j.groupBy("case_id").agg(
        broken(F.col("_known")).alias("_event"),
        broken(F.col("_place").isNotNull() | F.col("_known").isNull()).alias("_quote"),
        broken(F.col("why").rlike(r"\S")).alias("_why"),
        F.array_sort(F.collect_list(F.when(F.col("_place").isNotNull(), F.struct("_at", "event_id", "_place")))).alias("_found"),
    )
    out = checked.join(per, "case_id", "left")
    more = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(True)), n) for c, n in ((F.col("_event"), "event"), (F.col("_quote"), "quote"), (F.col("_why"), "why"))]), lambda x: x.isNotNull())
    spans = F.transform("_found", lambda x: F.struct(x["event_id"].alias("event_id"), x["_place"]["quote"].alias("quote"), x["_place"]["part"].alias("part"), x["_place"]["start"].alias("start"), x["_place"]["stop"].alias("stop")))
    return out.select("case_id", F.concat("violations", more).alias("violations"), F.coalesce(spans, F.array().cast("array<struct<event_id: string, quote: string, part: string, start: int, stop: int>>")).alias("evidence"))


def clues(rows: DataFrame, issues: DataFrame, categories: list[str], roles: list[str], strengths: list[str]) -> DataFrame:
    """Clues with their places in the issue's text and the rules that each breaks.

    rows: case_id, id, category, type, role, signal_strength, value, quote, confidence, and
    `at`, their order. issues: case_id, issue_description. A quote that is found only with
    case, spaces or quotes folded becomes the text's own, with exact_match false; one that
    isn't found stays as it is, without a place. An id or, for the same category, a span that
    an earlier clue of the case has is a duplicate.
    """
    c = rows.join(issues.select("case_id", "issue_description"), "case_id", "left").withColumn("_at", locate_quote("quote", "issue_description"))
    c = c.withColumns({"start": F.col("_at.start"), "stop": F.col("_at.stop"), "exact_match": F.coalesce("_at.exact", F.lit(False))})
    c = c.withColumn("quote", F.when(F.col("start").isNotNull(), F.expr("substring(issue_description, start + 1, stop - start)")).otherwise(F.col("quote")))
    first = lambda *keys: F.row_number().over(Window.partitionBy("case_id", *keys).orderBy("at")) == 1
    c = c.withColumns({"_id": first("id"), "_span": F.col("start").isNull() | first("start", "stop", "category")})
    text = lambda n: F.col(n).rlike(r"\S")
    rules = {"id": text("id") & F.col("_id"), "category": F.col("category").isin(categories), "type": text("type"), "role": F.col("role").isin(roles), "signal_strength": F.col("signal_strength").isin(strengths), "value": F.col("value").isNotNull(), "quote": F.col("quote") != "", "span": F.col("_span"), "confidence": F.col("confidence").between(0, 1)}
    return violations(c, rules).drop("issue_description", "_at", "_id", "_span")


def repaired(nodes: DataFrame, evidence_: DataFrame, events: DataFrame, phases: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, evidence, unclassified) after repairs that keep the evidence.

    nodes: case_id, id, at (their order), phase, confidence, event_idx (array). evidence_:
    case_id, id (of its node), event_idx, quote. events: case_id, event_idx, content.

    A phase "a|b" becomes the first known one, with a confidence of 0.75 at most. Quotes are
    brought to the event's own text where they are found in it. A node without events takes
    those of its evidence. Nodes are put in the order of their first events and trimmed to
    events after those of the nodes before, with their evidence; nodes left without events or
    evidence go. Events of no node are unclassified. A case's nodes are folded in one task.
    """
    known = F.try_element_at(F.filter(F.transform(F.split("phase", r"\|"), lambda p: F.trim(p)), lambda p: p.isin(phases)), F.lit(1))
    picked = ~F.col("phase").isin(phases) & known.isNotNull()
    n = nodes.withColumns({"phase": F.when(picked, known).otherwise(F.col("phase")), "confidence": F.when(picked, F.least("confidence", F.lit(0.75))).otherwise(F.col("confidence"))})
    e = evidence_.join(events.select("case_id", "event_idx", "content"), ["case_id", "event_idx"]).withColumn("_at", locate_quote("quote", "content"))
    e = e.select("case_id", "id", "event_idx", F.when(F.col("_at.start").isNotNull(), F.expr("substring(content, _at.start + 1, _at.stop - _at.start)")).otherwise(F.col("quote")).alias("quote"), F.coalesce("_at.exact", F.lit(False)).alias("exact_match"))
    own = e.groupBy("case_id", "id").agg(F.collect_set("event_idx").alias("_ev"))
    all_ = events.groupBy("case_id").agg(F.collect_set("event_idx").alias("_all"))
    n = n.join(own, ["case_id", "id"], "left").join(all_, "case_id", "left")
    n = n.withColumn("event_idx", F.array_sort(F.array_distinct(F.array_intersect(F.when(F.coalesce(F.size("event_idx"), F.lit(0)) > 0, F.col("event_idx")).otherwise(F.coalesce("_ev", F.array().cast("array<int>"))), "_all"))))
    item = F.struct(F.coalesce(F.array_min("event_idx"), F.lit(1 << 30)).alias("lo"), "at", "id", "event_idx", F.coalesce("_ev", F.array().cast("array<int>")).alias("ev"))
    kind = "array<struct<id:string,event_idx:array<int>>>"
    start = F.struct(F.lit(-1).alias("last"), F.array().cast(kind).alias("out"))

    def step(acc, x):
        kept = F.filter(x["event_idx"], lambda i: i > acc["last"])
        # evidence of a dropped event goes with it; what stands outside the node stays
        dropped = F.array_except(x["event_idx"], kept)
        stays = (F.size(kept) > 0) & (F.size(F.array_except(x["ev"], dropped)) > 0)
        return F.struct(F.when(stays, F.array_max(kept)).otherwise(acc["last"]).alias("last"), F.when(stays, F.concat(acc["out"], F.array(F.struct(x["id"].cast("string").alias("id"), kept.alias("event_idx"))))).otherwise(acc["out"]).alias("out"))

    folded = n.groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("x")).select("case_id", F.explode(F.aggregate("x", start, step, lambda a: a["out"])).alias("o"))
    kept = folded.select("case_id", F.col("o.id").alias("id"), F.col("o.event_idx").alias("event_idx"))
    out = n.drop("event_idx", "_ev", "_all").join(kept, ["case_id", "id"])
    was = n.select("case_id", "id", F.col("event_idx").alias("_was"))
    gone = kept.join(was, ["case_id", "id"]).select("case_id", "id", F.explode(F.array_except("_was", "event_idx")).alias("event_idx"))
    e = e.join(kept.select("case_id", "id"), ["case_id", "id"], "left_semi").join(gone, ["case_id", "id", "event_idx"], "left_anti")
    rest = events.select("case_id", "event_idx").join(kept.select("case_id", F.explode("event_idx").alias("event_idx")), ["case_id", "event_idx"], "left_anti")
    return out, e, rest


def graph_entries(nodes: DataFrame, unclassified: DataFrame) -> DataFrame:
    """(case_id, position, kind, id): nodes and unclassified events by their first event; what has none comes last."""
    far = F.lit(1_000_000)
    a = nodes.select("case_id", F.coalesce(F.array_min("event_idx"), far).alias("first"), F.lit("node").alias("kind"), F.col("id").cast("string").alias("id"))
    b = unclassified.select("case_id", F.coalesce("event_idx", far).alias("first"), F.lit("unclassified").alias("kind"), F.concat(F.lit("E"), "event_idx").alias("id"))
    return a.unionByName(b).withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy("first", "kind", "id"))).drop("first")
