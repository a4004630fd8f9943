"""Triage answers held against compacted events."""

import json

from runloom.operators import triage, validate

GOOD = {"include": True, "priority": "high", "score": 50, "confidence": 0.5, "tags": ["a"], "rationale": "since", "metadata_evidence": [], "trajectory_evidence": [{"event_id": "E1", "quote": "b" * 5, "why": "so"}]}
CASES = {
    "good": ({}, []),
    "whole confidence": ({"confidence": 1}, []),
    "true as a number": ({"score": True}, ["score"]),
    "text as a flag": ({"include": "true"}, ["include"]),
    "low but included": ({"priority": "low"}, ["priority_low"]),
    "low and left out": ({"priority": "low", "include": False}, []),
    "odd priority": ({"priority": 3}, ["priority"]),
    "fraction": ({"score": 50.5}, ["score"]),
    "too much": ({"score": 101, "confidence": 1.5}, ["score", "confidence"]),
    "null tags": ({"tags": None}, ["tags"]),
    "mixed tags": ({"tags": ["a", 1]}, ["tags"]),
    "blank tag": ({"tags": ["a", "\t"]}, ["tags"]),
    "blank rationale": ({"rationale": "  "}, ["rationale"]),
    "no metadata": ({"metadata_evidence": "x"}, ["metadata_evidence"]),
    "no evidence": ({"trajectory_evidence": []}, ["trajectory_evidence"]),
    "texts as evidence": ({"trajectory_evidence": ["E1"]}, ["trajectory_evidence"]),
    "unknown event": ({"trajectory_evidence": [{"event_id": "E9", "quote": "x", "why": "so"}]}, ["event"]),
    "hidden middle": ({"trajectory_evidence": [{"event_id": "E1", "quote": "MIDDLE", "why": "so"}]}, ["quote"]),
    "empty quote": ({"trajectory_evidence": [{"event_id": "E1", "quote": "", "why": " "}]}, ["quote", "why"]),
    "number as a quote": ({"trajectory_evidence": [{"event_id": "E1", "quote": 7}]}, ["quote", "why"]),
}


def test_rules_and_places(spark):
    text = "a" * 400 + "MIDDLE" + "b" * 400
    events = spark.createDataFrame([(c, "E1", 1, "user", text, False) for c in CASES] + [("folded", "E2", 2, "user", "Say \u201cHello  World\u201d now", False)], "case_id string, id string, turn long, role string, content string, is_issue boolean")
    shown = triage.compacted(events, 200)
    folded = {**GOOD, "trajectory_evidence": [{"event_id": "E2", "quote": '"hello world"', "why": "so"}, {"event_id": "E2", "quote": "now", "why": "so"}]}
    answers = [(c, json.dumps({**GOOD, **change})) for c, (change, _) in CASES.items()] + [("folded", json.dumps(folded)), ("null", None), ("no json", "{"), ("list", "[1]")]
    got = {r["case_id"]: r for r in validate.triage_answers(spark.createDataFrame(answers, "case_id string, response string"), shown).collect()}
    assert {c: got[c]["violations"] for c in CASES} == {c: want for c, (_, want) in CASES.items()}
    assert [got[c]["violations"] for c in ("null", "no json", "list")] == [["object"]] * 3
    e = got["good"]["evidence"][0]
    b = len(text) - (200 - int(200 * 0.65))
    assert (e["part"], e["start"], e["stop"]) == ("content_end", b, b + 5) and text[e["start"] : e["stop"]] == e["quote"]
    a, b = got["folded"]["evidence"]
    assert (a["quote"], a["part"], a["start"]) == ("\u201cHello  World\u201d", "content", 4) and (b["quote"], b["start"], b["stop"]) == ("now", 19, 22)
    assert got["hidden middle"]["evidence"] == [] and got["folded"]["violations"] == []
