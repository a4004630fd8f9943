"""Arrow functions for what column expressions can't do: cut JSON, folded quotes, shell words, spans."""

from __future__ import annotations

import json
import re
import shlex

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')


def top_level(text: str, key: str) -> int:
    """Where the value of a key of the outermost object begins; -1 if it isn't there."""
    depth, i, n = 0, 0, len(text)
    while i < n:
        ch = text[i]
        if ch == '"':
            m = _STRING.match(text, i)
            if not m:
                return -1
            i = m.end()
            if depth == 1 and m[0] == json.dumps(key):
                rest = re.compile(r"\s*:\s*").match(text, i)
                if rest:
                    return rest.end()
            continue
        depth += (ch in "{[") - (ch in "}]")
        i += 1
    return -1


def recovered(text: str | None) -> dict:
    """A trajectory from JSON that may have been cut: all of it, or its info and all complete messages."""
    if not text:
        return {"truncated": False, "info": None, "messages": []}
    try:
        d = json.loads(text)
        d = d if isinstance(d, dict) else {}
        return {"truncated": False, "info": d.get("info"), "messages": d.get("messages") or []}
    except ValueError:
        pass
    decoder, info, messages = json.JSONDecoder(), None, []
    if (at := top_level(text, "info")) >= 0:
        try:
            info = decoder.raw_decode(text, at)[0]
        except ValueError:
            info = None
    if (at := top_level(text, "messages")) >= 0 and text[at : at + 1] == "[":
        at += 1
        while True:
            at = re.compile(r"[\s,]*").match(text, at).end()
            try:
                m, at = decoder.raw_decode(text, at)
            except ValueError:
                break
            messages.append(m)
    return {"truncated": True, "info": info, "messages": messages}


@F.pandas_udf(T.StructType().add("truncated", T.BooleanType()).add("info", T.StringType()).add("messages", T.ArrayType(T.StringType())))
def recover_json(text: pd.Series) -> pd.DataFrame:
    """recovered(), with info and each message as JSON text; one trajectory at a time is held as objects."""

    def one(t):
        r = recovered(t)
        return r["truncated"], json.dumps(r["info"]) if r["info"] is not None else None, [json.dumps(m) for m in r["messages"]]

    return pd.DataFrame([one(t) for t in text], columns=["truncated", "info", "messages"])


@F.pandas_udf(T.StringType())
def sorted_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys; what isn't JSON stays."""

    def one(t):
        if t is None or t.lstrip()[:1] not in '"{[-0123456789tfnNI':  # what no JSON begins with
            return t
        try:
            return json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False)
        except (TypeError, ValueError):
            return t

    return text.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def shell_words(command: pd.Series) -> pd.Series:
    """Words of a command as a shell splits them; at white space where quotes don't match."""

    def one(c):
        try:
            return shlex.split(c or "")
        except ValueError:
            return (c or "").split()

    return command.map(one)


#: Characters that count as plain quotes, a dash and a space.
_FOLD = {0x2018: "'", 0x2019: "'", 0x201B: "'", 0x2032: "'", 0x201C: '"', 0x201D: '"', 0x201F: '"', 0x2033: '"', 0x2013: "-", 0x2014: "-", 0x00A0: " "}


def _folded(text: str) -> tuple[str, list[int]]:
    """Text in lower case with quotes and dashes folded and runs of spaces as one; and where each character stood, with the end."""
    chars, places = [], []
    for i, ch in enumerate(text.translate(_FOLD)):
        if ch.isspace():
            if not chars or chars[-1] != " ":
                chars.append(" ")
                places.append(i)
            continue
        for low in ch.lower():
            chars.append(low)
            places.append(i)
    return "".join(chars), [*places, len(text)]


def _lowered(text: str) -> tuple[str, list[int] | range]:
    """Text in lower case, and where each character stood, with the end."""
    low = text.lower()
    if len(low) == len(text):
        return low, range(len(text) + 1)
    places = [i for i, ch in enumerate(text) for _ in ch.lower()]
    return "".join(ch.lower() for ch in text), [*places, len(text)]


def locate(quote: str | None, text: str | None) -> tuple[int, int, bool] | None:
    """Where a quote stands in a text (begin, end, exact): as it is, but for case, without an ellipsis and white space at its ends, or with case, spaces, quotes and dashes folded."""
    if not quote or text is None:
        return None
    if (at := text.find(quote)) >= 0:
        return at, at + len(quote), True
    (low, places), q = _lowered(text), quote.lower()
    if (at := low.find(q)) >= 0:
        return places[at], places[at + len(q)], False
    q = re.sub(r"^\.{3}|\.{3}$", "", quote.strip().strip("…")).strip()
    if q and (at := text.find(q)) >= 0:
        return at, at + len(q), False
    (low, places), q = _folded(text), _folded(quote)[0].strip()
    at = low.find(q) if q else -1
    return (places[at], places[at + len(q)], text[places[at] : places[at + len(q)]] == quote) if at >= 0 else None


@F.pandas_udf(T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType()).add("exact", T.BooleanType()))
def locate_quote(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([locate(q, t) or (None, None, None) for q, t in zip(quote, text, strict=True)], columns=["start", "stop", "exact"]).astype({"start": "Int32", "stop": "Int32", "exact": "boolean"})


def spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that don't overlap, taken greedily by begin, the longer first."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if a < b and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


_SPANS = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType()))


@F.pandas_udf(_SPANS)
def disjoint_spans(found: pd.Series) -> pd.Series:
    """spans() of an array of struct<start, stop>."""
    return found.map(lambda x: [{"start": a, "stop": b} for a, b in spans([(s["start"], s["stop"]) for s in x])] if x is not None else None)


def ordered_nodes(nodes: list[dict]) -> list[dict]:
    """Nodes by first event, each trimmed to events after those of the ones before; empty ones go."""
    out, last = [], -1
    for n in sorted(nodes, key=lambda n: (min(n["events"], default=1 << 60), n["id"])):
        own = sorted({e for e in n["events"] if e > last})
        if own:
            out.append(n | {"events": own})
            last = own[-1]
    return out


def loose_unescape(text: str | None) -> str:
    """The text that a JSON string stands for, also if its quotes are missing or it isn't valid JSON; without spaces around."""
    body = (text or "").strip()
    try:
        whole = json.loads(body)
        if isinstance(whole, str):
            return whole.strip()
    except ValueError:
        pass
    if len(body) >= 2 and body[0] == body[-1] == '"':
        body = body[1:-1]
    for a, b in (("\\r\\n", "\n"), ("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        body = body.replace(a, b)
    return body.strip()


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(loose_unescape)
