"""Operator 11. Conversation structure repair: cheapest edits by a time-major tensor of backward costs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.base import small_batches, table

#: States after what was kept so far: nothing, a system turn, a user turn, an assistant turn;
#: NONE has no way on. The roles wanted are `(s?(ua)+)?`.
START, SYSTEM, USER, ASSISTANT, NONE = range(5)
#: The state that a kept turn leads to, by the initial of its role (s, u, a, any other) and the state before.
KEPT = np.array([[SYSTEM, NONE, NONE, NONE], [USER, USER, NONE, USER], [NONE, NONE, ASSISTANT, NONE], [NONE] * 4])
#: The state that an inserted turn or one with a new role leads to: from each there is one.
FORCED = np.array([USER, USER, ASSISTANT, USER])
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
_FAR = 1 << 40
#: The costs of ending in each state: inserts up to the next assistant turn.
_ENDS = np.array([0, 2 * INSERT, INSERT, 0, _FAR])
_NEW_ROLES = ["user", "assistant"]
#: Turns times conversations of one tensor.
_CELLS = 1 << 18


def backward(initials: np.ndarray, lengths: np.ndarray, cut: np.ndarray, must: np.ndarray) -> np.ndarray:
    """costs[t, i, q]: the least cost of conversation i from turn t on, being in state q. All arguments but lengths are time-major [turn, conversation]."""
    turns, n = initials.shape
    costs = np.empty((turns + 1, n, 5), dtype=np.int64)
    costs[turns] = _ENDS
    rows = np.arange(n)[:, None]
    for t in range(turns - 1, -1, -1):
        then = costs[t + 1]
        extra = cut[t][:, None] * TRUNCATED
        stay = np.where(must[t][:, None], _FAR, np.minimum(then[rows, KEPT[initials[t]]], then[:, FORCED] + REROLE) + extra)
        once = np.minimum(then[:, :4] + DELETE, stay)
        now = np.minimum(np.minimum(once, once[:, FORCED] + INSERT), once[:, FORCED[FORCED]] + 2 * INSERT)
        costs[t, :, :4] = np.where((t < lengths)[:, None], now, then[:, :4])
        costs[t, :, 4] = _FAR
    return costs


def traced(costs: np.ndarray, initials: np.ndarray, lengths: np.ndarray, cut: np.ndarray, must: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """edits[t, i, k], a byte of D, I, K, R or 0, and the states after each: up to two inserts before a turn and what happens to it, the least letters first.

    A letter leads from a state to one other only, so the first letters that keep to the
    least cost are the least string.
    """
    turns, n = initials.shape
    edits, states = np.zeros((turns + 1, n, 3), dtype=np.uint8), np.zeros((turns + 1, n, 3), dtype=np.int8)
    rows, state = np.arange(n), np.full(n, START)
    for t in range(turns + 1):
        inside, open_ = t < lengths, t <= lengths
        for k in range(3):
            here = costs[t, rows, state]
            forced = FORCED[state]
            insert = open_ & (here == costs[t, rows, forced] + INSERT)
            if t < turns:
                then = costs[t + 1]
                delete = open_ & inside & (here == then[rows, state] + DELETE)
                kept = KEPT[initials[t], state]
                keep = open_ & inside & ~must[t] & (here == then[rows, kept] + cut[t] * TRUNCATED)
                rerole = open_ & inside & ~must[t] & (here == then[rows, forced] + cut[t] * TRUNCATED + REROLE)
            else:
                delete = keep = rerole = np.zeros(n, dtype=bool)
                kept = forced
            letter = np.select([delete, insert, keep, rerole], [ord(x) for x in "DIKR"], 0)
            state = np.select([letter == ord("K"), (letter == ord("I")) | (letter == ord("R"))], [kept, forced], state)
            edits[t, :, k], states[t, :, k] = letter, state
            open_ = letter == ord("I")
    return edits, states


def _flags(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each turn the number of its role's initial, and whether its first fault is to be blank, a duplicate, truncated."""
    first = pc.utf8_slice_codeunits(roles, 0, 1)
    initials = np.select([np.asarray(pc.equal(first, x)) for x in "sua"], [0, 1, 2], 3)
    blank = ~np.asarray(pc.match_substring_regex(texts, r"[^\x20\x09-\x0D]"))
    again = pd.DataFrame({"conv": conv, "role": roles.to_pandas(), "text": texts.to_pandas()}).duplicated().to_numpy() & ~blank
    cut = ~np.asarray(pc.match_substring_regex(texts, r"[.!?][\x20\x09-\x0D]*\z")) & ~blank & ~again
    return initials, blank, again, cut


def _counts(conv: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(conv[which], minlength=n)


def _gaps(conv: np.ndarray, turns: pa.Array, n: int) -> np.ndarray:
    """Missing turn numbers of each conversation, whose turns stand in order."""
    some = np.asarray(pc.is_valid(turns))
    at, of = np.asarray(pc.fill_null(turns, 0))[some], conv[some]
    out = np.zeros(n, dtype=np.int64)
    if len(of):
        new = np.r_[True, of[1:] != of[:-1]]
        distinct = _counts(of, new | np.r_[True, at[1:] != at[:-1]], n)
        firsts, lasts = np.flatnonzero(new), np.flatnonzero(np.r_[new[1:], True])
        out[of[firsts]] = at[lasts] - at[firsts] + 1
        out -= distinct
    return out


def _buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of conversations of like length: the longest has under twice the turns of the shortest, and all padded up make a bounded tensor."""
    order = np.argsort(lengths, kind="stable")
    kinds = np.frexp(lengths[order])[1]
    for part in np.split(order, np.flatnonzero(kinds[1:] != kinds[:-1]) + 1):
        step = max(1, _CELLS // (int(lengths[part[-1]]) + 1)) if len(part) else 1
        for a in range(0, len(part), step):
            yield part[a : a + step]


_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        lengths = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        flat = lists.flatten()
        turns, roles, texts = (flat.field(i) for i in range(3))
        n, starts = len(lengths), np.cumsum(np.r_[0, lengths])
        conv = np.repeat(np.arange(n), lengths)
        initials, blank, again, cut = _flags(conv, roles, texts)
        pairs = 4 * initials[:-1] + initials[1:]
        illegal = np.r_[False, (conv[1:] == conv[:-1]) & ~np.isin(pairs, [1, 6, 9])] if len(conv) else np.zeros(0, dtype=bool)
        tallies = [_gaps(conv, turns, n), *(_counts(conv, x, n) for x in (blank, again, cut, illegal))]
        words = pa.array([*_NEW_ROLES, ""], pa.string())
        for part in _buckets(lengths):
            size, longest = lengths[part], int(lengths[part].max())
            inside = np.arange(longest)[:, None] < size
            at = np.where(inside, starts[part] + np.arange(longest)[:, None], 0)
            grid = lambda x: x[at] if len(x) else np.zeros(at.shape, dtype=x.dtype)  # noqa: B023, E731
            given = grid(initials), size, grid(cut), grid(blank | again)
            costs = backward(*given)
            edits, states = traced(costs, *given)
            letters, after = edits.transpose(1, 0, 2), states.transpose(1, 0, 2)
            i, t, k = np.nonzero(letters)
            codes = letters[i, t, k]
            ends = np.cumsum(_counts(i, np.ones(len(i), dtype=bool), len(part)))
            audit = [codes[a:b].tobytes().decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            stays = codes != ord("D")
            i, t, k, codes = i[stays], t[stays], k[stays], codes[stays]
            source = starts[part][i] + t
            # roles and texts of turns that stay as they are come from the turns, new ones from `words`
            own, new = len(roles), after[i, t, k].astype(np.int64) - USER
            role = pa.concat_arrays([roles, words]).take(pa.array(np.where(codes == ord("K"), source, own + new)))
            text = pa.concat_arrays([texts, words]).take(pa.array(np.where(codes == ord("I"), own + 2, source)))
            bounds = np.cumsum(np.r_[0, _counts(i, np.ones(len(i), dtype=bool), len(part))])
            turned = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([role, text], names=["role", "text"]))
            cols = [batch.column(0).take(pa.array(part)), *(pa.array(x[part], pa.int64()) for x in tallies), pa.array(costs[0, :, START]), pa.array(audit, pa.string()), turned]
            yield pa.RecordBatch.from_arrays(cols, names=["_key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"])


def repair(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """One row for each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    Turns stand by turn, nulls first, ties by role, then text. The first fault of a turn
    counts: blank (white space only), duplicate (role and text seen before), truncated (it
    doesn't end in . ! or ?). gaps: missing turn numbers; illegal: neighbours whose roles'
    initials aren't su, ua or au.

    Cheapest edits make the initials of the roles `(s?(ua)+)?`: keep 0, another role (user or
    assistant) 2, delete 3 (blank and duplicate turns must go), insert an empty user or
    assistant turn 2, and 1 more for each truncated turn that isn't deleted. audit has the
    edits' initials D, I, K, R in order, the least string of the cheapest; repaired the turns
    that result. A conversation without turns has zeros and empty results.

    A null role or text is one space, so such a text is blank; an empty role has no initial and
    can't be kept. present: rows where it isn't true only name their conversation. Rows of a
    null conversation form one; repeated rows are duplicates; an empty table gives no rows;
    other columns of df are not looked at. Conversations are costed and traced in step, those
    of like length together; one conversation is one value, of any number of turns.
    """
    kind = df.schema[conv].dataType.simpleString()
    one = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    turns = df.groupBy(F.col(conv).alias("_key")).agg(F.sort_array(F.collect_list(one if present is None else F.when(present, one))).alias("_turns"))
    return small_batches(turns).mapInArrow(_repaired, f"_key {kind}, {_OUT}").withColumnRenamed("_key", conv)


def damaged(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) with the query's damage, which crc32 of `conv_id:turn` settles; nulls are one space."""
    space = lambda c: F.coalesce(c, F.lit(" "))
    kind = F.crc32(F.concat(space(F.col("conv_id").cast("string")), F.lit(":"), space(F.col("turn").cast("string"))).cast("binary")) % 20
    rows = df.select("conv_id", "turn", space(F.col("role")).alias("role"), space(F.col("text")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), times.alias("copy"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    out = repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).drop("repaired")


def _crc_sql(text: str) -> str:
    """crc32 of an ASCII text in SQL, four bits at a time."""
    steps = [0]
    for i in range(1, 16):
        c = i
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        steps.append(c)
    nibbles = f"[{', '.join(f'{x}::BIGINT' for x in steps)}]"
    half = lambda c: f"xor({c} >> 4, {nibbles}[CAST({c} & 15 AS INT) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: {half(half('xor(c, b)'))}), 4294967295)"


OP11_SQL = (
    r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hashed AS (
  SELECT *, """
    + _crc_sql("k")
    + r""" % 20 AS h FROM raw
), damaged AS (
  SELECT cid, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (VALUES (0), (1)) AS copies(c) WHERE h <> 0 AND (c = 0 OR h = 3)
), placed AS (
  SELECT *, substr(role, 1, 1) AS x, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM damaged
), flagged AS (
  SELECT *, lag(x) OVER (PARTITION BY cid ORDER BY pos) || x AS pair, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY cid, role, text ORDER BY pos) > 1 AS seen, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS unended
  FROM placed
), f AS (
  SELECT *, blank OR seen AS must, NOT blank AND NOT seen AND unended AS cut, CASE WHEN NOT blank AND NOT seen AND unended THEN 1 ELSE 0 END AS extra FROM flagged
), sizes AS (
  SELECT r.cid, any_value(r.conv_id) AS conv_id, coalesce(any_value(g.n), 0) AS n, coalesce(any_value(g.gaps), 0) AS gaps, coalesce(any_value(g.blank), 0) AS blank,
    coalesce(any_value(g.duplicate), 0) AS duplicate, coalesce(any_value(g.truncated), 0) AS truncated, coalesce(any_value(g.illegal), 0) AS illegal
  FROM raw r LEFT JOIN (
    SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
      count(*) FILTER (NOT blank AND seen) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY cid) g USING (cid)
  GROUP BY r.cid
), back AS (
  SELECT cid, n AS pos, 0 AS c0, 4 AS cs, 2 AS cu, 0 AS ca FROM sizes
  UNION ALL
  SELECT cid, pos, least(n0, nu + 2, na + 4), least(ns, nu + 2, na + 4), least(nu, na + 2), least(na, nu + 2) FROM (
    SELECT b.cid, f.pos,
      least(b.c0 + 3, CASE WHEN must THEN 99999999 WHEN x = 'u' THEN b.cu WHEN x = 's' THEN least(b.cs, b.cu + 2) ELSE b.cu + 2 END + extra) AS n0,
      least(b.cs + 3, CASE WHEN must THEN 99999999 WHEN x = 'u' THEN b.cu ELSE b.cu + 2 END + extra) AS ns,
      least(b.cu + 3, CASE WHEN must THEN 99999999 WHEN x = 'a' THEN b.ca ELSE b.ca + 2 END + extra) AS nu,
      least(b.ca + 3, CASE WHEN must THEN 99999999 WHEN x = 'u' THEN b.cu ELSE b.cu + 2 END + extra) AS na
    FROM back b JOIN f ON f.cid = b.cid AND f.pos = b.pos - 1)
), v AS (
  SELECT b.cid, b.pos, q, [c0, cs, cu, ca][q + 1] AS c, CASE WHEN q = 2 THEN 3 ELSE 2 END AS forced, CASE WHEN q = 2 THEN ca ELSE cu END AS cf,
    must, extra, role, text, CASE WHEN x = 's' AND q = 0 THEN 1 WHEN x = 'u' AND q <> 2 THEN 2 WHEN x = 'a' AND q = 2 THEN 3 END AS kept
  FROM back b CROSS JOIN (VALUES (0), (1), (2), (3)) AS states(q) LEFT JOIN f ON f.cid = b.cid AND f.pos = b.pos
), moves AS (
  SELECT v.*, CASE WHEN v.c = d.c + 3 THEN 'D' WHEN v.c = v.cf + 2 THEN 'I' WHEN NOT v.must AND v.c = k.c + v.extra THEN 'K' WHEN NOT v.must THEN 'R' END AS edit
  FROM v LEFT JOIN v d ON d.cid = v.cid AND d.pos = v.pos + 1 AND d.q = v.q LEFT JOIN v k ON k.cid = v.cid AND k.pos = v.pos + 1 AND k.q = v.kept
), walk AS (
  SELECT cid, CAST(0 AS BIGINT) AS pos, 0 AS q, 0 AS n, '' AS edit, CAST(NULL AS VARCHAR) AS line FROM sizes
  UNION ALL
  SELECT w.cid, w.pos + CASE WHEN m.edit = 'I' THEN 0 ELSE 1 END, CASE m.edit WHEN 'D' THEN m.q WHEN 'K' THEN m.kept ELSE m.forced END, w.n + 1, m.edit,
    CASE m.edit WHEN 'K' THEN m.role || ':' || m.text WHEN 'R' THEN ['user', 'assistant'][m.forced - 1] || ':' || m.text WHEN 'I' THEN ['user', 'assistant'][m.forced - 1] || ':' END
  FROM walk w JOIN moves m ON m.cid = w.cid AND m.pos = w.pos AND m.q = w.q WHERE m.edit IS NOT NULL
)
SELECT s.conv_id, any_value(s.gaps) AS gaps, any_value(s.blank) AS blank, any_value(s.duplicate) AS duplicate, any_value(s.truncated) AS truncated, any_value(s.illegal) AS illegal,
  CAST(any_value(b.c0) AS BIGINT) AS cost, string_agg(w.edit, '' ORDER BY w.n) AS audit, sha256(coalesce(string_agg(w.line, chr(10) ORDER BY w.n), '')) AS repaired_sha256
FROM sizes s JOIN back b ON b.cid = s.cid AND b.pos = 0 JOIN walk w ON w.cid = s.cid
GROUP BY s.cid, s.conv_id
"""
)
