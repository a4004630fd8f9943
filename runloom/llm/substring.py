"""Operator 9. Substring dedup: a count-min prefilter, then exact groups of the windows that it takes for repeated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.base import WordHashes, broadcast_if_small, held, mix, small_batches, table, text_runs, written

WINDOW = 20
#: Windows that a task gathers before it emits them; bytes of text whose words it holds at a time.
BLOCK = 2 << 20
RUN = 1 << 19
_BASE = np.uint64(0xA0761D6478BD642F | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NULL_ID = np.iinfo(np.int64).min


def _pack(x: np.ndarray) -> bytes:
    """Unsigned words as byte planes under zstd; for ascending ones pass their differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpack(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.zeros(1, dtype=x.dtype))


class _Powers:
    def __init__(self) -> None:
        self.n = 0

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n - 1, _BASE)]))
                self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n - 1, _INVERSE)]))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def window_hashes(words: WordHashes, texts: list[bytes], window: int, second: bool = False):
    """For each window of each text: its hash (with `second`, another of 32 bits), its text's number, its start.

    One running sum for all texts: a window's polynomial is a difference of two prefixes,
    divided by a power of the base (odd, so it has an inverse). The other hash comes from
    independent hashes of the words, so words that collide in one don't in the other.
    """
    split = [t.split() for t in texts]
    if second:
        h, other, ends = words.both(split)
    else:
        h, ends = words.of(split)
    n = np.maximum(np.diff(ends) - window + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    start = np.arange(len(doc)) - np.repeat(first, n)
    at = start + np.repeat(ends[:-1], n)
    up, down = _POWERS.to(len(h) + 1)
    out = []
    for k in range(1 + second):
        w = other if k else h
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)])])
        x = mix((total[at + window] - total[at]) * down[at])
        out.append((x >> np.uint64(32)).astype(np.uint32) if k else x)
    return (*out, doc, start)


def _sketch(width: int, slices: int, window: int):
    """Each task's counts of cells, the high `width` bits of a window's hash; 2 stands for more. A row for each slice of the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, n = held(("words",), WordHashes), np.empty(BLOCK, np.uint64), 0

        def twice(c: np.ndarray) -> np.ndarray:
            return c if len(c) <= 2 else c[np.concatenate([[True, True], c[2:] != c[:-2]])]

        def rows(c: np.ndarray):
            c.sort()
            c >>= np.uint64(64 - width)
            cut = np.searchsorted(c, np.arange(slices + 1, dtype=np.uint64) << np.uint64(width - slices.bit_length() + 1))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([_pack(_steps(twice(c[cut[i] : cut[i + 1]]))) for i in some], pa.binary())], names=["slice", "cells"])

        for _, texts in text_runs(batches, 0, RUN):
            x = window_hashes(words, texts, window)[0]
            while len(x):
                part, x = x[: BLOCK - n], x[BLOCK - n :]
                block[n : n + len(part)] = part
                n += len(part)
                if n == BLOCK:
                    yield from rows(block)
                    n = 0
        if n:
            yield from rows(block[:n])

    return run


def _merged(width: int, slices: int, bits: int):
    """The counts of a slice over all tasks, added; its part of the filter has a bit for each range of cells with a count of 2 or more."""

    def run(t: pa.Table) -> pa.Table:
        k = t.column("slice")[0].as_py()
        c = np.sort(np.concatenate([np.cumsum(_unpack(b.as_py(), np.uint64), dtype=np.uint64) for b in t.column("cells")]))
        c = c[1:][c[1:] == c[:-1]] >> np.uint64(width - bits)
        part = np.zeros((1 << bits) // slices, dtype=np.uint8)
        part[(c - np.uint64(k * len(part))).astype(np.int64)] = 1
        return pa.table({"slice": pa.array([k], pa.int32()), "part": pa.array([zstandard.ZstdCompressor(level=1).compress(np.packbits(part).tobytes())], pa.binary())})

    return run


_WIRE = "slice int, flagged boolean, ids binary, marks binary, docs binary, starts binary, h1 binary, h2 binary"


def _suspects(parts, bits: int, groups: int, window: int):
    """Windows whose bit is set, with 96 bits of hash. In each block the first of equal ones goes to its slice, the others are repeats for sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, got, n = held(("words",), WordHashes), [], 0
        flt = parts.value

        def wire(slice_of, flagged, d, s, a, b, ids, marks):
            order = np.argsort(slice_of, kind="stable")
            cut = np.searchsorted(slice_of[order], np.arange(groups + 1))
            cols: list[list] = [[] for _ in range(8)]
            for i in np.flatnonzero(np.diff(cut)):
                own = order[cut[i] : cut[i + 1]]
                used, to = np.unique(d[own], return_inverse=True)
                row = (int(i), flagged, ids[used].tobytes(), marks[used].tobytes(), _pack(to.astype(np.uint32)), _pack(s[own].astype(np.uint32)), None if flagged else _pack(_steps(a[own])), None if flagged else _pack(b[own]))
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _WIRE.split(", ")])

        def rows():
            ids, marks = np.concatenate([x[4] for x in got]), np.concatenate([x[5] for x in got])
            base = np.cumsum([0, *(len(x[4]) for x in got)]).astype(np.uint32)
            a, b, s = (np.concatenate([x[i] for x in got]) for i in (0, 1, 3))
            d = np.concatenate([x[2] + o for x, o in zip(got, base, strict=False)])
            got.clear()
            order = np.lexsort((s, ids[d], b, a))
            a, b, d, s = a[order], b[order], d[order], s[order]
            del order
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            first = new | ((ids[d] == ids[d[lead]]) & (s == s[lead]))  # a repeated row is as early as the other
            yield from wire((a[first] >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), False, d[first], s[first], a[first], b[first], ids, marks)
            if not first.all():
                late = ~first
                yield from wire((mix(marks[d[late]].view(np.uint64)) % np.uint64(groups)).astype(np.int64), True, d[late], s[late], a, b, ids, marks)

        for batch, texts in text_runs(batches, 2, RUN):
            a, b, d, s = window_hashes(words, texts, window, True)
            at = (a >> np.uint64(64 - bits)).astype(np.int64)
            on = np.flatnonzero((flt[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            if len(on):
                # copies, as views of two columns would keep the texts of all batches until the block is full
                ids, marks = np.array(pa.compute.fill_null(batch.column(0), _NULL_ID)), np.array(batch.column(1))
                got.append((a[on], b[on], d[on].astype(np.uint32), s[on].astype(np.uint32), ids, marks))
                n += len(on)
            if n >= BLOCK // 2:
                yield from rows()
                n = 0
        if n:
            yield from rows()

    return run


def _resolved(t: pa.Table) -> pa.Table:
    """Of a slice's windows, all but the earliest of each hash; and the repeats that came along."""
    out: list[tuple] = []
    own: list[tuple] = []
    for r in t.to_pylist():
        ids, marks = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["marks"], np.int64)
        d, s = _unpack(r["docs"], np.uint32), _unpack(r["starts"], np.uint32)
        if r["flagged"]:
            out.append((ids[d], marks[d], s))
        else:
            own.append((ids[d], marks[d], s, np.cumsum(_unpack(r["h1"], np.uint64), dtype=np.uint64), _unpack(r["h2"], np.uint32)))
    if own:
        i, m, s, a, b = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.lexsort((s, i, b, a))
        i, m, s, a, b = i[order], m[order], s[order], a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = ~(new | ((i == i[lead]) & (s == s[lead])))
        out.append((i[late], m[late], s[late]))
    i, m, s = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((s, m, i))
    i, m, s = i[order], m[order], s[order]
    cut = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (m[1:] != m[:-1])])) if len(i) else np.zeros(0, np.int64)
    parts = [_pack(_steps(x)) for x in np.split(s, cut[1:])] if len(cut) else []
    return pa.table({"id": pa.array(i[cut]), "mark": pa.array(m[cut]), "starts": pa.array(parts, pa.binary())})


def _runs(window: int):
    """The starts of a document as runs of words: pairs (first, after last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for parts in batch.column(2).to_pylist():
                s = np.sort(np.concatenate([np.cumsum(_unpack(b, np.uint32), dtype=np.uint32) for b in parts])).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + window]))
                packed.append(np.stack([s[cut], s[np.concatenate([cut[1:], [len(s)]]) - 1] + window], axis=1).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "mark", "runs"])

    return run


def _cut(drop: int):
    """What stays of each text; of the columns runs, text and others, all from number `drop` on come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_runs(batches, 1, RUN):
            n, gone, kept = [], [], []
            for text, runs in zip(texts, rows.column(0).to_pylist(), strict=True):
                words = text.split()
                n.append(len(words))
                if runs:
                    stay = np.ones(len(words), dtype=bool)
                    for a, b in np.frombuffer(runs, np.uint32).reshape(-1, 2).tolist():
                        stay[a:b] = False
                    words = [w for w, x in zip(words, stay.tolist(), strict=True) if x]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*rows.columns[drop:], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*rows.schema.names[drop:], "_n_words", "_n_removed", "_kept"])

    return run


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW) -> DataFrame:
    """One row for each document: key, the columns named in keep, n_words, n_removed, kept.

    Each word is removed that lies in a window of 20 words whose sequence also starts earlier
    (smaller key, or same document and earlier start); kept has the others, joined by a
    space. Windows are those of the input texts.

    First pass: every task counts its windows in cells of a count-min sketch (one row, as
    wide as the corpus asks for, sent as sorted cells); the counts are added slice by slice,
    and what has 2 or more, an overestimate, becomes a bit filter of at most 2^30 bits, the
    only thing that is broadcast. Second pass: only windows with their bit set go on, with 96
    bits of hash from two independent hashes of each word, and equal ones are grouped. A task sends one of equal windows at most, so a
    passage that a third of all rows share costs a row for each task. Beyond the filter's
    bound more windows pass it, and none is lost.

    A null text has no words. A null key is before all others. Rows that repeat key and text
    are equally early. An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    windows = max(1024, size // 6).bit_length()
    width, bits = min(48, windows + 5), min(30, max(16, windows + 1))
    slices = 1 << min(bits - 3, max(9, windows - 20))
    groups = 1 << max(6, windows - 22)
    counted = small_batches(docs).select(F.col(text)).mapInArrow(_sketch(width, slices, window), "slice int, cells binary")
    merged = counted.groupBy("slice").applyInArrow(_merged(width, slices, bits), "slice int, part binary")
    flt = np.zeros((1 << bits) // 8, dtype=np.uint8)
    share = len(flt) // slices
    for r in merged.toLocalIterator():
        flt[r["slice"] * share : (r["slice"] + 1) * share] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["part"])), np.uint8)
    parts = spark.sparkContext.broadcast(flt)

    marked = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    found = marked.mapInArrow(_suspects(parts, bits, groups, window), _WIRE)
    late = found.groupBy("slice").applyInArrow(_resolved, "id long, mark long, starts binary")
    runs = late.groupBy("id", "mark").agg(F.collect_list("starts").alias("starts")).mapInArrow(_runs(window), "id long, mark long, runs binary")
    runs = broadcast_if_small(written(runs, "runs"))
    whole = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(int(_NULL_ID))).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("_text"), F.col(key).alias("_key"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep) if c != text])
    held_as = ["_text" if c == text else f"_k{i}" for i, c in enumerate(keep)]
    j = whole.join(runs, ["id", "mark"], "left").select("runs", "_text", "_key", *[c for c in held_as if c != "_text"])
    drop = 1 if text in keep else 2
    kinds = {f.name: f.dataType.simpleString() for f in j.schema}
    out = j.mapInArrow(_cut(drop), ", ".join([f"{c} {kinds[c]}" for c in j.columns[drop:]] + ["_n_words long", "_n_removed long", "_kept string"]))
    return out.select(F.col("_key").alias(key), *[F.col(h).alias(c) for h, c in zip(held_as, keep, strict=True)], F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept"))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS s FROM d, unnest(range(1, len(w) - 18)) t(i) WHERE len(w) >= 20
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM p
), c AS (
  SELECT DISTINCT doc_id, j FROM r, unnest(range(i, i + 20)) t(j) WHERE k > 1
), a AS (
  SELECT d.doc_id, u.j, d.w[u.j] AS x FROM d, unnest(range(1, len(w) + 1)) u(j)
), k AS (
  SELECT a.doc_id, count(*) AS n, string_agg(a.x, ' ' ORDER BY a.j) AS t FROM a ANTI JOIN c ON a.doc_id = c.doc_id AND a.j = c.j GROUP BY a.doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
