"""Operator 8. SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.base import held, small_batches, table, text_runs, written
from runloom.llm.vocabulary import PATH, SPACE, Vocabulary, load

#: Characters of a chunk; longer documents are split.
CHUNK = 1 << 15
#: Chunks whose matrices are combined in one task.
BLOCK = 256
#: Stands for a literal ▁ of the text, which no piece may match; a lone surrogate is in no text.
_LITERAL = "\ud800"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_LETTERS, _OTHERS = r"[^\W\d_¹²³]+", f"(?:[^\\w{SPACE}]|(?![0-9])[\\d_¹²³])+"
_FINE = re.compile(f"{SPACE}+(?:{_LETTERS}|[0-9]|{_OTHERS})?|{_LETTERS}|[0-9]|{_OTHERS}")
_CUT = re.compile(f"(?<=[^{SPACE}]){SPACE}")
_NONE = -(1 << 60)
_NO_PIECE = ({}, None, None)


class _Units(dict):
    """The ids of each unit, kept up to a bound. The half before stays until the next half is full, so that units that come often are never made again."""

    def __init__(self, codec: Codec, most: int):
        self.codec, self.half, self.before = codec, max(1, most // 2), {}

    def __missing__(self, u: str) -> bytes:
        got = self.before.get(u)
        if got is None:
            got = self.codec.ids_of(u)
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        if len(u) <= 64:
            self[u] = got
        return got


class Codec:
    """The best segmentation of a text into pieces by the sum of their weights, and back.

    Spaces become ▁ and one stands before the text. Weights are whole numbers (2^16 to the
    nat), so sums don't depend on the order in which they are made. A character without a
    piece is coded as its UTF-8 bytes. No piece holds a ▁ after another character, so every
    path is cut before a ▁ that follows one; what lies between two cuts is a unit, whose
    segmentation is remembered for at most `most` units. Where no piece of the vocabulary joins
    letters to other characters, or has two digits, paths are cut there too, so a word is one
    unit whatever stands behind it.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 240_000):
        self.memo = _Units(self, most)
        self.score = {}
        self.id = {}
        for i, w in vocabulary.weights.items():
            p = vocabulary.pieces[i]
            if SPACE not in p.lstrip(SPACE) and not (p.startswith(SPACE * 2) and p.strip(SPACE)):
                self.id[p], self.score[p] = i, round(w * 65536)
        self.longest = max(map(len, self.id))
        self.units = _FINE if all(map(_FINE.fullmatch, self.id)) else _UNITS
        self.trie: dict = {}  # by character: what may follow, and the score and id of the piece that ends there
        for p, w in self.score.items():
            node = self.trie
            for ch in p[:-1]:
                node = node.setdefault(ch, [{}, None, -1])[0]
            node.setdefault(p[-1], [{}, None, -1])[1:] = [w, self.id[p]]
        self.bytes, self.byte_score = vocabulary.byte_ids, round(vocabulary.byte_weight * 65536)
        self.weights = np.full(len(vocabulary.pieces), self.byte_score, dtype=np.int64)
        for p, i in self.id.items():
            self.weights[i] = self.score[p]
        of_byte = {i: bytes([b]) for b, i in self.bytes.items()}
        self.text = [of_byte.get(i, p.replace(SPACE, " ").encode("utf-8")) for i, p in enumerate(vocabulary.pieces)]

    def _raw(self, ch: str) -> bytes:
        return SPACE.encode() if ch == _LITERAL else ch.encode("utf-8")

    def paths(self, s: str, start: int, limit: int):
        """From start: the best score of a path to each place, the place before, and the piece between (-1: bytes); pieces begin before limit."""
        n = len(s)
        best, back, piece = [_NONE] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        best[start] = 0
        trie, longest = self.trie, self.longest
        for i in range(start, min(limit, n)):
            a = best[i]
            if a == _NONE:
                continue
            node, j = trie, i
            for ch in s[i : i + longest]:
                got = node.get(ch)
                if got is None:
                    break
                j += 1
                node, w, x = got
                if w is not None and a + w > best[j]:
                    best[j], back[j], piece[j] = a + w, i, x
            if s[i] not in self.score:
                w = a + self.byte_score * len(self._raw(s[i]))
                if w > best[i + 1]:
                    best[i + 1], back[i + 1], piece[i + 1] = w, i, -1
        return best, back, piece

    def ids_of(self, u: str) -> bytes:
        """The ids of a whole unit: as ids_between() of paths(), of ties the same."""
        n, longest, root = len(u), self.longest, self.trie
        best, back, piece = [0] + [_NONE] * n, [0] * (n + 1), [None] * (n + 1)
        for i in range(n):
            a, j = best[i], i + 1
            node, w, x = root.get(u[i], _NO_PIECE)
            if w is None:
                w, x = self.byte_score * len(self._raw(u[i])), None
            if a + w > best[j]:
                best[j], back[j], piece[j] = a + w, i, x
            for ch in u[j : i + longest]:
                if (got := node.get(ch)) is None:
                    break
                node, w, x = got
                j += 1
                if w is not None and a + w > best[j]:
                    best[j], back[j], piece[j] = a + w, i, x
        out: list[int] = []
        while n:
            if (x := piece[n]) is None:
                out += [self.bytes[b] for b in reversed(self._raw(u[n - 1]))]
            else:
                out.append(x)
            n = back[n]
        out.reverse()
        return array("H", out).tobytes()

    def ids_between(self, s: str, path: tuple, start: int, end: int) -> bytes:
        _, back, piece = path
        out: list[int] = []
        while end > start:
            at = back[end]
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                out += [self.bytes[x] for x in reversed(self._raw(s[at]))]
            end = at
        out.reverse()
        return array("H", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of 16 bits each; none for an empty text."""
        return self._units(prepared(" " + text)) if text else b""

    def _units(self, s: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.units.findall(s)))

    def decode(self, ids: bytes) -> bytes:
        out = b"".join(map(self.text.__getitem__, np.frombuffer(ids, dtype=np.uint16).tolist()))
        return out[1:]

    def total(self, ids: bytes) -> int:
        return int(self.weights[np.frombuffer(ids, dtype=np.uint16)].sum())

    # --- chunks: a state is how far the piece over a chunk's border reaches into the next

    def _cuts(self, s: str, size: int) -> tuple[int, int] | None:
        """The first and last place inside the chunk where every path is cut."""
        at = [m.start() for m in _CUT.finditer(s, 0, min(len(s), size))]
        return (at[0], at[-1]) if at else None

    def transfer(self, s: str, size: int) -> np.ndarray:
        """Best score from each entering state to each leaving one; s is the chunk and what a piece may reach beyond it."""
        k = self.longest
        out = np.full((k, k), _NONE, dtype=np.int64)
        cuts = self._cuts(s, size)
        if cuts:
            first, last = cuts
            tail = np.array(self.paths(s[last:], 0, size - last)[0][size - last :][:k], dtype=np.int64)
            middle = self.total(self._units(s[first:last])) if last > first else 0
            for i in range(min(k, first + 1)):
                head = self.paths(s[:first], i, first)[0][first]
                if head > _NONE:
                    out[i, : len(tail)] = np.where(tail > _NONE, head + middle + tail, _NONE)
        else:
            for i in range(min(k, len(s) + 1)):
                if i > size:
                    break
                ends = self.paths(s, i, size)[0][size:][:k]
                out[i, : len(ends)] = ends
        return out

    def between(self, s: str, size: int, i: int, j: int) -> bytes:
        """The ids of the pieces that begin in the chunk, from state i to state j."""
        end = size + j
        cuts = self._cuts(s, size)
        if not cuts or cuts[0] < i:
            return self.ids_between(s, self.paths(s, i, size), i, end)
        first, last = cuts
        head = self.ids_between(s, self.paths(s[:first], i, first), i, first)
        tail = self.ids_between(s[last:], self.paths(s[last:], 0, size - last), 0, end - last)
        return head + self._units(s[first:last]) + tail


def prepared(text: str) -> str:
    return text.replace(SPACE, _LITERAL).replace(" ", SPACE)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best over the state between; associative, so any run of chunks can be combined first."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), _NONE)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """All matrices combined in order, by pairs, pairs of pairs and so on."""
    while len(matrices) > 1:
        pairs = [max_plus(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[2 * len(pairs) :]
    return matrices[0]


def states(matrices: list[np.ndarray], first: int = 0, last: int = 0) -> list[tuple[int, int]]:
    """The entering and leaving state of each chunk on the best path from one state to another."""
    ahead = [np.where(np.arange(len(matrices[0])) == first, 0, _NONE)[None, :]]
    for m in matrices:
        ahead.append(max_plus(ahead[-1], m))
    j, out = last, []
    for v, m in zip(ahead[-2::-1], matrices[::-1], strict=True):
        i = int((v[0] + m[:, j]).argmax())
        out.append((i, j))
        j = i
    return out[::-1]


def _codec(vocabulary: Vocabulary) -> Codec:
    """One codec for all tasks of a worker, so units that one task met needn't be segmented again by the next."""
    return held(("pieces", tuple(vocabulary.pieces), vocabulary.byte_weight), lambda: Codec(vocabulary))


def _encoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for rows, texts in text_runs(batches, 0, 1 << 20):
            ids = [codec.encode(t.decode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(ids, pa.binary()), pa.array([codec.total(x) for x in ids], pa.int64())], names=[*rows.schema.names[1:], "_ids", "_total"])

    return run


def _matrices(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for rows, texts in text_runs(batches, 3, 1 << 20):
            m = [codec.transfer(prepared(t.decode("utf-8")), n).tobytes() for t, n in zip(texts, rows.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(m, pa.binary())], names=["row", "k", "m"])

    return run


def _squares(column: pa.ChunkedArray) -> list[np.ndarray]:
    flat = [np.frombuffer(x, dtype=np.int64) for x in column.to_pylist()]
    side = int(len(flat[0]) ** 0.5)
    return [x.reshape(side, side) for x in flat]


def _block(t: pa.Table) -> pa.Table:
    """The chunks of a block as one matrix."""
    t = t.sort_by("k")
    return pa.table({"row": t.column("row").slice(0, 1), "b": t.column("b").slice(0, 1), "m": pa.array([product(_squares(t.column("m"))).tobytes()], pa.binary())})


def _scan(t: pa.Table) -> pa.Table:
    """The states at the borders of a document's blocks."""
    t = t.sort_by("b")
    s = states(_squares(t.column("m")))
    return pa.table({"row": t.column("row"), "b": t.column("b"), "first": pa.array([a for a, _ in s], pa.int32()), "last": pa.array([b for _, b in s], pa.int32())})


def _within(t: pa.Table) -> pa.Table:
    """The states at the borders of a block's chunks, given those at its own."""
    t = t.sort_by("k")
    s = states(_squares(t.column("m")), t.column("first")[0].as_py(), t.column("last")[0].as_py())
    return pa.table({"row": t.column("row"), "k": t.column("k"), "i": pa.array([a for a, _ in s], pa.int32()), "j": pa.array([b for _, b in s], pa.int32())})


def _traced(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for rows, texts in text_runs(batches, 3, 1 << 20):
            ids = [codec.between(prepared(t.decode("utf-8")), n, i, j) for t, n, i, j in zip(texts, *(rows.column(c).to_pylist() for c in (2, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(ids, pa.binary()), pa.array([codec.total(x) for x in ids], pa.int64())], names=["row", "k", "_ids", "_total"])

    return run


def _joined(t: pa.Table) -> pa.Table:
    t = t.sort_by("k")
    return pa.table({"row": t.column("row").slice(0, 1), "_ids": pa.array([b"".join(t.column("_ids").to_pylist())], pa.binary()), "_total": pa.array([sum(t.column("_total").to_pylist())], pa.int64())})


def encode(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), vocabulary: str = PATH, chunk: int = CHUNK) -> DataFrame:
    """One row for each document: key, keep's columns, ids (binary, 16 bits each), n_tokens, total.

    The ids are those of a segmentation with the greatest sum of unigram weights; total is the
    sum in 2^-16 nats. A document of up to `chunk` characters is coded in one piece. A longer
    one is split into chunks, rows of a written table that may lie anywhere: each gives a
    matrix of best scores from every state at its front border to every state at its end.
    Blocks of these are combined, each by itself, as the max-plus product is associative; a
    document's few block matrices then fix the states at the blocks' borders, each block those
    at its chunks' borders, and each chunk is backtraced by itself between two states. No task
    holds more than a block of matrices, or a document's blocks. Of several best
    segmentations any may come out, but equal texts have equal ids.

    The vocabulary's file has ranks as scores; the weights are made from these (Vocabulary),
    so ids may differ from those of the file's own merges.

    A null text has null ids, an empty one none. Null keys and repeated rows are coded each by
    itself. An empty table gives no rows. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    codec_data = load(vocabulary)
    model = spark.sparkContext.broadcast(codec_data)
    reach = max(map(len, codec_data.pieces)) - 1
    chunk = max(chunk, reach + 1)  # a piece reaches into the next chunk only
    others = [F.col(key).alias("_key"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).isNull().alias("_null")]
    rows = small_batches(docs).select(F.col(text).alias("_text"), *others)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = rows.columns[1:]
    own = ", ".join(f"{c} {kinds[c]}" for c in names)
    short = rows.where(F.col("_text").isNull() | (F.length("_text") <= chunk)).mapInArrow(_encoded(model), f"{own}, _ids binary, _total long")
    n = F.length("_text") + 1
    giant = rows.where(F.length("_text") > chunk).withColumn("row", F.monotonically_increasing_id())
    parts = giant.select("row", *names, n.alias("n"), F.concat(F.lit(" "), F.col("_text")).alias("s"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).alias("k"))
    parts = parts.select("row", "k", F.least(F.lit(chunk), F.col("n") - F.col("k") * chunk).cast("int").alias("size"), F.substring("s", F.col("k") * chunk + 1, F.lit(chunk + reach)).alias("part"), *[F.when(F.col("k") == 0, F.col(c)).alias(c) for c in names])
    parts = written(parts.repartition("row", "k"), "chunks")
    at = parts.select("row", "k", "size", "part")
    m = written(at.mapInArrow(_matrices(model), "row long, k int, m binary").withColumn("b", F.floor(F.col("k") / BLOCK).cast("int")), "matrices")
    blocks = m.groupBy("row", "b").applyInArrow(_block, "row long, b int, m binary").groupBy("row").applyInArrow(_scan, "row long, b int, first int, last int")
    via = m.join(blocks, ["row", "b"]).select("row", "b", "k", "m", "first", "last").groupBy("row", "b").applyInArrow(_within, "row long, k int, i int, j int")
    traced = at.join(via, ["row", "k"]).select("row", "k", "size", "part", "i", "j").mapInArrow(_traced(model), "row long, k int, _ids binary, _total long")
    whole = traced.groupBy("row").applyInArrow(_joined, "row long, _ids binary, _total long")
    long = parts.where("k = 0").select("row", *names).join(whole, "row").select(*names, "_ids", "_total")
    out = short.unionByName(long)
    ids = F.when(~F.col("_null"), F.col("_ids"))
    return out.select(F.col("_key").alias(key), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], ids.alias("ids"), (F.octet_length(ids) / 2).cast("long").alias("n_tokens"), F.when(~F.col("_null"), F.col("_total")).alias("total"))


def _decoded(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for rows, ids in text_runs(batches, 0, 1 << 20):
            col = rows.column(0)
            texts = pa.array([codec.decode(x) if ok else None for x, ok in zip(ids, col.is_valid().to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], texts.cast(pa.string())], names=[*rows.schema.names[1:], "_text"])

    return run


def decode(coded: DataFrame, *, key: str = "doc_id", ids: str = "ids", keep: tuple[str, ...] = (), vocabulary: str = PATH) -> DataFrame:
    """One row for each: key, keep's columns, text. Null ids give a null text, empty ones an empty text. Repeated rows and null keys are decoded each by itself; an empty table gives no rows; other columns are not looked at."""
    model = coded.sparkSession.sparkContext.broadcast(load(vocabulary))
    rows = coded.select(F.col(ids).alias("_ids"), F.col(key).alias("_key"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(_decoded(model), ", ".join([f"{c} {kinds[c]}" for c in rows.columns[1:]] + ["_text string"]))
    return out.select(F.col("_key").alias(key), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias("text"))


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    coded = encode(docs, keep=("text_sha256",))
    coded = coded.withColumn("ids_sha256", F.sha2("ids", 256))
    back = decode(coded, keep=("n_tokens", "total", "ids_sha256", "text_sha256"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return back.select("doc_id", "n_tokens", "total", "ids_sha256", F.length("text").cast("long").alias("n_chars"), digest.alias("decoded_sha256"), digest.eqNullSafe(F.col("text_sha256")).alias("round_trip"))
