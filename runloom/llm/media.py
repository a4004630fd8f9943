"""Operator 10. Media columns of progressive JPEG files."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm import jpeg
from runloom.llm.base import small_batches, table, text_runs


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_runs(batches, 1, 1 << 20):
        padded = [t + bytes(-len(t) % 64 if t else 64) for t in texts]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(jpeg.encode(padded), pa.binary())], names=["_key", "n_bytes", "media"])


def store(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, n_bytes, media: the text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as the coefficients of a progressive JPEG file.

    A null text is empty; a null key stays null. Each row is stored by itself: repeated rows
    and ties have equal files, an empty table gives no rows, and no other column of docs is
    looked at.
    """
    kind = docs.schema[key].dataType.simpleString()
    return small_batches(docs).select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(_stored, f"_key {kind}, n_bytes long, media binary").withColumnRenamed("_key", key)


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string, rgb binary, shape array<int>"
_NAMES = [x.split()[0] for x in _FEATURES.split(", ")]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int32())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, files in text_runs(batches, 1, 1 << 20):
        out: list = [(None,) * len(_KINDS)] * len(files)
        some = [i for i, x in enumerate(files) if x]
        for part, frames, z, rgb in jpeg.decode([files[i] for i in some]):
            sums = rgb.sum(axis=(1, 2), dtype="int64").tolist() if frames else []
            for k, i in enumerate(part):
                i = some[i]
                stored = (len(files[i]), hashlib.sha256(files[i]).hexdigest())
                if frames is None:
                    out[i] = (None, None, None, *stored, None, "not a progressive JPEG file that can be read", None, None)
                    continue
                own = jpeg.payload(frames[k], [c[k] for c in z])
                h, w = rgb.shape[1:3]
                feature = f"{w}x{h}:" + ",".join(str(s * 1000 // (h * w)) for s in sums[k])
                digests = (None, None, None) if own is None else (len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]))
                out[i] = (*digests, *stored, feature, None, rgb[k].tobytes(), [h, w, 3])
        cols = [pa.array([x[i] for x in out], t) for i, t in enumerate(_KINDS)]
        yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(rows.columns) if i != 1), *cols], names=[*(n for i, n in enumerate(rows.schema.names) if i != 1), *_NAMES])


def read(media: DataFrame, *, key: str = "doc_id", column: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each file: key, keep's columns, what the stored bytes hold, error, rgb (bytes) and shape.

    All scans are added up to coefficient arrays, transformed back, chroma is repeated to full
    resolution, and the RGB tensor is kept with its shape. The feature is the tensor's size
    and thousandths of its mean colours. payload columns are null in files that hold no
    payload. A null or empty file has nulls throughout; a file that can't be read as a
    progressive JPEG, because it is another format or broken, has an error in place of a
    feature and a tensor. Each row is read by itself, so repeated rows and ties have equal
    results, an empty table gives no rows, and no other column of media is looked at.
    """
    rows = media.select(F.col(key).alias("_key"), F.col(column).alias("_media"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    own = ", ".join(f"{c} {kinds[c]}" for c in rows.columns if c != "_media")
    out = rows.mapInArrow(_read, f"{own}, {_FEATURES}")
    return out.select(F.col("_key").alias(key), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *_NAMES)


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    return read(store(table(spark, sf_dir, "documents")), keep=("n_bytes",))
