"""What the corpus operators share: row batches of bounded bytes, word hashes, size-checked broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from runloom.session import broadcast_if_small, bytes_of, written  # noqa: F401

GOLD = np.uint64(0x9E3779B97F4A7C15)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_small(df: DataFrame, rows: int, name: str = "table", each: int = 1 << 15) -> DataFrame:
    """written(), for a table of at most `rows` rows: a file for each 32,768 of them, and never more than df has partitions.

    Many steps over small tables would else write a file for each shuffle partition.
    """
    return written(df.coalesce(max(1, -(-rows // each))), name)


def text_runs(batches: Iterator[pa.RecordBatch], text: int, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts take about `most` bytes (one row at least), with these as UTF-8; null is empty."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(text).cast(pa.binary())
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a), [x or b"" for x in col.slice(a, b - a).to_pylist()]
    _give_back()


def _give_back() -> None:
    """Hands freed memory to the system: workers outlive their tasks, and idle ones would keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """What make() gives, kept for the later tasks of this worker until a task asks for something else: one model at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def small_batches(df: DataFrame, rows: int = 2000, most: int = 4 << 20) -> DataFrame:
    """df; its session sends batches of at most so many rows and about so many bytes to Python, or of what was set if that is less."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    now = df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= most:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all others (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Two independent 64-bit hashes of each word; words are numbered as they come and forgotten between calls once there are more than `most`."""

    def __init__(self, most: int = 150_000):
        self.most = most
        self.table = np.zeros((2, 1 << 16), dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i >= self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        self.table[0, i] = xxhash.xxh3_64_intdigest(word)
        self.table[1, i] = xxhash.xxh3_64_intdigest(word, 1)
        self[word] = i
        return i

    def _numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.clear()
        ends = np.cumsum([0, *map(len, texts)])
        get = self.__getitem__
        return np.fromiter((i for words in texts for i in map(get, words)), dtype=np.int32, count=int(ends[-1])), ends

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of all texts, and where each text begins and ends in them."""
        ids, ends = self._numbers(texts)
        return self.table[0][ids], ends

    def both(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As of(), with the second hashes too."""
        ids, ends = self._numbers(texts)
        return self.table[0][ids], self.table[1][ids], ends
