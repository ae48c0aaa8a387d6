"""What the training-data operators share: tables between phases, text blocks and word hashes.

Words are ``[^\\x20\\x09-\\x0D]+``, found on the UTF-8 bytes. All hashing is vectorised with numpy over
blocks of whole documents, so that no Python code runs per word.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_MULTIPLIERS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, _POWER, np.uint64), dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without it, and gets
    a temporary folder; a cluster has no folder of its own that all could read."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


#: Paths stored while passing() is open.
_PASSING: list[list[str]] = []


def store(df: DataFrame) -> DataFrame:
    """Writes a phase's result as Parquet into the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for made in _PASSING:
        made.append(path)
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stored inside are deleted at its end, but for paths that have been removed from the list."""
    made: list[str] = []
    _PASSING.append(made)
    try:
        yield made
    finally:
        _PASSING.pop()
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes stored tables that no later phase reads."""
    for df in frames:
        _delete(df.sparkSession, df._stored_at)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of phases whose results are stored."""
    gc.collect()
    spark._jvm.System.gc()


def documents(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text only (null text: empty), whatever else the table has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with their text bytes and row offsets, about ``size`` each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, batch.num_rows + 1 + texts.offset)[texts.offset :]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    _give_back()


def _give_back() -> None:
    """Hands the memory that a finished task has freed back to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a block: byte spans, 64-bit hashes, and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        n = len(data)
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = offsets[(offsets > 0) & (offsets < n)]
        first[cut] = inside[cut]
        self.starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        if not len(self.starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        at = np.arange(n)
        at[: self.starts[0]] = 0
        at[self.starts[0] :] -= np.repeat(self.starts, np.diff(np.append(self.starts, n)))
        longest = int((self.ends - self.starts).max())
        powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _POWER, np.uint64), dtype=np.uint64)
        values = (_FOLDED if fold else _BYTE)[data] * powers[np.minimum(at, len(powers) - 1)]
        self.hashes = mix(np.add.reduceat(values, self.starts) + (self.ends - self.starts).astype(np.uint64))

    def of(self, row: int) -> slice:
        return slice(int(self.bounds[row]), int(self.bounds[row + 1]))

    def owners(self) -> np.ndarray:
        """Each word's row in the block."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def runs(self, k: int, second: bool = False) -> np.ndarray:
        """Hash of the k words from each word on; only those that end in the same document mean anything."""
        return runs(self.hashes, k, second)

    def whole(self, k: int) -> np.ndarray:
        """Whether k words from each start are in one document, as long as runs(k)."""
        n = max(0, len(self.hashes) - k + 1)
        return np.repeat(self.bounds[1:], np.diff(self.bounds))[:n] - np.arange(n) >= k


def runs(hashes: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * (_SECOND if second else _MULTIPLIERS)[j]
    return mix(out)


class Shingles:
    """The distinct k-word shingles of a block, sorted within each document: values, their rows, bounds by row.

    With fewer than k words a document's whole sequence is its one shingle; without words it has none.
    """

    def __init__(self, words: Words, k: int):
        rows = len(words.bounds) - 1
        sizes = np.diff(words.bounds)
        grams = words.runs(k)
        room = np.maximum(sizes - k + 1, (sizes > 0).astype(sizes.dtype))
        bounds = np.concatenate([[0], np.cumsum(room)])
        values = np.zeros(bounds[-1], np.uint64)
        for row in range(rows):
            n, at, to = int(sizes[row]), int(bounds[row]), int(bounds[row + 1])
            if n >= k:
                first = int(words.bounds[row])
                values[at:to] = np.sort(grams[first : first + to - at])
            elif n:
                values[at] = runs(words.hashes[words.of(row)], n)[0] ^ np.uint64(n)
        owner = np.repeat(np.arange(rows), room)
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = values[new], owner[new]
        self.sizes = np.bincount(self.owner, minlength=rows)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])

    def of(self, row: int) -> np.ndarray:
        return self.values[self.bounds[row] : self.bounds[row + 1]]

    def place(self) -> np.ndarray:
        """Each value's place in its document's set."""
        return np.arange(len(self.values)) - self.bounds[self.owner]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of values by row, modulo 2^64."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    found = Shingles(words, k)
    return [found.of(row) for row in range(len(found.sizes))]
