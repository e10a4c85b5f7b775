"""Shared helpers: inputs, the shared scratch folder, and vectorised word hashing.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D; UTF-8 continuation
bytes never fall in that set, so bytes and code points give the same words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that are hashed at once; a longer document is one block of its own.
BLOCK_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_WS] = 0
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD1342543DE82EF95)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_P_BACK = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash's base, from the first, and of its inverse, from the zeroth."""
    if n > 2 * BLOCK_BYTES:  # one very long text: not kept
        power = np.cumprod(np.full(n, _P))
        return power, np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _P_BACK)]))
    if n > len(_POWERS[0]):
        _POWERS[:] = [np.cumprod(np.full(2 * BLOCK_BYTES, _P)), np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * BLOCK_BYTES - 1, _P_BACK)]))]
    return _POWERS[0], _POWERS[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/recordweave-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/recordweave-{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than this share of all rows is hot; there are fewer than its inverse, so their rows may be broadcast.
HOT_SHARE = 1e-4


def spread_join(rows: DataFrame, found: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, which has one row a key and in ``count`` how many of the ``total`` rows share it.

    Hot keys have at most 1 / HOT_SHARE rows in ``found`` whatever the data, and are
    broadcast, so their rows stay where they are; all others meet by a shuffle.
    ``rows`` should be a table, as it is read twice. ``count`` is dropped.
    """
    least = max(1, int(total * HOT_SHARE))
    names = [c for c in found.columns if c not in (key, count)]
    hot = found.where(F.col(count) > least).drop(count)
    cold = found.where(F.col(count) <= least).drop(count)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    return marked.where("_hot").drop("_hot").unionByName(marked.where("_hot IS NULL").drop("_hot", *names).join(cold, key, how))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """One 64-bit key per (id, text); rows that repeat both are the same document."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n + 1 entries, bytes) of a string array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return off - off[0] if len(off) else off, data[off[0] : off[-1]]


def blocks(off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``size`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of consecutive documents: ``start``/``end`` byte offsets into ``data``,
    ``first`` (n + 1 offsets of each document's words)."""

    __slots__ = ("data", "end", "first", "start")

    def __init__(self, off: np.ndarray, data: np.ndarray):
        self.data = data
        n = len(data)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(off), np.int64)
            return
        word = ~_WS[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        at = off[:-1][off[:-1] < n]
        begin[at] = word[at]
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        last = off[1:][off[1:] > 0] - 1
        stop[last] = word[last]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, off)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """Polynomial hash of each word: differences of one running sum, shifted back to the word's start."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        power, back = _powers(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (len(h) - k + 1 of them, across document borders too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _Q + h[j : j + n]
    return mix(out)


def inside(first: np.ndarray, total: int, k: int) -> np.ndarray:
    """Which of the k-grams over ``total`` words stay within one document."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(total + 1, bool)
    for b in np.unique(first[1:]):
        ok[max(0, b - k + 1) : b] = False
    return ok[:n]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that long texts stay within a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
