"""Token-id output as ORC: run-length encoded ids, row indexes, a Bloom filter on document ids.

Documents are range-partitioned and sorted by id, so file and stripe statistics
prune id ranges and the Bloom filter prunes point lookups. Each row carries its
position inside its own file; global positions come from one sum per file, so
stripes are read in parallel and in any order.

Null text is empty, rows with equal ids are all kept (ordered by text), a null id
sorts first, rows that tie in id and text are alike, an empty table gives no rows,
a very long text is one row of its stripe, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import shared_dir, small_batches, table

STRIPE_BYTES, ROW_STRIDE = 16 << 20, 1_000

_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def _encode(path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = bpe.encoder(path or bpe.default_path()), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                raw = [b + end for b in enc.encode_many(piece.column("text").to_pylist())]
                n = np.array([len(b) // 4 for b in raw], np.int64)
                off = np.concatenate([[0], np.cumsum(n)])
                ids = pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at + off[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(off, pa.int32()), ids)],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                at += int(off[-1])

    return run


def write(docs: DataFrame, path: str, end_id: int, tokenizer: str | None = None, partitions: int | None = None, stripe_bytes: int = STRIPE_BYTES, row_stride: int = ROW_STRIDE) -> None:
    """Encode ``docs(doc_id, text)`` and write the id files under ``path``, ascending by doc_id.

    A stripe ends at ``stripe_bytes``; its row index and Bloom filters have an entry for every ``row_stride`` rows.
    """
    small_batches(docs.sparkSession)
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ranged.mapInArrow(_encode(tokenizer, end_id), _SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "snappy")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of id files; filters on doc_id reach stripes and Bloom filters."""
    rows = spark.read.schema(_SCHEMA).orc(path)
    # one row per file, however many documents: its size is the number of written files
    sums = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total")).collect()
    before, offsets = 0, []
    for part, total in sorted((r.part, r.total) for r in sums):
        offsets.append((part, before))
        before += total
    base = spark.createDataFrame(offsets, "part int, base long")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        off, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [bpe.crc32(flat[lo:hi].tobytes()) for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(read_back: DataFrame) -> DataFrame:
    return read_back.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-orc")
    write(table(spark, sf_dir, "documents"), path, end_id=2)
    return checksums(read(spark, path))
