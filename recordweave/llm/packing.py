"""Hierarchical packing of token ids into sequences whose sizes are powers of two.

Each document gives whole long windows first; what is left is routed to the
smallest tier that holds it. A tier packs its own pieces and fills the gap from
shorter tiers, longest fitting piece first; only when nothing fits is a piece cut.
What a task has left at its end becomes sequences of falling powers of two, so no
sequence needs padding. Packing needs no shuffle: a sequence never leaves a task.

Null text is an empty document (its end id alone), equal rows are packed each, a
null id is kept, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import small_batches, table

TIERS = (256, 512, 1024, 2048)
#: Pieces that wait in a task before its tiers are packed.
WAITING = 4096
#: Tokens of one step group; each group holds sequences of one tier, so groups are equal in tokens.
STEP_TOKENS = 32 * 2048

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"


class Packer:
    """Packs (document, start, ids) pieces of one task; ``rows`` collects the placed pieces."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.task = tiers, task
        self.pools: list[list[tuple[int, int]]] = [[] for _ in tiers]  # (length, piece) by length
        self.pieces: dict[int, tuple] = {}
        self.made, self.next, self.sequences = dict.fromkeys(tiers, 0), 0, 0
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        n, top, at = len(ids) // 4, self.tiers[-1], 0
        while n - at >= top:
            self._close([(doc, at, ids[4 * at : 4 * (at + top)], n)], top)
            at += top
        if n > at:
            self._wait((doc, at, ids[4 * at :], n))

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        pool = next(i for i, t in enumerate(self.tiers) if n <= t)
        self.pieces[self.next] = piece
        insort(self.pools[pool], (n, self.next))
        self.next += 1

    def waiting(self) -> int:
        return len(self.pieces)

    def _take(self, gap: int, below: int) -> tuple | None:
        """The longest waiting piece of tiers up to ``below`` that fits, or None."""
        for i in range(below, -1, -1):
            pool = self.pools[i]
            if pool and (k := bisect_right(pool, (gap, self.next))):
                return self.pieces.pop(pool.pop(k - 1)[1])
        return None

    def _cut(self, gap: int, below: int) -> tuple | None:
        """The first ``gap`` ids of the shortest piece that is longer; the rest waits on."""
        for pool in self.pools[: below + 1]:
            if pool:
                doc, at, ids, n = self.pieces.pop(pool.pop(-1)[1])
                self._wait((doc, at + gap, ids[4 * gap :], n))
                return doc, at, ids[: 4 * gap], n
        return None

    def _close(self, placed: list[tuple], size: int) -> None:
        group = self.made[size] * size // STEP_TOKENS
        key = (self.task << 33) + self.sequences
        self.sequences += 1
        self.made[size] = self.made.get(size, 0) + 1
        offset = 0
        for doc, at, ids, n in placed:
            k = len(ids) // 4
            self.rows.append((doc, at, k, bpe.crc32(ids), n, key, offset, size, (self.task << 33) + group * len(self.tiers) + self.tiers.index(size) if size in self.tiers else -1))
            offset += k

    def _tokens(self, below: int) -> int:
        return sum(n for pool in self.pools[: below + 1] for n, _ in pool)

    def _fill(self, size: int, below: int) -> None:
        placed, gap = [], size
        while gap:
            piece = self._take(gap, below) or self._cut(gap, below)
            placed.append(piece)
            gap -= len(piece[2]) // 4
        self._close(placed, size)

    def pack(self) -> None:
        """Pack the tiers, longest first, as long as a tier has a piece and the tokens for a whole sequence."""
        for i in range(len(self.tiers) - 1, -1, -1):
            left = self._tokens(i)
            while self.pools[i] and left >= self.tiers[i]:
                self._fill(self.tiers[i], i)
                left -= self.tiers[i]

    def finish(self) -> None:
        """Pack the rest; the binary digits of what remains are the last sequences."""
        self.pack()
        top = len(self.tiers) - 1
        left, size = self._tokens(top), self.tiers[-1]
        while left:
            while left >= size:
                self.made.setdefault(size, 0)
                self._fill(size, top)
                left -= size
            size //= 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def _pack(path: str | None, end_id: int, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = bpe.encoder(path or bpe.default_path()), Packer(TaskContext.get().partitionId(), tiers)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode_many(part.column("text").to_pylist()), strict=True):
                    packer.add(doc, ids + end)
                if packer.waiting() >= WAITING:
                    packer.pack()
                if packer.rows:
                    yield _batch(packer.rows)
                    packer.rows = []
        packer.finish()
        yield _batch(packer.rows)

    return run


def pack(docs: DataFrame, end_id: int = 1, tiers: tuple[int, ...] = TIERS, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``; see SCHEMA. ``tiers`` are rising powers of two."""
    if not tiers or list(tiers) != sorted(set(tiers)) or any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers must be rising powers of two")
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text").mapInArrow(_pack(tokenizer, end_id, tuple(tiers)), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
