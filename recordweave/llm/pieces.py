"""SentencePiece: sampled segmentations, reproducible by row, and lossless decoding.

A text is cut before every space into units; a piece never crosses such a border, so
the lattice of a text is the chain of its units' lattices. Of each distinct unit in
a batch, forward sums over all segmentations are filtered once; each occurrence is
then sampled backwards with random numbers that depend only on the seed, the row's
key, the unit's place and the step, never on how rows are batched.

A piece's log probability falls with its rank in the vocabulary (``alpha`` times the
logarithm of the rank): the vocabulary file orders pieces by merges and holds no
probabilities. A character without a piece falls back to its UTF-8 bytes, and so
does the vocabulary's own mark for a space, so every text decodes to itself. A unit has
one lattice whatever its length; of units longer than the last of _LENGTHS only the
forward sums are kept, and pieces are looked up again block by block.

Null text is empty (no ids). A null key counts as 0. Equal rows get equal ids. An
empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, small_batches, table

SPACE = 0x2581
ALPHA, BYTE_COST = 1.0, 12.0
_G, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_SLOT_BITS = 17
#: Units of one length class are filtered together.
_LENGTHS = (4, 8, 12, 16, 24, 48, 96, 192, 384, 768, 1536, 3072)
#: Characters of units that are filtered together, and of a block of a longer unit.
_CELLS, _BLOCK = 384_000, 4096


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a model file: hashes of its pieces, scores, and bytes for decoding."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.byte_id = np.zeros(256, np.int32)
        found: list[tuple[np.uint64, int, float]] = []
        self.longest, rank = 1, 0
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
                continue
            self.bytes.append(p.replace(chr(SPACE), " ").encode())
            rank += 1
            if chr(SPACE) in p[1:]:
                continue  # pieces do not cross a unit's border
            h = np.uint64(0)
            codes = mix(np.array([ord(c) for c in p], np.uint64) + np.uint64(1))
            for c in codes:
                h = np.multiply(h, _P, dtype=np.uint64) + c if len(codes) == 1 else np.add(np.multiply(np.array([h]), _P), c)[0]
            found.append((h, i, -alpha * float(np.log(rank + 1.0))))
            self.longest = max(self.longest, len(p))
        found.sort()
        self.hash = np.array([f[0] for f in found], np.uint64)
        self.id = np.array([f[1] for f in found], np.int32)
        self.score = np.array([f[2] for f in found])
        slot = (self.hash >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.slot = np.searchsorted(slot, np.arange((1 << _SLOT_BITS) + 1))
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the pieces, or -1: most slots of the table are empty, the others short."""
        flat = h.ravel()
        slot = (flat >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        at, end = self.slot[slot], self.slot[slot + 1]
        found = np.full(len(flat), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        at, end = at[open_], end[open_]
        while len(open_):
            hit = self.hash[at] == flat[open_]
            found[open_[hit]] = at[hit]
            at += 1
            go = ~hit & (at < end)
            open_, at, end = open_[go], at[go], end[go]
        return found.reshape(h.shape)

    def _scores(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of units (rows of ``codes``): ids[l, u, i] of the piece of l + 1 characters from i (-1: none, -2: bytes), and its score."""
        n, width = codes.shape
        deep = min(self.longest, width)
        c = mix(codes.astype(np.uint64) + np.uint64(1))
        ids = np.full((deep, n, width), -1, np.int32)
        score = np.full((deep, n, width), -np.inf)
        h = np.zeros((n, width), np.uint64)
        for k in range(deep):
            m = width - k
            h = h[:, :m] * _P + c[:, k:]
            place = self._find(h)
            hit = place >= 0
            ids[k, :, :m] = np.where(hit, self.id[place], -1)
            score[k, :, :m] = np.where(hit, self.score[place], -np.inf)
        none = ids[0] < 0
        ids[0][none] = -2
        size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        score[0] = np.where(none, -BYTE_COST * size, score[0])
        return ids, score

    def _filter(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of units: the ids of _scores, and cum[l, u, j]: share of segmentations up to j whose last piece has at most l + 1."""
        ids, score = self._scores(codes)
        deep, n, width = ids.shape
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0
        cum = np.zeros((deep, n, width + 1), np.float32)
        for j in range(1, width + 1):
            d = min(deep, j)
            back = np.stack([alpha[:, j - k - 1] + score[k, :, j - k - 1] for k in range(d)])
            top = back.max(0)
            part = np.cumsum(np.exp(back - top), 0)
            alpha[:, j] = top + np.log(part[-1])
            cum[:d, :, j] = part / part[-1]
            cum[d:, :, j] = 1
        return ids, cum

    def _long(self, codes: np.ndarray, noise: np.ndarray) -> list[tuple[list[int], list[int]]]:
        """Of each occurrence (by its noise) of one unit of any length: where its pieces start, last piece first, and their ids."""
        n, deep = len(codes), min(self.longest, len(codes))
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0
        back_k = np.arange(deep)
        borders = list(range(0, n, _BLOCK))

        def block(lo: int) -> tuple[int, int, np.ndarray, np.ndarray]:
            """Pieces that end in a block may start up to the longest piece before it."""
            a, hi = max(0, lo - deep + 1), min(lo + _BLOCK, n)
            ids, score = self._scores(codes[None, a:hi])
            return a, hi, ids[:, 0], score[:, 0]

        def weights(j: int, a: int, score: np.ndarray) -> tuple[float, np.ndarray]:
            k = back_k[: min(len(score), j)]
            back = alpha[j - k - 1] + score[k, j - k - 1 - a]
            top = back.max()
            return top, np.cumsum(np.exp(back - top))

        for lo in borders:
            a, hi, _, score = block(lo)
            for j in range(lo + 1, hi + 1):
                top, part = weights(j, a, score)
                alpha[j] = top + np.log(part[-1])
        out: list[tuple[list[int], list[int]]] = [([], []) for _ in noise]
        at = [n] * len(noise)
        for lo in reversed(borders):
            a, _, ids, score = block(lo)
            for i, (places, got) in enumerate(out):
                while at[i] > lo:
                    r = (mix(noise[i : i + 1] + np.array([len(got)], np.uint64) * _P) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                    _, part = weights(at[i], a, score)
                    k = int(((part / part[-1]).astype(np.float32) <= r).sum())
                    at[i] -= k + 1
                    places.append(at[i])
                    got.append(int(ids[k, at[i] - a]))
        return out

    def encode_many(self, texts: list[str | None], keys: np.ndarray, seed: int = 0) -> list[np.ndarray]:
        """Sampled ids of each text; ``keys`` are the rows' integer keys."""
        lengths = np.array([len(t or "") for t in texts], np.int64)
        code = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(code):
            return [np.zeros(0, np.int32) for _ in texts]
        first = np.concatenate([[0], np.cumsum(lengths)])
        begin = code == 32
        begin[first[:-1][lengths > 0]] = True
        starts = np.flatnonzero(begin)
        size = np.diff(np.append(starts, len(code)))
        doc = np.searchsorted(first, starts, "right") - 1
        nth = starts - first[doc]
        literal = np.where(code == SPACE, 0x110000, code)  # the mark itself has no piece
        marked = np.where(code == 32, SPACE, literal)
        # equal units by hash
        power = np.cumprod(np.full(int(size.max()), _P))
        within = np.arange(len(code)) - np.repeat(starts, size)
        h = mix(np.add.reduceat(mix(marked.astype(np.uint64) + np.uint64(3)) * power[within], starts) + size.astype(np.uint64))
        _, one, of = np.unique(h, return_index=True, return_inverse=True)
        noise = mix(mix(keys.astype(np.int64).view(np.uint64) * _P + np.uint64(seed))[doc] + nth.astype(np.uint64) * _G)
        pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # unit occurrence, step, id
        count = np.zeros(len(starts), np.int64)
        low = 0
        for high in _LENGTHS:
            chosen = np.flatnonzero((size[one] > low) & (size[one] <= high))
            low = high
            row = np.full(len(one), -1)
            row[chosen] = np.arange(len(chosen))
            most = max(1, min(8_000, _CELLS // high))
            for lo in range(0, len(chosen), most):
                units = chosen[lo : lo + most]
                n = size[one[units]]
                grid = starts[one[units]][:, None] + np.arange(high)[None, :]
                codes = np.where(np.arange(high)[None, :] < n[:, None], marked[np.minimum(grid, len(code) - 1)], 0x110001)
                ids, cum = self._filter(codes)
                u = row[of] - lo
                occ = np.flatnonzero((u >= 0) & (u < len(units)) & (row[of] >= 0))
                at, u, step = size[occ].copy(), u[occ], 0
                while len(occ):
                    r = (mix(noise[occ] + np.array([step], np.uint64) * _P) >> np.uint64(11)).astype(np.float64) * 2.0**-53
                    k = (cum[:, u, at] <= r[None, :]).sum(0)
                    at = at - k - 1
                    got = ids[k, u, at]
                    got = np.where(got == -2, -1 - code[starts[occ] + at], got)
                    pieces.append((occ, np.full(len(occ), step), got))
                    count[occ] += 1
                    step += 1
                    go = at > 0
                    occ, at, u = occ[go], at[go], u[go]
        for u in np.flatnonzero(size[one] > low).tolist():
            occ, lo = np.flatnonzero(of == u), starts[one[u]]
            for o, (places, ids) in zip(occ.tolist(), self._long(marked[lo : lo + size[one[u]]], noise[occ]), strict=True):
                got = np.array(ids, np.int64)
                pieces.append((np.full(len(got), o), np.arange(len(got)), np.where(got == -2, -1 - code[starts[o] + np.array(places)], got)))
                count[o] = len(got)
        place = np.cumsum(count)
        out = np.zeros(place[-1], np.int64)
        for occ, step, got in pieces:
            out[place[occ] - 1 - step] = got
        ends = np.concatenate([[0], place])[np.searchsorted(starts, first)]
        if (raw := np.flatnonzero(out < 0)).size:
            # characters without a piece, as their bytes
            spelled = [self.byte_id[list(chr(-1 - c).encode("utf-8", "surrogatepass"))] for c in out[raw].tolist()]
            grow = np.ones(len(out), np.int64)
            grow[raw] = [len(s) for s in spelled]
            to = np.concatenate([[0], np.cumsum(grow)])
            wide = np.repeat(out, grow)
            for i, s in zip(to[raw].tolist(), spelled, strict=True):
                wide[i : i + len(s)] = s
            out, ends = wide, to[ends]
        out = out.astype(np.int32)
        return [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's UTF-8 bytes."""
        n = self.lengths[ids]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return self.flat[np.repeat(self.at[ids], n) + within].tobytes()


_PIECES: dict[tuple, Pieces] = {}


def pieces(path: str | None = None, alpha: float = ALPHA) -> Pieces:
    key = (path or default_path(), alpha)
    if key not in _PIECES:
        _PIECES[key] = Pieces(*key)
    return _PIECES[key]


def _encode(path: str | None, alpha: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path, alpha)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = p.encode_many(part.column("text").to_pylist(), part.column("doc_id").fill_null(0).to_numpy(), seed)
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, seed: int = 0, alpha: float = ALPHA, model: str | None = None) -> DataFrame:
    """doc_id and sampled ids of every row of ``docs(doc_id, text)``."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(model, alpha, seed), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows of ``encoded(doc_id, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            texts = [p.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)).decode() for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id long, text string")


def _digest(path: str | None, alpha: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path, alpha)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column("text").to_pylist()
                ids = p.encode_many(texts, part.column("doc_id").fill_null(0).to_numpy(), seed)
                same = [p.decode(x) == (t or "").encode() for x, t in zip(ids, texts, strict=True)]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentation of every text: number and checksum of its ids, and whether they decode to the text."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_digest(None, ALPHA, 0), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
