"""Byte-level BPE of whole texts with the ``tokenizers`` library.

The library spends most of its time splitting text and keeping offsets, and it
splits before merging, so a pre-token's ids never depend on its neighbours. A
worker therefore splits many texts at once, over arrays of code points, and sends
each *distinct* pre-token through the library once. Known pre-tokens are rows of an
open-addressed table, found by one 64-bit hash and told apart by a second one (128
bits in all; pre-tokens over LONGEST code points are told apart by themselves); the
table starts over when it is full, so memory is bounded.

A text goes through the library whole if it holds an added token's string, which the
library takes out before it splits, or a character outside the ranges on which
Python's classes of characters agree with the library's.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

#: The contractions of the byte-level pattern.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pre-tokens a worker remembers before it starts over (about 60 bytes each), and rows of its table.
CACHE_ENTRIES, TABLE_BITS = 1_200_000, 21
#: Code points up to which a pre-token is known by its hashes.
LONGEST = 64
#: Code points that are hashed at once; a longer pre-token is a block of its own.
HASH_BLOCK = 1 << 16

#: Characters whose class is the same here and in the library: superscripts, fractions
#: and the four separator controls are not among them.
_KNOWN = "\\x00-\\x1b\\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_LETTER, _DIGIT, _OTHER, _SPACE, _WHITE, _STRANGE = range(6)


def _classes() -> np.ndarray:
    """The class of every code point of the basic plane."""
    everything = "".join(map(chr, range(0x10000)))
    out = np.full(0x10000, _STRANGE, np.uint8)
    known = np.array([m.start() for m in re.finditer(f"[{_KNOWN}]", everything)])
    for kind, pattern in ((_OTHER, r"[\s\S]"), (_LETTER, r"[^\W\d_]"), (_DIGIT, r"\d"), (_WHITE, r"\s"), (_SPACE, " ")):
        at = np.array([m.start() for m in re.finditer(pattern, everything)])
        out[np.intersect1d(at, known)] = kind
    return out


_RNG = np.random.Generator(np.random.PCG64(19700101))
_BASES = _RNG.integers(1 << 32, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHARS = [_RNG.integers(1, 1 << 63, 0x10000, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in _BASES]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Table:
    """Rows of (hash, second hash, place and number of ids), found by open addressing."""

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self.key, self.second = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.at, self.n = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.ids, self.used, self.entries = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, key: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        row = (key & self.mask).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            there = self.key[row]
            hit, gone = there == key[left], there == 0
            out[left[hit]] = row[hit]
            on = ~(hit | gone)
            left, row = left[on], (row[on] + 1) & int(self.mask)
        return out

    def put(self, key: np.ndarray, second: np.ndarray, ids: list[np.ndarray]) -> None:
        """Distinct new keys and their ids."""
        size = np.array([len(x) for x in ids], np.int64)
        total = int(size.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        self.ids[self.used : self.used + total] = np.concatenate(ids)
        at = self.used + np.cumsum(size) - size
        self.used, self.entries = self.used + total, self.entries + len(key)
        row, left = (key & self.mask).astype(np.int64), np.arange(len(key))
        while len(left):
            free = self.key[row] == 0
            self.key[row[free]] = key[left[free]]  # of several for one row the last stays; the others go on
            done = self.key[row] == key[left]
            mine, here = left[done], row[done]
            self.second[here], self.at[here], self.n[here] = second[mine], at[mine], size[mine]
            left, row = left[~done], (row[~done] + 1) & int(self.mask)


class Encoder:
    """``encode(texts)`` gives the ids of all texts and where each text's begin."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES, table_bits: int = TABLE_BITS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        #: The same model and bytes, for texts whose only borders are newlines.
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.limit, self.bits, self.table = min(cache_entries, (1 << table_bits) * 3 // 5), table_bits, Table(table_bits)
        self.classes = _classes()
        self.newline = self.tok.encode("\n", add_special_tokens=False).ids[0]
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def _learned(self, words: list[str]) -> list[np.ndarray]:
        """The ids of pre-tokens."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        # a pre-token that ends in white space is white space throughout
        white = [w[-1].isspace() for w in words]
        alone = [i for i, x in enumerate(white) if x]
        joined = [i for i, x in enumerate(white) if not x]
        for lo in range(0, len(alone), 4096):
            part = alone[lo : lo + 4096]
            for i, e in zip(part, self.tok.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        for lo in range(0, len(joined), 64):
            part = joined[lo : lo + 64]
            ids = np.array(self.words.encode_batch_fast(["\n".join([words[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.newline)
            if len(at) == len(part) - 1:
                first = 0
                for i, end in zip(part, [*at.tolist(), len(ids)], strict=True):
                    out[i] = ids[first:end]
                    first = end + 1
            else:
                for i, e in zip(part, self.tok.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                    out[i] = np.array(e.ids, np.uint32)
        return out

    def _hashes(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Two hashes of each span: differences of running sums, shifted back to the span's start.

        The sums run over blocks of spans that follow each other, so what is kept does not grow with a text.
        """
        out = [np.zeros(len(start), np.uint64) for _ in _BASES]
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + HASH_BLOCK, "right")))
            first = start[lo]
            block, a, b = points[first : end[hi - 1]], start[lo:hi] - first, end[lo:hi] - first
            sums = np.zeros(len(block) + 1, np.uint64)
            for found, (power, back), chars in zip(out, self._powers(len(block)), _CHARS, strict=True):
                np.cumsum(chars[block] * power[: len(block)], out=sums[1:])
                found[lo:hi] = _mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
            lo = hi
        out[0][out[0] == 0] = 1  # 0 marks a free row
        return out

    def _powers(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """At least n powers of each base and of its inverse; those of one very long span are not kept."""
        if not self.powers:
            self.powers = self._raised(HASH_BLOCK)
        return self.powers if n <= HASH_BLOCK else self._raised(n)

    @staticmethod
    def _raised(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.cumprod(np.full(n, b)), np.cumprod(np.full(n, np.uint64(pow(int(b), -1, 1 << 64))))) for b in _BASES]

    def _starts(self, points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; ``first`` are the starts of texts that are not empty."""
        n = len(points)
        begins = np.zeros(n + 1, bool)
        begins[first] = begins[n] = True
        white = kind >= _SPACE
        group = np.where(white, _SPACE, kind)
        start = begins[:n].copy()
        start[1:] |= group[1:] != group[:-1]
        # the last of some white space goes with what follows if it is a space, else it stands alone
        at = np.flatnonzero(~white & start & ~begins[:n])
        at = at[white[at - 1]]
        start[at - 1] = True
        start[at[kind[at - 1] == _SPACE]] = False
        # contractions, where a pre-token begins with an apostrophe
        marks = np.flatnonzero((points == 39) & start)
        for letters in _CONTRACTIONS:
            ok = marks[marks + len(letters) < n]
            for j, c in enumerate(letters, 1):
                ok = ok[(points[ok + j] == ord(c)) & ~begins[ok + j]]
            start[ok + 1] = False
            end = ok + len(letters) + 1
            start[end[end < n]] = True
        return np.flatnonzero(start)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of n + 1 entries)."""
        whole = {i: np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if t and any(a in t for a in self.added)}
        texts = ["" if i in whole else t or "" for i, t in enumerate(texts)]
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        kind = self.classes[np.minimum(points, 0xFFFF)]
        kind[points > 0xFFFF] = _STRANGE
        strange = np.unique(np.searchsorted(first, np.flatnonzero(kind == _STRANGE), "right") - 1).tolist()
        if strange:
            whole |= {i: np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in strange}
            return self._plain(["" if i in whole else t for i, t in enumerate(texts)], whole)
        return self._known(joined, points, kind, first, whole)

    def _plain(self, texts: list[str], whole: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        return self._known(joined, points, self.classes[points], np.concatenate([[0], np.cumsum([len(t) for t in texts])]), whole)

    def _known(self, joined: str, points: np.ndarray, kind: np.ndarray, first: np.ndarray, whole: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the table; ``whole`` has those of texts that are empty here."""
        start = self._starts(points, kind, first[:-1][first[:-1] < first[1:]]) if len(points) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(points))[: len(start)]
        key, second = self._hashes(points, start, end)
        if self.table.entries > self.limit:
            self.table = Table(self.bits)
        row = self.table.find(key)
        short = end - start <= LONGEST
        new = np.flatnonzero((row < 0) & short)
        if len(new):
            fresh, at = np.unique(key[new], return_index=True)
            at = new[at]
            for lo in range(0, len(fresh), 1 << 16):  # a batch of more distinct pre-tokens than the table holds would not fit
                if self.table.entries + (1 << 16) > (1 << self.bits) * 9 // 10:
                    return self._slowly(joined, first, whole)
                part = at[lo : lo + (1 << 16)]
                self.table.put(fresh[lo : lo + (1 << 16)], second[part], self._learned([joined[a:b] for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)]))
            row[new] = self.table.find(key[new])
        if (self.table.second[row[short]] != second[short]).any():  # one hash, other words: never seen, and not guessed at
            return self._slowly(joined, first, whole)
        n, at, pool = self.table.n[row].astype(np.int64), self.table.at[row], self.table.ids[: self.table.used]
        long_ = np.flatnonzero(~short)
        if len(long_):
            ids = self._learned([joined[start[i] : end[i]] for i in long_.tolist()])
            n[long_] = [len(x) for x in ids]
            at[long_] = len(pool) + np.cumsum(n[long_]) - n[long_]
            pool = np.concatenate([pool, *ids])
        place = np.cumsum(n) - n
        flat = pool[np.repeat(at - place, n) + np.arange(int(n.sum()))]
        bounds = np.append(place, len(flat))[np.searchsorted(start, first)]
        return _merge(flat, bounds, whole)

    def _slowly(self, joined: str, first: np.ndarray, whole: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        parts = [whole[i] if i in whole else np.array(self.tok.encode(joined[a:b], add_special_tokens=False).ids, np.uint32) for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        flat, at = self.encode(texts)
        raw = flat.astype("<u4", copy=False).tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _merge(flat: np.ndarray, bounds: np.ndarray, whole: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Put ids of single texts where the texts are."""
    if not whole:
        return flat, bounds
    parts = [whole.get(i, flat[a:b]) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder, and so one table of known pre-tokens, per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
