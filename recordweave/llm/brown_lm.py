"""Brown class-based bigram language model: exchange clustering and smoothed scores.

Exchange clustering first settles a core of types: the most frequent words are types of
their own, every other word stands with the type of its last two bytes, and the end of a
text (also the context of a first word) is one type. Bigrams of types are counted over
the whole training part, and the exchange algorithm moves types between classes while
the likelihood of the class bigrams rises. Then every other training word makes an
exchange step of its own: all its occurrences are gathered by word, with the classes
before and after, and it goes to the class that most raises the likelihood. All words
step from the same core, so the order of words does not matter. Class bigrams are then
counted anew with the final classes; a word that training lacks has the class of its
last two bytes. A token's probability is its class after the class before (interpolated
with the class alone) times the word in its class (add one; one slot of each class is
for unseen words).

Word counts stay distributed: texts are dealt into chunks of bounded size, a chunk
reports its distinct words once, gets their corpus counts and classes by a join, and
is read with that table into one byte a token, which later steps use.

Null text is empty: its end token alone. Equal rows count and are scored each. A
null id counts as training text. An empty table gives no rows; only doc_id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blocks, cut, release_shuffles, shared_dir, signed, small_batches, table, text_bytes

TOP_WORDS, SUFFIXES, CLASSES, ROUNDS = 1024, 127, 48, 6
#: Weight of the class alone against the class after a class, in tokens.
KAPPA = 20.0
CHUNK_BYTES = 8 << 20


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    """Blocks as (first row, last row, words, word hashes, suffix numbers)."""
    off, data = text_bytes(column)
    for lo, hi in blocks(off):
        w = Words(off[lo : hi + 1] - off[lo], data[off[lo] : off[hi]])
        h = w.hashes(lower=True)
        end = w.data[w.end - 1].astype(np.int64) if len(h) else np.zeros(0, np.int64)
        before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64) if len(h) else end
        upper = lambda x: np.where((x >= 65) & (x <= 90), x + 32, x)
        yield lo, hi, w, h, (upper(before) * 31 + upper(end) * 7) % SUFFIXES


def _per_word(w: Words, rows: np.ndarray) -> np.ndarray:
    return np.repeat(rows, np.diff(w.first))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (chunk, word) with the word's training count there; a task holds whole chunks."""
    held: list[tuple] = []
    size = 0

    def report() -> pa.RecordBatch:
        chunk, h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((h, chunk))
        chunk, h, n = chunk[order], h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (chunk[1:] != chunk[:-1])])) if len(h) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, first) if len(first) else n
        return pa.RecordBatch.from_arrays([pa.array(chunk[first].astype(np.int32)), pa.array(signed(h[first])), pa.array(total.astype(np.int64))], names=["chunk", "w", "n"])

    for batch in batches:
        chunk, train = batch.column("chunk").to_numpy(), (~batch.column("held_out").to_numpy(zero_copy_only=False)).astype(np.int64)
        for lo, hi, w, h, _ in _tokens(batch.column("text")):
            key = _per_word(w, chunk[lo:hi].astype(np.int64))
            n = _per_word(w, train[lo:hi])
            held.append((key, h, n))
            size += len(h)
        if size > 2_000_000:
            yield report()
            held, size = [], 0
    if held:
        yield report()


def _type_of(h: np.ndarray, suffix: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Type numbers: words of ``top`` (sorted hashes), then suffixes, then the end."""
    if not len(top):
        return suffix
    at = np.minimum(np.searchsorted(top, h), len(top) - 1)
    return np.where(top[at] == h, at, len(top) + suffix)


def _bigrams(top: np.ndarray):
    n_types = len(top) + SUFFIXES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(n_types * n_types, np.int64)
        for batch in batches:
            for lo, hi, w, h, s in _tokens(batch.column("text")):
                t = np.insert(_type_of(h, s, top), w.first[1:], n_types - 1)  # an end after each text
                before = np.concatenate([[n_types - 1], t[:-1]])
                cells += np.bincount(before * n_types + t, minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each type: types move one by one to the class that most raises the likelihood."""
    n = len(bigrams)
    left, right = bigrams.sum(1), bigrams.sum(0)
    order = np.argsort(-(left + right), kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = np.arange(n) % classes
    one = np.zeros((n, classes))
    one[np.arange(n), of] = 1
    m = one.T @ bigrams @ one
    nl, nr = one.T @ left, one.T @ right
    to, come = bigrams @ one, (one.T @ bigrams).T  # of each type: counts to and from classes
    for _ in range(rounds):
        moved = 0
        for t in order:
            if not left[t] and not right[t]:
                continue
            old, own = of[t], bigrams[t, t]
            r, l = to[t].copy(), come[t].copy()
            r[old] -= own
            l[old] -= own
            m[old, :] -= r
            m[:, old] -= l
            m[old, old] -= own
            nl[old] -= left[t]
            nr[old] -= right[t]
            d = np.diagonal(m)
            gain = (_f(m + r[None, :]) - _f(m)).sum(1) + (_f(m + l[:, None]) - _f(m)).sum(0)
            gain += _f(d + r + l + own) - _f(d + r) - _f(d + l) + _f(d)
            gain -= _f(nl + left[t]) - _f(nl) + _f(nr + right[t]) - _f(nr)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            m[new, :] += r
            m[:, new] += l
            m[new, new] += own
            nl[new] += left[t]
            nr[new] += right[t]
            if new != old:
                moved += 1
                of[t] = new
                to[:, old] -= bigrams[:, t]
                to[:, new] += bigrams[:, t]
                come[:, old] -= bigrams[t, :]
                come[:, new] += bigrams[t, :]
        if not moved:
            break
    return of


@dataclass(frozen=True)
class Core:
    """Classes of the types, and the class bigrams they give; its size depends on the numbers of types and classes alone."""

    top: np.ndarray
    top_counts: np.ndarray
    of: np.ndarray
    bigrams: np.ndarray
    classes: int


def core(vocab: DataFrame, training: DataFrame, top_words: int = TOP_WORDS, classes: int = CLASSES) -> Core:
    """The types, clustered."""
    best = vocab.groupBy("w").agg(F.sum("n").alias("c")).where("c > 0").orderBy(F.desc("c"), "w").limit(top_words).collect()
    top = np.array([r.w for r in best], np.int64).view(np.uint64)
    by = np.argsort(top)
    top, top_counts = top[by], np.array([r.c for r in best], np.int64)[by]
    n_types = len(top) + SUFFIXES + 1
    cells = training.select("text").mapInArrow(_bigrams(top), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    big = np.zeros(n_types * n_types)
    big[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    big = big.reshape(n_types, n_types)
    of = exchange(big, classes)
    one = np.zeros((n_types, classes))
    one[np.arange(n_types), of] = 1
    return Core(top, top_counts, of, one.T @ big @ one, classes)


_CONTEXTS = "bucket int, words binary, old binary, n binary, around binary"


def _contexts(shared, buckets: int):
    """Every occurrence of every word outside the core: class before, class after, and whether the word follows itself.

    Words of one bucket (a range of hashes) are packed into one row of each block.
    """

    def report(held: list[tuple]) -> pa.RecordBatch:
        h, old, around = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, old, around = h[order], old[order], around[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(h)))
        bucket = ((h[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        lo = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        at = np.append(first, len(h))
        rows = [(h[first[a:b]].tobytes(), old[first[a:b]].tobytes(), n[a:b].astype("<u4").tobytes(), around[at[a] : at[b]].tobytes()) for a, b in zip(lo.tolist(), [*lo[1:].tolist(), len(first)], strict=True)] if len(lo) else []
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(bucket[lo]), *(pa.array(c, pa.binary()) for c in cols)], names=[x.split()[0] for x in _CONTEXTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Core = shared.value
        end, held, size = len(m.of) - 1, [], 0
        for batch in batches:
            for lo, hi, w, h, s in _tokens(batch.column("text")):
                if not len(h):
                    continue
                t = _type_of(h, s, m.top)
                k = m.of[np.insert(t, w.first[1:], end)]
                doc = _per_word(w, np.arange(hi - lo))
                at = np.arange(len(h)) + doc
                before = np.concatenate([[m.of[end]], k[:-1]])[at]
                again = np.zeros(len(h), np.int64)
                again[:-1] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
                rest = t >= len(m.top)
                held.append((h[rest], k[at][rest].astype(np.uint8), ((again * m.classes + before) * m.classes + k[at + 1])[rest].astype("<u2")))
                size += int(rest.sum())
            if size > 2_000_000:
                yield report(held)
                held, size = [], 0
        if held:
            yield report(held)

    return run


def best_class(m: np.ndarray, old: np.ndarray, to: np.ndarray, come: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Class of each word after one exchange step from class ``old``, as in ``exchange``.

    ``to`` and ``come`` are a word's counts to and from classes without ``own``, how often it follows
    itself. Only cells that a word has are looked at.
    """
    n, every = len(old), np.arange(len(old))
    count = to.sum(1) + own
    gain = np.zeros((n, len(m)))
    for cells, mine, other in ((m.T, to, come), (m, come, to)):
        word, c = np.nonzero(mine)
        x = mine[word, c]
        a = cells[c].copy()
        a[np.arange(len(word)), old[word]] -= x
        at = np.flatnonzero(c == old[word])
        a[at] -= other[word[at]]
        a[at, c[at]] -= own[word[at]]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if len(first):
            gain[word[first]] += np.add.reduceat(_f(a + x[:, None]) - _f(a), first)
    d = np.tile(np.diagonal(m), (n, 1))
    d[every, old] -= to[every, old] + come[every, old] + own
    gain += _f(d + to + come + own[:, None]) - _f(d + to) - _f(d + come) + _f(d)
    for total in (m.sum(1), m.sum(0)):
        t = np.tile(total, (n, 1))
        t[every, old] -= count
        gain -= _f(t + count[:, None]) - _f(t)
    new = gain.argmax(1)
    return np.where(gain[every, new] <= gain[every, old] + 1e-9, old, new)


def _assign(shared):
    def run(rows: pa.Table) -> pa.Table:
        m: Core = shared.value
        k = m.classes
        whole = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        h, old, n, around = whole("words", "<u8"), whole("old", np.uint8), whole("n", "<u4").astype(np.int64), whole("around", "<u2").astype(np.int64)
        words, one, of = np.unique(h, return_index=True, return_inverse=True)
        old, of = old[one].astype(np.int64), np.repeat(of, n)
        order = np.argsort(of, kind="stable")
        of, around = of[order], around[order]
        count, new = np.bincount(of, minlength=len(words)), np.zeros(len(words), np.int64)
        for lo in range(0, len(words), 2048):
            hi = min(lo + 2048, len(words))
            a, b = np.searchsorted(of, [lo, hi])
            u, x, was = of[a:b] - lo, around[a:b], old[lo:hi]
            own = np.bincount(u, x // (k * k), hi - lo)
            come = np.bincount(u * k + x // k % k, minlength=(hi - lo) * k).reshape(-1, k).astype(np.float64)
            to = np.bincount(u * k + x % k, minlength=(hi - lo) * k).reshape(-1, k).astype(np.float64)
            come[np.arange(hi - lo), was] -= own
            to[np.arange(hi - lo), was] -= own
            new[lo:hi] = best_class(m.bigrams, was, to, come, own)
        return pa.Table.from_arrays([pa.array(signed(words)), pa.array(count.astype(np.int64)), pa.array(new.astype(np.int32))], names=["w", "c", "k"])

    return run


def assign(training: DataFrame, shared, buckets: int) -> DataFrame:
    """(w, c, k): training count and class of every training word outside the core, each by its own contexts."""
    return training.select("text").mapInArrow(_contexts(shared, buckets), _CONTEXTS).groupBy("bucket").applyInArrow(_assign(shared), "w long, c long, k int")


_READ = "doc_id long, held_out boolean, n_known long, word double, classes binary"


def _read(shared, ends: int):
    """Of each text: its known tokens, the sum of its tokens' log counts, and the class of each token, a byte each."""

    def run(key: tuple, docs: pa.Table, words: pa.Table) -> pa.Table:
        m: Core = shared.value
        known = words.column("w").to_numpy().view(np.uint64)
        by = np.argsort(known)
        known, c_known, k_known = known[by], words.column("c").to_numpy()[by], words.column("k").to_numpy()[by]
        end, out = len(m.of) - 1, []
        for lo, hi, w, h, s in _tokens(docs.column("text")):
            c, k = np.zeros(len(h), np.int64), m.of[_type_of(h, s, m.top)]
            if len(known) and len(h):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                c, k = np.where(hit, c_known[at], 0), np.where(hit, k_known[at], k)
            c = np.insert(c, w.first[1:], ends)
            k = np.insert(k, w.first[1:], m.of[end]).astype(np.uint8)
            first = w.first[:-1] + np.arange(hi - lo)
            cuts = [*first.tolist(), len(k)]
            out.append((np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(np.log10(c + 1.0), first), [k[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
        n_known, word = (np.concatenate([x[i] for x in out]) if out else np.zeros(0) for i in (0, 1))
        cols = [docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), pa.array(n_known.astype(np.int64)), pa.array(word), pa.array([y for x in out for y in x[2]], pa.binary())]
        return pa.Table.from_arrays(cols, names=[x.split()[0] for x in _READ.split(", ")])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens, and the place of each text's first; a text has at least its end."""
    texts = column.to_pylist()
    size = np.array([len(x) for x in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8).astype(np.int64), np.cumsum(size) - size


def _class_bigrams(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(classes * classes, np.int64)
        for batch in batches:
            k, _ = _flat(batch.column("classes"))
            if len(k):
                cells += np.bincount(np.concatenate([k[-1:], k[:-1]]) * classes + k, minlength=len(cells))  # all texts end alike
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    return run


@dataclass(frozen=True)
class Model:
    after: np.ndarray  # log10 of class after class
    room: np.ndarray  # log10, of each class: its tokens plus its distinct words plus one
    tokens: int
    distinct: int


_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_room = np.log10(m.tokens + m.distinct + 1)
        for b in batches:
            k, first = _flat(b.column("classes"))
            if not len(k):
                continue
            n, word = np.diff(np.append(first, len(k))), b.column("word").to_numpy()
            score = word + np.add.reduceat(m.after[np.concatenate([k[-1:], k[:-1]]), k] - m.room[k], first)
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(n), b.column("n_known"), pa.array(np.full(len(n), m.tokens, np.int64)), pa.array(word - n * base_room), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return run


def score(docs: DataFrame, top_words: int = TOP_WORDS, classes: int = CLASSES) -> DataFrame:
    """Learn from the training rows of ``docs`` and score all; see the module and _SCHEMA."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "brown-lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", held_out())
    training = docs.where("NOT held_out")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count_if(~F.col("held_out")).alias("train")).first()
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size.n // CHUNK_BYTES + 1))
    chunked = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")).repartition(parts, "chunk")
    vocab = cut(chunked.mapInArrow(_vocabulary, "chunk int, w long, n long"), f"{folder}/vocabulary")
    release_shuffles(spark)
    m = core(vocab, training, top_words, classes)
    shared = spark.sparkContext.broadcast(m)
    frequent = spark.createDataFrame([(int(w), int(c), int(k)) for w, c, k in zip(signed(m.top), m.top_counts, m.of, strict=False)], "w long, c long, k int")
    words = cut(assign(training, shared, parts).unionByName(frequent), f"{folder}/words")
    release_shuffles(spark)
    # a word that a chunk reports twice is found once all the same
    known = vocab.select("chunk", "w").join(words, "w").select("chunk", "w", "c", "k")
    read = cut(chunked.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_read(shared, size.train), _READ), f"{folder}/read")
    release_shuffles(spark)
    in_class = words.groupBy("k").agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).collect()
    cells = read.where("NOT held_out").select("classes").mapInArrow(_class_bigrams(classes), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    big, room = np.zeros(classes * classes), np.ones(classes)
    big[[r.cell for r in cells]] = [r.n for r in cells]
    big = big.reshape(classes, classes)
    for r in in_class:
        room[r.k] += r.words + r.tokens
    room[m.of[-1]] += size.train + 1
    alone = (big.sum(0) + 1) / (big.sum() + classes)
    after = np.log10((big + KAPPA * alone[None, :]) / (big.sum(1, keepdims=True) + KAPPA))
    model = Model(after, np.log10(room), sum(r.tokens for r in in_class) + size.train, sum(r.words for r in in_class) + (1 if size.train else 0))
    return read.mapInArrow(_score(model), _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
