"""Language ID: scripts narrow the candidates, Viterbi labels spans of mixed-language text.

A word's score in a language is the sum of the log probabilities of its byte
trigrams. Languages whose script the word does not use are no candidates for it. The
best labelling of a document's words under a fixed penalty for each switch is found
exactly: the words are cut into short segments, all segments of a batch advance
together from every possible state before them, and the segments of a document are
then joined by max-plus products, so a very long document costs no more steps.

Trigram tables are fitted on at most SAMPLE labelled training rows of each language,
those with the least hash of their id; everything else is applied to every text.

Null text and text without a letter give ``und`` with score 0. Without any labelled
training row everything is ``und``. A null id counts as training. Equal rows get
equal labels. An empty table gives no rows; only doc_id, text and (for learning)
lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, blocks, small_batches, table, text_bytes

SAMPLE = 1500
SWITCH_PENALTY, OTHER_SCRIPT = 12.0, -30.0
SEGMENT, BUCKETS, SMOOTHING = 128, 1 << 16, 0.1
#: A language uses a script if so large a share of its letters is of it.
SCRIPT_SHARE = 0.01

#: First UTF-8 bytes of letters, by script (from, to, number).
SCRIPTS = (
    ("Latin", 0x41, 0x5A), ("Latin", 0x61, 0x7A), ("Latin", 0xC3, 0xC9), ("Greek", 0xCD, 0xCF), ("Cyrillic", 0xD0, 0xD3), ("Armenian", 0xD4, 0xD5),
    ("Hebrew", 0xD6, 0xD7), ("Arabic", 0xD8, 0xDB), ("Indic", 0xE0, 0xE0), ("Asian", 0xE1, 0xE1), ("Kana", 0xE3, 0xE3), ("Han", 0xE4, 0xE9), ("Hangul", 0xEA, 0xED),
)
_NAMES = list(dict.fromkeys(s for s, _, _ in SCRIPTS))
_SCRIPT = np.zeros(256, np.int64)
for _s, _a, _b in SCRIPTS:
    _SCRIPT[_a : _b + 1] = 1 << _NAMES.index(_s)
_FOLD = np.zeros(256, np.int64)  # letters by lower case, all else is a border
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _grams(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram bucket, whether it is centred on a letter) of every byte; texts do not touch at ``borders``."""
    c = _FOLD[data]
    left, right = np.zeros_like(c), np.zeros_like(c)
    left[1:], right[:-1] = c[:-1], c[1:]
    inner = borders[(borders > 0) & (borders < len(c))]
    left[inner] = 0
    right[inner - 1] = 0
    return ((left * 0x9E5 + c) * 0xC6F + right * 0x1F3) % BUCKETS, c > 0


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    scores: np.ndarray  # (BUCKETS, languages) log probabilities
    scripts: np.ndarray  # bit mask of each language


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _count(key: tuple, rows: pa.Table) -> pa.Table:
    counts, scripts = np.zeros(BUCKETS, np.int64), np.zeros(len(_NAMES), np.int64)
    off, data = text_bytes(rows.column("text"))
    for lo, hi in blocks(off):
        part = data[off[lo] : off[hi]]
        g, on = _grams(part, off[lo : hi + 1] - off[lo])
        counts += np.bincount(g[on], minlength=BUCKETS)
        found = np.bincount(_SCRIPT[part], minlength=1 << len(_NAMES))
        scripts += found[1 << np.arange(len(_NAMES))]
    return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([counts.tobytes()]), "scripts": pa.array([scripts.tobytes()])})


def fit(training: DataFrame, sample: int = SAMPLE) -> Model:
    """Trigram tables from at most ``sample`` rows of each language of ``training(doc_id, text, lang)``."""
    known = training.where("lang IS NOT NULL AND text IS NOT NULL")
    # about twice the sample by a threshold on the hash, so that no task sees more of a language, then exactly the least
    share = known.groupBy("lang").agg((F.least(F.lit(1.0), 2.0 * sample / F.count("*")) * (1 << 30)).cast("long").alias("below"))
    near = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    few = known.join(F.broadcast(share), "lang").where(near <= F.col("below"))
    order = Window.partitionBy("lang").orderBy(near, "doc_id", "text")
    rows = few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample)
    found = rows.select("lang", "text").groupBy("lang").applyInArrow(_count, "lang string, counts binary, scripts binary").toPandas().sort_values("lang")
    scores, masks = [], []
    for c, s in zip(found["counts"], found["scripts"], strict=True):
        n, letters = np.frombuffer(c, np.int64), np.frombuffer(s, np.int64)
        scores.append(np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS)))
        masks.append(int(sum(1 << i for i in range(len(_NAMES)) if letters[i] > SCRIPT_SHARE * letters.sum())))
    return Model(tuple(found["lang"]), np.ascontiguousarray(np.array(scores).reshape(-1, BUCKETS).T.astype(np.float32)), np.array(masks, np.int64))


def word_scores(m: Model, w: Words, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score of each word in each language, letters of each word)."""
    if not len(w.start):
        return np.zeros((0, len(m.langs)), np.float32), np.zeros(0, np.int64)
    g, on = _grams(w.data, borders)
    each = m.scores[g]
    each[~on] = 0
    total = np.add.reduceat(each, w.start, axis=0)
    scripts = np.bitwise_or.reduceat(_SCRIPT[w.data], w.start)
    other = (scripts[:, None] & m.scripts[None, :]) == 0
    other &= ~other.all(1, keepdims=True)  # a script of no language narrows nothing
    letters = np.add.reduceat((_SCRIPT[w.data] > 0).astype(np.int64), w.start)
    return total + np.where(other, np.float32(OTHER_SCRIPT), np.float32(0)), letters


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH_PENALTY, segment: int = SEGMENT) -> np.ndarray:
    """The best label of every word; documents are ``first[i]:first[i + 1]``."""
    n_words, k = scores.shape
    label = np.zeros(n_words, np.int8)
    if n_words == 0 or k <= 1:
        return label
    sizes = np.diff(first)
    per = -(-sizes // segment)
    doc = np.repeat(np.arange(len(sizes)), per)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[:-1][doc] + rank * segment
    length = np.minimum(segment, first[1:][doc] - begin)
    order = np.argsort(-length, kind="stable")  # so that those still running are a prefix
    begin, length, rank_o, doc_o = begin[order], length[order], rank[order], doc[order]
    n = len(begin)
    switch = penalty * (1 - np.eye(k, dtype=np.float32))
    v = np.where((rank_o > 0)[:, None, None], -switch[None], np.float32(0)) + scores[begin][:, None, :]
    steps = int(length[0])
    best = np.zeros((steps, n, k), np.int8)
    stay = np.ones((steps, n, k, k), bool)
    running = np.searchsorted(-length, -np.arange(1, steps + 1), "right")
    for t in range(1, steps):
        a = running[t]
        now = v[:a]
        top = now.argmax(2)
        jump = np.take_along_axis(now, top[:, :, None], 2) - np.float32(penalty)
        keep = now >= jump
        best[t, :a], stay[t, :a] = top, keep
        v[:a] = np.where(keep, now, jump) + scores[begin[:a] + t][:, None, :]
    # join the segments of each document; place[j] is the segment's row in the sorted order
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    offset = np.concatenate([[0], np.cumsum(per)])
    docs = np.flatnonzero(per > 0)
    docs = docs[np.argsort(-per[docs], kind="stable")]
    deep = int(per.max())
    active = np.searchsorted(-per[docs], -np.arange(1, deep + 1), "right")
    total = np.zeros((len(docs), k), np.float64)
    came = np.zeros((deep, len(docs), k), np.int8)
    for r in range(deep):
        a = active[r]
        m = v[place[offset[docs[:a]] + r]]
        if r == 0:
            total[:a] = m[:, 0, :]
            continue
        through = total[:a, :, None] + m
        came[r, :a] = through.argmax(1)
        total[:a] = through.max(1)
    start, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    state = total.argmax(1)
    for r in range(deep - 1, -1, -1):
        a = active[r]
        at = place[offset[docs[:a]] + r]
        end[at] = state[:a]
        if r:
            state[:a] = came[r, np.arange(a), state[:a]]
            start[at] = state[:a]
    state = end
    for t in range(steps - 1, -1, -1):
        a = running[t]
        rows = np.arange(a)
        label[begin[:a] + t] = state[:a]
        if t:
            state[:a] = np.where(stay[t, rows, start[:a], state[:a]], state[:a], best[t, rows, start[:a]])
    return label


_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<first_word: int, n_words: int, lang: string>>"
_SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))


def _label(model, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        k = len(m.langs)
        for batch in batches:
            texts = batch.column("text")
            off, data = text_bytes(texts)
            pred, score, spans = [], [], []
            for lo, hi in blocks(off, 4 << 20):
                o = off[lo : hi + 1] - off[lo]
                w = Words(o, data[off[lo] : off[hi]])
                s, letters = word_scores(m, w, o) if k else (np.zeros((len(w.start), 0)), np.zeros(len(w.start), np.int64))
                label = viterbi(s, w.first)
                weight = np.zeros((hi - lo, max(k, 1)), np.int64)
                np.add.at(weight, (np.repeat(np.arange(hi - lo), np.diff(w.first)), label), letters)
                total, win = weight.sum(1), weight.argmax(1)
                for i in range(hi - lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    # rare letters outside the listed scripts still make a text one with letters
                    seen = k and (total[i] > 0 or any(map(str.isalpha, texts[lo + i].as_py() or "")))
                    pred.append(m.langs[win[i]] if seen else "und")
                    score.append(float(weight[i, win[i]] / total[i]) if seen and total[i] else 0.0)
                    if with_spans and seen:
                        cut = np.flatnonzero(np.diff(label[a:b])) + 1
                        edges = [0, *cut.tolist(), b - a]
                        spans.append([{"first_word": x, "n_words": y - x, "lang": m.langs[label[a + x]]} for x, y in zip(edges[:-1], edges[1:], strict=True) if y > x])
                    else:
                        spans.append([])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, _SPANS)], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    return run


def label(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_label(shared, with_spans), _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return label(docs, fit(docs.where(~held_out())))
