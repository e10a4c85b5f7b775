"""Substring dedup on a compacted De Bruijn graph of word k-mers.

Every window of ``width`` words is an edge between its first and last width - 1
words. Edges meet where they share an anchor: of the ``seed``-grams in a window, the
leftmost with the least hash, so equal windows have equal anchors at equal places
(minimum substring partitioning). Anchors seen once cannot lie in a repeat and go no
further. Neighbouring edges of one anchor are a path; where all occurrences of an
anchor carry the same path nothing branches, and the whole path is one row in the
joins. Only paths of anchors with several variants are opened into their edges.

Of equal edges the least (document, start) is the source, all others are repeats.
Repeats with the same source and shift join into spans, and the words at both
coordinates are compared by SHA-1 before a span counts.

A word goes if a repeat covers it. Null text has no words. Rows that repeat id and
text are one document and get equal results; rows with equal ids and other texts
share coordinates. A null id comes before all others. An empty table gives no rows;
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, Words, blocks, cut, inside, mix, ngrams, release_shuffles, remove_dir, row_key, shared_dir, signed, small_batches, spread_join, table, text_bytes

WIDTH, SEED = 20, 8


def _edges(h: np.ndarray, first: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, anchor place, anchor hash) of every window inside a document."""
    n = len(h) - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    g = ngrams(h, seed)
    best, place = g[:n].copy(), np.zeros(n, np.int32)
    for j in range(1, width - seed + 1):
        other = g[j : j + n]
        less = other < best
        np.copyto(best, other, where=less)
        place[less] = j
    at = np.flatnonzero(inside(first, len(h), width))
    return at, at + place[at], best[at]


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _per_document(column: pa.Array, width: int, seed: int):
    """Blocks as (row range, words, hashes, window starts, anchor places, anchor hashes)."""
    off, data = text_bytes(column)
    for lo, hi in blocks(off):
        w = Words(off[lo : hi + 1] - off[lo], data[off[lo] : off[hi]])
        h = w.hashes()
        yield lo, hi, w, h, *_edges(h, w.first, width, seed)


def _anchors(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w, _, _, place, anchor in _per_document(batch.column("text"), width, seed):
                r = _runs(place)
                p, a = place[r], anchor[r]
                cuts = np.searchsorted(p, w.first)
                off = pa.array(cuts, pa.int32())
                local = (p - np.repeat(w.first[:-1], np.diff(cuts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(lo, hi - lo), pa.ListArray.from_arrays(off, pa.array(signed(a))), pa.ListArray.from_arrays(off, pa.array(local))], names=["k", "anchors", "places"])

    return run


_PATH = "a long, d long, id long, start int, k long, n int, edges array<long>"


def _paths(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            for lo, hi, w, h, start, place, anchor in _per_document(batch.column("text"), width, seed):
                keep = np.zeros(len(h) + 1, bool)
                for i in range(lo, hi):
                    keep[w.first[i - lo] + np.asarray(places[i].values)] = True
                on = keep[place]
                start, place, anchor = start[on], place[on], anchor[on]
                if not len(start):
                    continue
                edge = ngrams(h, width)[start]
                r = _runs(place)
                size = np.diff(np.append(r, len(place)))
                within = np.arange(len(place)) - np.repeat(r, size)
                power = np.cumprod(np.full(width + 1, 0xD1342543DE82EF95, np.uint64))
                # a path is known by its edges in order, and where the anchor lies in them
                d = mix(np.add.reduceat(edge * power[within % (width + 1)], r) + size.astype(np.uint64) * np.uint64(width) + (place - start)[r].astype(np.uint64))
                doc = np.searchsorted(w.first, start[r], "right") - 1
                index = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(anchor[r])), pa.array(signed(d)), batch.column("id").take(index), pa.array((start[r] - w.first[doc]).astype(np.int32)), batch.column("k").take(index), pa.array(size.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.append(r, len(edge)), pa.int32()), pa.array(signed(edge))),
                    ],
                    names=["a", "d", "id", "start", "k", "n", "edges"],
                )

    return run


_OUT = "kind string, k long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, source long, at int, n int, digest binary"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _remove(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spans, asked = batch.column("spans").to_pylist(), batch.column("asked").to_pylist()
            off, data = text_bytes(batch.column("text"))
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("k").to_pylist()
            raw = data.tobytes()
            for i in range(batch.num_rows):
                words = Words(np.array([0, off[i + 1] - off[i]]), data[off[i] : off[i + 1]])
                text = raw[off[i] : off[i + 1]]
                n = len(words.start)
                word = text.split()  # bytes split at the same white space
                gone = np.zeros(n + 1, np.int32)
                for s in spans[i] or ():
                    gone[s["s"]] += 1
                    gone[s["e"] + width - 1] -= 1
                    size = s["e"] - s["s"] + width - 1
                    rows.append(("target", keys[i], ids[i], None, None, None, None, s["source"], s["at"], size, hashlib.sha1(b" ".join(word[s["s"] : s["s"] + size])).digest()))
                removed = np.cumsum(gone)[:n] > 0
                kept = b" ".join(word[j] for j in np.flatnonzero(~removed)) if removed.any() else b" ".join(word)
                rows.append(("row", keys[i], ids[i], n, int(removed.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text and removed.any() else None, None, None, None, None))
                for q in asked[i] or ():
                    rows.append(("source", keys[i], ids[i], None, None, None, None, q["source"], q["at"], q["n"], hashlib.sha1(b" ".join(word[q["at"] : q["at"] + q["n"]])).digest()))
                if len(rows) >= 2000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def _spans(docs: DataFrame, folder: str, width: int, seed: int) -> DataFrame:
    """Repeats as (k, s, e, source, at): windows s to e of document k repeat those of ``source`` from ``at``."""
    spark = docs.sparkSession
    anchors = cut(docs.select("k", "text").mapInArrow(_anchors(width, seed), "k long, anchors array<long>, places array<int>"), f"{folder}/anchors")
    again = anchors.select(F.explode("anchors").alias("a")).groupBy("a").count().where("count > 1").select("a")
    places = anchors.select("k", F.explode(F.arrays_zip("anchors", "places")).alias("z")).select("k", F.col("z.anchors").alias("a"), F.col("z.places").alias("p"))
    again = cut(again, f"{folder}/again")  # a plain table, so that Spark may split a hot anchor in the join
    wanted = places.join(again, "a", "left_semi").groupBy("k").agg(F.collect_set("p").alias("places"))
    wanted = cut(wanted, f"{folder}/places")
    remove_dir(spark, f"{folder}/anchors")
    remove_dir(spark, f"{folder}/again")
    release_shuffles(spark)
    paths = cut(docs.join(wanted, "k").select("id", "k", "text", "places").mapInArrow(_paths(width, seed), _PATH), f"{folder}/paths")
    remove_dir(spark, f"{folder}/places")
    release_shuffles(spark)
    here = F.struct("id", "start")
    first = cut(paths.groupBy("a", "d").agg(F.min(here).alias("first"), F.count("*").alias("n_same")), f"{folder}/first")
    release_shuffles(spark)
    n_paths = paths.count()
    by_anchor = first.groupBy("a").agg(F.count("*").alias("variants"), F.sum("n_same").alias("n_rows"))
    forks = cut(by_anchor.where("variants > 1").select("a", "n_rows"), f"{folder}/forks")  # anchors of several paths
    hot = F.broadcast(forks.where(F.col("n_rows") > max(1, int(n_paths * HOT_SHARE))))  # fewer than 1 / HOT_SHARE
    linear = first.where("n_same > 1").join(hot, "a", "left_anti").join(forks, "a", "left_anti").select("a", "d", "first")
    whole = cut(paths.select("a", "d", "id", "start", "k", "n").join(linear, ["a", "d"]).select("k", "id", "start", "n", "first"), f"{folder}/whole")
    release_shuffles(spark)
    branching = cut(spread_join(paths.select("a", "id", "start", "k", "edges"), forks, "a", "n_rows", n_paths, "left_semi").drop("a"), f"{folder}/branching")
    remove_dir(spark, f"{folder}/paths")
    release_shuffles(spark)
    edges = branching.select("k", "id", "start", F.posexplode("edges").alias("i", "edge")).select("edge", "k", "id", (F.col("start") + F.col("i")).cast("int").alias("start"))
    source = cut(edges.groupBy("edge").agg(F.min(here).alias("first"), F.count("*").alias("n_same")).where("n_same > 1"), f"{folder}/sources")
    release_shuffles(spark)
    n_edges = branching.agg(F.coalesce(F.sum(F.size("edges")), F.lit(0)).alias("n")).first().n
    single = spread_join(edges, source, "edge", "n_same", n_edges).select("k", "id", "start", F.lit(1).alias("n"), "first")
    later = whole.unionByName(single).where("NOT (id = first.id AND start = first.start)")
    later = later.select("k", F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e"), F.col("first.id").alias("source"), F.col("first.start").alias("at"), (F.col("first.start") - F.col("start")).alias("shift"))
    # neighbouring repeats of one source and shift are one span
    order = Window.partitionBy("k").orderBy("s", "e")
    fresh = F.coalesce((F.lag("e").over(order) < F.col("s")) | (F.lag("source").over(order) != F.col("source")) | (F.lag("shift").over(order) != F.col("shift")), F.lit(True))
    numbered = later.withColumn("island", F.sum(fresh.cast("int")).over(order))
    spans = cut(numbered.groupBy("k", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("source").alias("source"), F.min("at").alias("at")).drop("island"), f"{folder}/spans")
    for part in ("first", "whole", "branching", "forks", "sources"):
        remove_dir(spark, f"{folder}/{part}")
    release_shuffles(spark)
    return spans


def _parted(spans: DataFrame, wrong: DataFrame) -> DataFrame:
    """``spans`` without those of ``wrong(source, at, n)``, whose words differ although hashes agree: of n windows
    each is a span of its own, to be compared again; a single one is no repeat."""
    names = spans.columns
    marked = spans.withColumn("n", F.col("e") - F.col("s")).join(wrong.withColumn("bad", F.lit(True)), ["source", "at", "n"], "left")
    windows = marked.where("bad AND n > 1").withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    moved = {"s": F.col("s") + F.col("j"), "e": F.col("s") + F.col("j") + 1, "at": F.col("at") + F.col("j")}
    singles = windows.select(*(moved.get(c, F.col(c)).cast(spans.schema[c].dataType).alias(c) for c in names))
    return marked.where("bad IS NULL").select(*names).unionByName(singles)


def remove(docs: DataFrame, width: int = WIDTH, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept: the words that stay, null if all do; and k) of every row of ``docs``."""
    if not 1 <= seed <= width:
        raise ValueError("seed must lie between 1 and width")
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "substring-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", row_key())
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))  # coordinates are (id, start)
    spans, attempt = _spans(docs, folder, width, seed), 0
    while True:
        mine = spans.groupBy("k").agg(F.collect_list(F.struct("s", "e", "source", "at")).alias("spans"))
        asked = spans.select("source", "at", (F.col("e") - F.col("s") + width - 1).alias("n")).distinct()
        asked = asked.groupBy(F.col("source").alias("id")).agg(F.collect_list(F.struct("source", "at", "n")).alias("asked"))
        ids = docs.select("id", "k").join(asked, "id").select("k", "asked").dropDuplicates(["k"])
        both = mine.join(ids, "k", "full")
        out = cut(docs.join(both, "k", "left").select("k", "doc_id", "text", "spans", "asked").mapInArrow(_remove(width, with_text), _OUT), f"{folder}/out-{attempt}")
        key = ["source", "at", "n"]
        # a span counts if a document of its source's id has the same words there
        seen = out.where("kind = 'source'").select(*key, "digest").distinct()
        wrong = out.where("kind = 'target'").select(*key, "digest").distinct().join(seen, [*key, "digest"], "left_anti").select(*key).distinct()
        if wrong.isEmpty():
            break
        wrong = wrong.select("source", "at", (F.col("n") - (width - 1)).alias("n"))
        spans, attempt = cut(_parted(spans, wrong), f"{folder}/spans-{attempt}"), attempt + 1
    rows = out.where("kind = 'row'")
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256", *(["k", "kept"] if with_text else []))


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated words; rows of which no word is left go, ``n_chars`` follows the text."""
    found = remove(docs, with_text=True).where("n_removed > 0").select(F.col("k").alias("_k"), F.col("kept").alias("_kept")).dropDuplicates(["_k"])
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("_k")).join(found, "_k", "left").where("_kept IS NULL OR _kept <> ''")
    text = F.coalesce("_kept", "row.text")
    columns = [text.alias(c) if c == "text" else F.when(F.col("_kept").isNull(), F.col("row.n_chars")).otherwise(F.char_length("_kept")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return rows.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"))
