"""Quality rules: base counts and distribution divergence, in DataFrame functions only.

Two histograms of a document, of character classes and of common words, are compared
with those of every language of the corpus by Jensen-Shannon distance; a document is
judged by the nearest language. Short documents are not judged (a histogram of a few
words says nothing). The references are counted over all documents.

Null or empty text has no words and fails the base rule; a null language adds nothing
to the references; with no references only the base rule decides; equal rows are
judged alike; an empty table gives no rows; ``judge`` takes its columns from doc_id,
text and lang alone, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The contract's white space and symbols.
WORD_BREAK, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: A word is common in a language if it is so large a share of its words; that bounds a language to 500.
COMMON_SHARE = 0.002
#: Documents with fewer words are not judged by divergence.
MIN_WORDS = 50
#: A document is rejected beyond these distances (base-2, 0 to 1) from every language.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.5
_CLASSES = ("ascii", "letter", "digit", "mark", "symbol", "space", "other")


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it by ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Words in windows of eight that occur twice: sort the windows' hashes, keep starts
#: with an equal neighbour, and add up what each start covers anew.
_REPEATED = "CASE WHEN size(array_distinct(w8)) = size(w8) THEN 0L ELSE " + _let(
    "sort_array(transform(w8, (x, i) -> struct(x AS h, i AS i)))",
    "s",
    """aggregate(
        sort_array(transform(
            filter(transform(s, (x, j) -> struct(x.i AS i, (j > 0 AND get(s, j - 1).h = x.h) OR coalesce(get(s, j + 1).h = x.h, false) AS twice)), y -> y.twice),
            y -> y.i)),
        struct(0L AS n, -8 AS last),
        (a, i) -> struct(a.n + least(8, i - a.last) AS n, i AS last),
        a -> a.n)""",
) + " END"


def _words() -> Column:
    return F.array_remove(F.split(F.coalesce("text", F.lit("")), WORD_BREAK), "")


def measure(docs: DataFrame) -> DataFrame:
    """Base counts and character classes of every document, with its words."""
    text = F.coalesce("text", F.lit(""))
    carried = [c for c in docs.columns if c == "row"]
    plain = docs.select("doc_id", "lang", *carried, text.alias("text"), _words().alias("words"))
    lines = plain.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn("rest", F.regexp_replace("text", "[A-Za-z]+", ""))
    counted = lines.select(
        "doc_id", "lang", "words", *carried,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("rest") - F.char_length(F.regexp_replace("rest", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.char_length("text").cast("long").alias("n_chars"),
        (F.char_length("text") - F.char_length("rest")).cast("long").alias("ascii"),
        (F.char_length("rest") - F.char_length(F.regexp_replace("rest", r"\p{L}", ""))).cast("long").alias("letter"),
        (F.char_length("rest") - F.char_length(F.regexp_replace("rest", r"[0-9]", ""))).cast("long").alias("digit"),
        (F.char_length("rest") - F.char_length(F.regexp_replace("rest", r"[.,;:!?'\"()-]", ""))).cast("long").alias("mark"),
    )
    # no lambda names a column: Spark may put a column's expression in its place, to be computed for each element
    w8 = _let("transform(words, w -> xxhash64(w))", "wh", "CASE WHEN size(wh) < 8 THEN array() ELSE transform(sequence(1, size(wh) - 7), i -> xxhash64(slice(wh, i, 8))) END")
    return (
        counted.withColumn("w8", F.expr(w8))
        .withColumn("n_repeat_words", F.expr(_REPEATED))
        .withColumn("symbol", F.col("n_symbols"))
        .withColumn("space", F.col("n_chars") - F.col("word_chars"))
        .withColumn("other", F.greatest(F.lit(0), F.col("n_chars") - sum((F.col(c) for c in _CLASSES[:-1]), F.lit(0))))
        .drop("w8")
    )


def references(docs: DataFrame, common_share: float = COMMON_SHARE) -> list[dict]:
    """Of each language: shares of character classes, and of its common words (at most 1 / common_share)."""
    known = docs.where("lang is not null")
    base = known.select("lang", F.coalesce("text", F.lit("")).alias("text"), F.explode(_words()).alias("word"))
    counts = base.groupBy("lang", "word").count()
    totals = counts.groupBy("lang").agg(F.sum("count").alias("total"))
    common = counts.join(F.broadcast(totals), "lang").where(F.col("count") >= F.col("total") * common_share).select("lang", "word", (F.col("count") / F.col("total")).alias("share"))
    rest = F.regexp_replace(F.coalesce("text", F.lit("")), "[A-Za-z]+", "")
    left = lambda pattern: F.sum(F.char_length("rest") - F.char_length(F.regexp_replace("rest", pattern, "")))
    chars = known.select("lang", F.char_length("text").alias("n"), rest.alias("rest")).groupBy("lang").agg(
        F.sum("n").alias("n_chars"), F.sum(F.col("n") - F.char_length("rest")).alias("ascii"), left(r"\p{L}").alias("letter"), left("[0-9]").alias("digit"),
        left(r"[.,;:!?'\"()-]").alias("mark"), left(SYMBOLS).alias("symbol"), left(r"[\x20\x09-\x0D]").alias("space"),
    )
    words: dict[str, dict[str, float]] = {}
    for r in common.collect():  # one row per language and common word
        words.setdefault(r.lang, {})[r.word] = r.share
    found = []
    for r in sorted(chars.collect(), key=lambda r: r.lang):
        if r.n_chars and r.lang in words:
            classes = [r[c] / r.n_chars for c in _CLASSES[:-1]]
            found.append({"lang": r.lang, "classes": [*classes, max(0.0, 1 - sum(classes))], "words": dict(sorted(words[r.lang].items()))})
    return found


def _term(p: str, q: str) -> str:
    """Half of p and half of q against their mean, in bits."""
    return f"(CASE WHEN {p} > 0 THEN 0.5 * {p} * log2(2 * {p} / ({p} + {q})) ELSE 0.0D END + CASE WHEN {q} > 0 THEN 0.5 * {q} * log2(2 * {q} / ({p} + {q})) ELSE 0.0D END)"


def _text(s: str) -> str:
    return "'" + "".join(c if c.isalnum() else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}" for c in s) + "'"


def distances(measured: DataFrame, refs: list[dict]) -> DataFrame:
    """char_distance and word_distance to the nearest language (null without references)."""
    if not refs:
        return measured.withColumn("char_distance", F.lit(None).cast("double")).withColumn("word_distance", F.lit(None).cast("double"))
    vocabulary = sorted({w for r in refs for w in r["words"]})
    # runs of the sorted common words are their counts
    common = f"sort_array(filter(words, w -> w IN ({', '.join(map(_text, vocabulary))})))"
    runs = _let(common, "s", _let("filter(sequence(0, size(s)), i -> i = size(s) OR i = 0 OR get(s, i) <> get(s, i - 1))", "b", "transform(slice(b, 1, size(b) - 1), (x, j) -> struct(get(s, x) AS w, (get(b, j + 1) - x) / nw AS p))"))
    runs = _let("n_words", "nw", runs)
    rows = measured.withColumn("runs", F.expr(f"CASE WHEN n_words < {MIN_WORDS} THEN NULL ELSE {runs} END")).withColumn(
        "classes", F.expr(f"CASE WHEN n_words < {MIN_WORDS} THEN NULL ELSE array({', '.join(f'{c} / n_chars' for c in _CLASSES)}) END")
    )
    by_char, by_word = [], []
    for r in refs:
        qs = ", ".join(f"{q!r}D" for q in r["classes"])
        by_char.append(f"aggregate(zip_with(classes, array({qs}), (p, q) -> {_term('p', 'q')}), 0.0D, (a, x) -> a + x)")
        table_ = ", ".join(f"{_text(w)}, {q!r}D" for w, q in r["words"].items())
        total = sum(r["words"].values())
        zero = "0.0D"
        joined = f"transform(runs, x -> struct(x.p AS p, coalesce(element_at(map({table_}), x.w), {zero}) AS q))"
        rest = f"greatest(0.0D, 1 - aggregate(v, {zero}, (a, x) -> a + x.p))"
        body = f"aggregate(v, {zero}, (a, x) -> a + {_term('x.p', 'x.q')}) + 0.5 * greatest(0.0D, {total!r}D - aggregate(v, {zero}, (a, x) -> a + x.q)) + " + _let(rest, "pr", _term("pr", f"{max(0.0, 1 - total)!r}D"))
        by_word.append(_let(joined, "v", body))
    least = lambda parts: F.expr(_let(f"array_min(array({', '.join(parts)}))", "d", "CASE WHEN d > 0 THEN sqrt(d) WHEN d IS NOT NULL THEN 0.0D END"))
    return rows.withColumn("char_distance", least(by_char)).withColumn("word_distance", least(by_word)).drop("runs", "classes")


def judge(docs: DataFrame, refs: list[dict] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, char_distance, word_distance and kept, one row per row of ``docs``."""
    refs = references(docs) if refs is None else refs
    rows = distances(measure(docs), refs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    near = F.coalesce(F.col("char_distance") <= MAX_CHAR_DISTANCE, F.lit(True)) & F.coalesce(F.col("word_distance") <= MAX_WORD_DISTANCE, F.lit(True))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & near).select(
        *(c for c in docs.columns if c == "row"), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    rows = docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("row"))
    # Spark puts what a filter names in place of the name, and so repeats it, unless the
    # projection below also makes a value that must not be made twice: the row number
    judged = judge(rows, references(docs)).select("row", "kept", F.monotonically_increasing_id().alias("at"))
    return judged.where("kept AND at >= 0").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
