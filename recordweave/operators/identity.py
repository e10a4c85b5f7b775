"""Identities: allocation of numbers, aliases of old codes, and rewrites of codes in text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scanner
from ..functions import text as T


def next_number(docs: DataFrame) -> DataFrame:
    """(scheme, next): one more than the largest number."""
    return docs.groupBy("scheme").agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("next"))


def allocate(pending: DataFrame, docs: DataFrame) -> DataFrame:
    """Numbers for ``pending(scheme, tail, committed_at, path)`` after the taken ones, in merge order."""
    order = Window.partitionBy("scheme").orderBy(F.asc_nulls_last("committed_at"), "path")
    taken = next_number(docs.where("number IS NOT NULL"))
    rows = pending.join(F.broadcast(taken), "scheme", "left").withColumn("number", (F.coalesce("next", F.lit(1)) - 1 + F.row_number().over(order)).cast("int"))
    return rows.select("scheme", "tail", "number", T.code(F.col("scheme"), F.col("number")).alias("code"), "path")


def aliases(docs: DataFrame) -> DataFrame:
    """(old, code): former codes and the document that has them now; the last document wins."""
    each = docs.select("code", "number", F.explode("formerly").alias("old")).withColumn("old", T.canonical(F.col("old")))
    return each.groupBy("old").agg(F.max_by("code", F.struct("number", "code")).alias("code"))


def step_forward(entries: DataFrame) -> DataFrame:
    """Distinct seconds for the entries of a journal: one that collides moves on to the next free second.

    In order of (second, path), an entry's place is its rank plus the running maximum of
    (second - rank). Ranks and maxima run within a journal's day and are carried from day
    to day by one row each, so a run that crosses midnight goes on and no task orders more
    than a day of entries.
    """
    day = Window.partitionBy("journal", "day").orderBy("sec", "path")
    rows = entries.withColumn("sec", F.unix_timestamp("created")).withColumn("day", F.to_date("created")).withColumn("nth", F.row_number().over(day))
    rows = rows.withColumn("high", F.max(F.col("sec") - F.col("nth")).over(day.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy("journal").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("journal", "day").agg(F.count("*").alias("n"), F.max("high").alias("top")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    days = days.withColumn("carried", F.max(F.col("top") - F.col("before")).over(earlier)).select(F.col("journal").alias("j"), F.col("day").alias("d"), "before", "carried")
    rows = rows.join(days, F.col("journal").eqNullSafe(F.col("j")) & F.col("day").eqNullSafe(F.col("d")))
    assigned = F.greatest(F.col("high") - F.col("before"), "carried") + F.col("before") + F.col("nth")
    return rows.withColumn("assigned", assigned).drop("day", "nth", "sec", "high", "j", "d", "before", "carried")


def legacy_spellings(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """References by a tail whose document has a number now: (path, line, old, code)."""
    old = refs.where("kind = 'scheme' AND tail <> ''").select("path", "line", F.concat_ws("-", "prefix", "tail").alias("old"))
    live = docs.where("tail IS NOT NULL").select(F.col("code").alias("old"))
    return old.join(live, "old", "left_anti").join(docs.select("code", F.explode("formerly").alias("old")), "old").select("path", "line", "old", "code")


def resolve(refs: DataFrame, docs: DataFrame, issue_url: str, highest: int | Column = 0) -> DataFrame:
    """References with their target: a document's path, an issue's URL, or null.

    A low ``#N`` without a cue is ambiguous and has none; nor has a document's own code.
    """
    code = F.when(F.col("tail") != "", F.concat_ws("-", "prefix", "tail")).otherwise(T.code(F.col("prefix"), F.col("num")))
    rows = refs.withColumn("code", F.when(F.col("kind") == "scheme", code)).join(docs.select("code", F.col("path").alias("doc_path")), "code", "left")
    issue = F.when((F.col("num") > highest) | F.col("cued"), F.replace(F.lit(issue_url), F.lit("{n}"), F.col("num").cast("string")))
    target = F.when(F.col("kind") == "issue", issue).when((F.col("kind") == "scheme") & (F.col("doc_path") != F.col("path")), F.col("doc_path"))
    return rows.withColumn("target", target)


def rename_plan(docs: DataFrame, old: str, new: str) -> DataFrame:
    """(old, new, path, new_path) of every document of a scheme under its new prefix."""
    rows = docs.where((F.col("scheme") == old) & F.col("number").isNotNull())
    fresh = T.code(F.lit(new), F.col("number"))
    return rows.select(F.col("code").alias("old"), fresh.alias("new"), "path", F.regexp_replace("path", rf"{old}-(\d+)([^/]*)$", f"{new}-$1$2").alias("new_path"))


def sweep(files: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(path, text, n): codes of ``mapping`` (a migration's, small) respelled outside ``formerly`` blocks.

    Padding is kept as it was written; files without any mapped prefix are not read by Python.
    """
    import re

    old = sorted({c.rpartition("-")[0] for c in mapping})
    pattern = re.compile(rf"\b({'|'.join(map(re.escape, old))})([- ])(\d{{1,4}})\b")
    formerly = re.compile(r"^formerly:.*(?:\n[ \t]+.*|\n[ \t]*-.*)*", re.M)

    def one(text: str) -> tuple[str, int]:
        keep, n, out, at = scanner.Cover(m.span() for m in formerly.finditer(text)), 0, [], 0
        for m in pattern.finditer(text):
            new = mapping.get(f"{m[1]}-{int(m[3]):03d}")
            if new is None or m.start() in keep:
                continue
            prefix, _, number = new.rpartition("-")
            digits = str(int(number)).zfill(len(m[3])) if number.isdigit() else number
            out += [text[at : m.start()], f"{prefix}{m[2]}{digits}"]
            at, n = m.end(), n + 1
        return "".join([*out, text[at:]]), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [one(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([t for t, _ in done]), pa.array([n for _, n in done], pa.int32())], names=["path", "text", "n"])

    return files.where(F.col("text").rlike("|".join(map(re.escape, old)))).select("path", "text").mapInArrow(run, "path string, text string, n int").where("n > 0")


def linkify(files: DataFrame, targets: dict[str, str], schemes: tuple[str, ...]) -> DataFrame:
    """(path, text, n): bare codes with a known target as links; HTML blocks get anchors. Applying it twice changes nothing."""

    def one(path: str, text: str) -> tuple[str, int]:
        raw, out, at, n = scanner.Cover(scanner.html_blocks(text)), [], 0, 0
        for r in scanner.references(text, schemes):
            code = f"{r.prefix}-{r.num:03d}" if r.kind == "scheme" and r.num is not None else None
            target = targets.get(code) if code else None
            if target is None or target == path:
                continue
            out += [text[at : r.start], f'<a href="{target}">{r.text}</a>' if r.start in raw else f"[{r.text}]({target})"]
            at, n = r.end, n + 1
        return "".join([*out, text[at:]]), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [one(p, t or "") for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([t for t, _ in done]), pa.array([n for _, n in done], pa.int32())], names=["path", "text", "n"])

    return files.select("path", "text").mapInArrow(run, "path string, text string, n int").where("n > 0")
