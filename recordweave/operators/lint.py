"""The whole of a record's checks as two frames: violations, and findings by class.

Extraction happens once: citations, directives and references are scanned and written
to the session's cache by the caller if it wants to; every check derives from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import STATUSES, Catalog, remotes_frame
from ..functions import scanner
from ..functions import text as T
from . import checks, citations, identity, links, remotes, views


@dataclass(frozen=True)
class Record:
    """The relations that checks read: files(path, text), documents, and, where there are any,
    journal entries, the locks of remotes as (remote, code), what views should hold and what
    is on disk in their place (both path, text), the text of the index of pages with the pages
    it should name, and declared statuses as (scheme, status)."""

    files: DataFrame
    docs: DataFrame
    entries: DataFrame | None = None
    lock: DataFrame | None = None
    rendered: DataFrame | None = None
    on_disk: DataFrame | None = None
    pages: DataFrame | None = None
    index: DataFrame | None = None
    statuses: DataFrame | None = None


def remote_shapes(c: Catalog) -> tuple[tuple[str, str], ...]:
    """Of each remote, longest prefix first: its lead (prefix and delimiter) and the pattern of its codes."""
    return tuple((r.prefix + r.delim, r.uid or r"[A-Z]{2,10}-\d{1,4}") for r in c.remote_order())


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def wikilinks(files: DataFrame, docs: DataFrame, remotes: DataFrame | None = None) -> DataFrame:
    """(path, line, inner, label, target): a code's document, a remote's URL, or null; a page does not link to itself."""
    found = scanner.scan_wikilinks(files).withColumn("code", T.canonical(F.col("inner")))
    rows = found.join(docs.select("code", F.col("path").alias("doc_path")), "code", "left")
    target = F.when(F.col("doc_path") != F.col("path"), F.col("doc_path"))
    if remotes is not None:
        rows = rows.join(F.broadcast(remotes.select(F.concat("prefix", "delim", "tail").alias("inner"), "link")), "inner", "left")
        target = F.coalesce(F.nullif("link", F.lit("")), target)
    return rows.select("path", "line", "inner", "label", target.alias("target"))


def bare_references(files: DataFrame, docs: DataFrame, c: Catalog, principle: str = "DP") -> DataFrame:
    """References in prose that have a target and are not links yet."""
    schemes = tuple(s.prefix for s in c.schemes)
    refs = scanner.scan_references(files, schemes, remote_shapes(c)).where("kind <> 'remote'")
    # a number that a principle has is ambiguous; the plan asks for it, no job runs here
    highest = docs.where(F.col("scheme") == principle).agg(F.coalesce(F.max("number"), F.lit(0))).scalar()
    return identity.resolve(refs, docs, c.issue_url, highest).where("target IS NOT NULL").select("path", "line", "text", "target")


def hand_links(files: DataFrame, c: Catalog) -> DataFrame:
    """(path, line, prefix, tail, target) of links whose label is a code of another project."""
    lines = files.where(F.contains("text", F.lit("]("))).select("path", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    each = lines.select("path", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("l", F.lit(r"\[[^\]\n]+\]\([^)\s]+\)"), F.lit(0))).alias("m"))
    label, target = F.regexp_extract("m", r"^\[([^\]]+)\]", 1), F.regexp_extract("m", r"\(([^)]+)\)$", 1)
    prefix, tail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(c.remote_order()):  # the longest prefix decides last
        import re

        shape = rf"^{re.escape(r.prefix + r.delim)}({r.uid or '[A-Za-z]+-[0-9]+'})$"
        prefix, tail = F.when(label.rlike(shape), F.lit(r.prefix)).otherwise(prefix), F.when(label.rlike(shape), F.regexp_extract(label, shape, 1)).otherwise(tail)
    return each.select("path", "line", prefix.alias("prefix"), tail.alias("tail"), target.alias("target")).where("prefix IS NOT NULL")


def violations(r: Record, c: Catalog) -> DataFrame:
    """(check, path, message): what always fails."""
    out = []
    for s in c.schemes:
        own = r.docs.where(F.col("scheme") == s.prefix)
        at = own.select("code", "path")
        named = lambda df, check, message, at=at: df.join(at, "code").select(F.lit(check).alias("check"), "path", message.alias("message"))
        out.append(named(checks.frontmatter(own, s.requires), "frontmatter", F.col("problem")))
        out.append(named(checks.titles(own), "title", F.concat(F.lit("title and heading differ: "), "title")))
        out.append(named(checks.versions(own), "version", F.concat(F.lit("version "), F.col("version").cast("string"), F.lit(" is not in its history"))))
        if s.tag_groups:
            out.append(named(checks.tag_groups(own, s.tag_groups), "tags", F.concat_ws(" ", "group", "rule", "tags")))
    if r.entries is not None:
        out.append(checks.journals(r.entries).select(F.lit("journal").alias("check"), "path", F.col("problem").alias("message")))
    if r.rendered is not None and r.on_disk is not None:
        out.append(views.staleness(r.rendered, r.on_disk).select(F.lit("view").alias("check"), "path", F.col("state").alias("message")))
    if r.pages is not None and r.index is not None:
        out.append(checks.unindexed(r.pages, r.index).select(F.lit("index").alias("check"), "path", F.lit("the index does not name this page").alias("message")))
    if r.statuses is not None:
        odd = r.statuses.where(~F.col("status").isin(*STATUSES))
        out.append(odd.select(F.lit("status").alias("check"), F.col("scheme").alias("path"), F.concat(F.lit("outside the vocabulary: "), "status").alias("message")))
    bare = bare_references(r.files, r.docs, c)
    out.append(bare.select(F.lit("bare-reference").alias("check"), "path", F.concat(F.col("line").cast("string"), F.lit(": "), "text", F.lit(" -> "), "target").alias("message")))
    wiki = wikilinks(r.files, r.docs)
    out.append(wiki.select(F.lit("wikilink").alias("check"), "path", F.concat(F.col("line").cast("string"), F.lit(": [["), "inner", F.lit("]] "), F.when(F.col("target").isNull(), "resolves to nothing").otherwise("is not a link yet")).alias("message")))
    return _union(out)


def findings(r: Record, c: Catalog, existing: DataFrame | None = None) -> DataFrame:
    """(class, message, fails): what is reported, and fails where the catalog says so."""
    numbered = r.docs.where("number IS NOT NULL")
    directives = scanner.scan_directives(r.files)
    unlinted = directives.where("name = 'unlinted' AND scope = 'file'").select("path").distinct()
    spark, shapes, leads = r.files.sparkSession, remote_shapes(c), {r.prefix: r.prefix + r.delim for r in c.remotes}
    lock = r.lock and r.lock.replace(leads, subset=["remote"]).withColumnRenamed("remote", "lead")
    cites = citations.extract(r.files.join(unlinted, "path", "left_anti"), tuple(s.prefix for s in c.schemes), r.docs, shapes, lock)
    annots = citations.annotations(directives, numbered, shapes, lock)
    sound = annots.where("problem IS NULL")  # a malformed annotation excuses nothing, and is not stale besides
    found = citations.classify(cites, numbered, sound)
    n = lambda k: F.col(k).cast("string")
    named = lambda df, kind, message: df.select(F.lit(kind).alias("class"), message.alias("message"))
    counted = F.concat("code", F.lit(": "), n("loud"), F.lit(" unacknowledged in "), n("files"), F.lit(" files"))
    out = [
        named(citations.flagged(found), "retired-citations", counted),
        named(citations.flagged(found, "dangling"), "unresolved-codes", counted),
        named(unlinted, "unlinted-files", F.col("path")),
        named(checks.uniform_status(r.docs), "inert-status", F.concat("scheme", F.lit(": all "), n("n"), F.lit(" are "), "status")),
        named(citations.stale_annotations(sound, found, numbered), "stale-directives", F.concat("path", F.lit(": "), "kind", F.lit(" "), "code", F.lit(" — "), "reason")),
        named(annots.where("problem IS NOT NULL").select("path", "line", "problem").distinct(), "stale-directives", F.concat("path", F.lit(":"), n("line"), F.lit(" "), "problem")),
        named(citations.pending(numbered, found), "pending-documents", F.concat("code", F.lit(" ("), "status_word", F.lit("): "), n("cites"), F.lit(" citations"))),
    ]
    if c.schemes:
        old = identity.legacy_spellings(scanner.scan_references(r.files, tuple(s.prefix for s in c.schemes), shapes), r.docs)
        out.append(named(old.distinct(), "legacy-spellings", F.concat("path", F.lit(":"), n("line"), F.lit(" "), "old", F.lit(" is "), "code")))
    if c.remotes:
        by_hand = hand_links(r.files, c)
        files = spark.createDataFrame([], "remote string, code string, filename string") if r.lock is None or "filename" not in r.lock.columns else r.lock
        urls = remotes.ladder(by_hand.select("prefix", "tail").distinct(), remotes_frame(spark, c), files).select("prefix", "tail", "link")
        acks = directives.where("name = 'url-ok'").select("path", F.explode("args").alias("code"), "lo", "hi")
        out.append(named(links.hand_written(by_hand, urls, acks), "hand-written-urls", F.concat("path", F.lit(":"), n("line"), F.lit(" "), "target", F.lit(" is not "), "link")))
    if existing is not None:
        bases = r.files.select("path", F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("base"))
        acks = directives.where("name = 'target-ok'").select("path", F.explode("args").alias("target"), "lo", "hi")
        out.append(named(links.broken(links.targets(r.files), bases, existing, acks), "broken-targets", F.concat("path", F.lit(":"), n("line"), F.lit(" "), "target")))
    if c.narrow_terms:
        broad = directives.where("name = 'broad-ok'").select("path", F.explode("args").alias("t")).groupBy("path").agg(F.collect_set(F.lower("t")).alias("terms"))
        acked = r.docs.select("code", "path").join(broad, "path").select("code", "terms")
        general = [s.prefix for s in c.schemes if s.titles_generalize]
        out.append(named(checks.narrow_titles(r.docs.where(F.col("scheme").isin(general)), list(c.narrow_terms), acked), "narrow-titles", F.concat("code", F.lit(": "), F.array_join("terms", ", "))))
    return checks.enforce(_union(out), c.fail_on)


def report(classified: DataFrame, docs: DataFrame, state: str = "retired", sites: int = 20) -> DataFrame:
    """(code, text): a code's heading, its counts, and up to ``sites`` of its places."""
    counts = citations.flagged(classified, state)
    lines = citations.spread(classified, state, sites).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("pick", "path", "line"))).alias("xs"))
    listed = F.array_join(F.transform("xs", lambda x: F.concat(F.lit("- "), x["path"], F.lit(":"), x["line"].cast("string"))), "\n")
    rows = counts.join(lines, "code").join(docs.select("code", "title", "status"), "code", "left")
    title = F.concat(F.lit("## "), "code", F.coalesce(F.concat(F.lit(" — "), "title", F.lit(" ("), "status", F.lit(")")), F.lit("")))
    return rows.select("code", F.concat(title, F.lit("\n\n"), T.plural(F.col("loud"), "site"), F.lit(" in "), T.plural(F.col("files"), "file"), F.lit("\n\n"), listed).alias("text"))


def expand_wikilinks(files: DataFrame, targets: dict[str, str]) -> DataFrame:
    """(path, text, n): wikilinks with a known target as links; their label stays if they have one."""

    def one(text: str) -> tuple[str, int]:
        hide = scanner.Cover([*scanner.fences(text), *scanner.inline_code(text), *(m.span() for m in scanner.COMMENT.finditer(text))])
        out, at, n = [], 0, 0
        for m in scanner.HIDING[-1].finditer(text):
            target = targets.get(m[1].strip())
            if target is None or m.start() in hide:
                continue
            out += [text[at : m.start()], f"[{(m[2] or m[1]).strip()}]({target})"]
            at, n = m.end(), n + 1
        return "".join([*out, text[at:]]), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [one(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([t for t, _ in done]), pa.array([n for _, n in done], pa.int32())], names=["path", "text", "n"])

    return files.where(F.contains("text", F.lit("[["))).select("path", "text").mapInArrow(run, "path string, text string, n int").where("n > 0")


def settle_codes(files: DataFrame, allocated: DataFrame) -> DataFrame:
    """(path, text): provisional codes respelled by ``allocated(scheme, tail, code)``, in upper and lower case.

    Files are joined with the few codes they hold, so no list of all codes travels.
    """
    shape = r"\b[A-Za-z]+-tmp[a-z0-9]{5}\b"
    held = files.where(F.col("text").rlike(shape)).select("path", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(shape), F.lit(0)))).alias("m"))
    new = allocated.select(F.concat_ws("-", "scheme", "tail").alias("old"), F.col("code").alias("new"))
    found = held.withColumn("old", F.concat(F.upper(T.code_prefix(F.col("m"))), F.lit("-"), T.code_tail(F.col("m")))).join(new, "old")
    pairs = found.groupBy("path").agg(F.any_value("text").alias("text"), F.array_sort(F.collect_list(F.struct("m", F.when(F.col("m") == F.col("old"), F.col("new")).otherwise(F.lower("new")).alias("to")))).alias("xs"))
    return pairs.select("path", F.aggregate("xs", F.col("text"), lambda t, x: F.replace(t, x["m"], x["to"])).alias("text"))


def stamp_formerly(docs: DataFrame) -> DataFrame:
    """(path, text): ``docs(path, text, old)`` with their old code recorded in the frontmatter, once."""
    line = F.concat(F.lit("formerly: ["), "old", F.lit("]\n"))
    there = F.regexp_extract("text", r"(?m)^formerly: \[([^\]]*)\]", 1)
    text = (
        F.when(F.contains(F.concat(F.lit(", "), there, F.lit(",")), F.concat(F.lit(", "), "old", F.lit(","))), F.col("text"))
        .when(there != "", F.replace("text", F.concat(F.lit("formerly: ["), there, F.lit("]")), F.concat(F.lit("formerly: ["), there, F.lit(", "), "old", F.lit("]"))))
        .when(F.startswith("text", F.lit("---\n")), F.concat(F.lit("---\n"), line, F.substring("text", F.lit(5), F.length("text"))))
        .otherwise(F.concat(F.lit("---\n"), line, F.lit("---\n"), "text"))
    )
    return docs.select("path", text.alias("text"))


def section_paths(lines: DataFrame, sections: tuple[str, ...], mapping: dict[str, str]) -> DataFrame:
    """Lines of a TOML file (path, line_no, line) with mapped paths, only under the given sections."""
    header = F.regexp_extract("line", r"^\s*\[([^\]]+)\]", 1)
    carried = F.last(F.nullif(header, F.lit("")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line_no"))
    inside = reduce(lambda a, b: a | b, (carried.startswith(s) for s in sections))
    moved = reduce(lambda x, kv: F.replace(x, F.lit(f'"{kv[0]}"'), F.lit(f'"{kv[1]}"')), mapping.items(), F.col("line"))
    return lines.select("path", "line_no", F.when(F.coalesce(inside, F.lit(False)), moved).otherwise(F.col("line")).alias("line"))
