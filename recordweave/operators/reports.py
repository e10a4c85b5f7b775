"""Reports and listings as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

PENDING_ORDER = (F.asc_nulls_last, "date"), (F.desc, "cites"), (F.asc, "code")


def in_pending_order(pending: DataFrame) -> DataFrame:
    """Oldest first, undated last; of a date the most cited first."""
    return pending.orderBy(*(how(c) for how, c in PENDING_ORDER))


def pending_report(pending: DataFrame, docs: DataFrame, base: str) -> DataFrame:
    """(block, date, cites, code, line): 1 the table of undecided documents, 2 those that nothing cites."""
    rows = pending.join(docs.select("code", "path"), "code")
    link = F.concat(F.lit("["), "code", F.lit("]("), P.relative(F.col("path"), F.lit(base)), F.lit(")"))
    cells = [F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("undated")), F.col("status_word"), link, F.col("cites").cast("string"), F.col("unacknowledged").cast("string"), F.col("title")]
    table = rows.select(F.lit(1).alias("block"), "date", "cites", "code", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return table.unionByName(rows.where("cites = 0").select(F.lit(2).alias("block"), "date", "cites", "code", link.alias("line")))


def pending_console(pending: DataFrame, as_of: str, stale_days: int, code_width: int = 8) -> DataFrame:
    """(date, cites, code, line): age in days or ``?``, ``!`` where it is stale, status, code, citations, title."""
    age = T.age_days(F.col("date"), F.lit(as_of).cast("date"))
    shown = F.coalesce(F.concat(age.cast("string"), F.lit("d")), F.lit("?"))
    left = lambda c, n: F.when(F.length(c) < n, F.lpad(c, n, " ")).otherwise(c)
    right = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    mark = F.when(T.is_stale(F.col("date"), F.lit(as_of).cast("date"), stale_days), "!").otherwise(" ")
    line = F.concat(left(shown, 6), mark, F.lit(" "), right(F.col("status_word"), 8), F.lit("  "), right(F.col("code"), code_width), F.lit("  "), left(F.col("cites").cast("string"), 5), F.lit("  "), "title")
    return pending.select("date", "cites", "code", line.alias("line"))


def pending_sentence(headline: DataFrame, stale_days: int) -> DataFrame:
    """(line,): the one row of a headline in words."""
    n = lambda c: F.col(c).cast("string")
    parts = F.array(
        F.concat(n("n"), F.lit(" undecided document(s)")),
        F.concat(F.lit("oldest "), n("oldest"), F.lit(" days")),
        F.when(F.col("stale") > 0, F.concat(n("stale"), F.lit(f" over {stale_days} days"))),
        F.when(F.col("undated") > 0, F.concat(n("undated"), F.lit(" undated"))),
        F.when(F.col("relied_on") != F.col("n"), F.concat(n("relied_on"), F.lit(" with unacknowledged references"))),
    )
    some = F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", ")
    return headline.select(F.concat(F.lit("pending decisions: "), F.when(F.col("n") == 0, "none — every document is decided").otherwise(some)).alias("line"))


def status_counters(classified: DataFrame) -> DataFrame:
    """(state, codes, cites, excused, files): the counts that open a report of references."""
    quiet = F.col("excused_by").isNotNull()
    return classified.groupBy("state").agg(F.count_distinct("code").alias("codes"), F.count("*").alias("cites"), F.sum(quiet.cast("long")).alias("excused"), F.count_distinct("path").alias("files"))


def reference_report(classified: DataFrame, sites: DataFrame, docs: DataFrame, base: str) -> DataFrame:
    """(code, pick, line): a heading with counts for every document in question (pick 0), then its sites.

    ``sites(code, path, line, pick)`` are the chosen ones; the rest is counted in the heading.
    """
    loud = classified.where("excused_by IS NULL AND state <> 'active'")
    counts = loud.groupBy("code", "state").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))
    known = counts.join(docs.select("code", "title", "path"), "code", "left")
    name = F.when(F.col("path").isNull(), F.col("code")).otherwise(F.concat(F.lit("["), "code", F.lit("]("), P.relative(F.col("path"), F.lit(base)), F.lit(") — "), "title"))
    head = known.select("code", F.lit(0).alias("pick"), F.concat(F.lit("### "), name, F.lit(" ("), T.plural(F.col("n"), "citation"), F.lit(" in "), T.plural(F.col("files"), "file"), F.lit(")")).alias("line"))
    site = F.concat(F.lit("- ["), "path", F.lit(":"), F.col("line").cast("string"), F.lit("]("), P.relative(F.col("path"), F.lit(base)), F.lit(")"))
    return head.unionByName(sites.select("code", "pick", site.alias("line")))


def journal_listing(books: DataFrame) -> DataFrame:
    """(journal, books, entries, first, last): what each journal holds."""
    return books.groupBy("journal").agg(F.count("*").alias("books"), F.sum("n").alias("entries"), F.min("first").alias("first"), F.max("last").alias("last"))


def site_counters(targets: DataFrame) -> DataFrame:
    """One row of ``retarget``'s places: links by where they lead."""
    at = lambda place: F.count_if(F.col("place") == place).alias(place)
    return targets.agg(F.count("*").alias("links"), F.count_distinct("path").alias("pages"), *(at(p) for p in ("page", "asset", "repository", "unplaced")))


def exit_code(violations: DataFrame, findings: DataFrame) -> int:
    """1 where something fails: any violation, or a finding of a class that the catalog promotes."""
    failing = violations.select(F.lit(1).alias("x")).unionByName(findings.where("fails").select(F.lit(1).alias("x")))
    return 0 if failing.isEmpty() else 1


def in_order(findings: DataFrame) -> DataFrame:
    """Findings by class and message."""
    return findings.orderBy("class", "message")
