"""Integrity checks over documents: each gives one row per violation or finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import STATUSES, TagGroup
from ..functions import text as T

#: How many documents make a uniform status a finding.
UNIFORM_FLOOR = 10


def frontmatter(docs: DataFrame, requires: tuple[str, ...] = (), declared: tuple[str, ...] = STATUSES) -> DataFrame:
    """(code, problem): no status, a status outside the vocabulary or undeclared, no tags, a required field missing."""
    word = F.col("status_word")
    problems = [
        F.when(F.coalesce(word, F.lit("")) == "", F.lit("no status")).when(~word.isin(*STATUSES), F.concat(F.lit("nonstandard status: "), word)).when(~word.isin(*declared), F.concat(F.lit("undeclared status: "), word)),
        F.when(F.coalesce(F.size("tags"), F.lit(0)) < 1, F.lit("no tags")),
        *(F.when(F.coalesce(F.get_json_object("meta", f"$.{r}"), F.lit("")) == "", F.lit(f"missing {r}")) for r in requires),
    ]
    return docs.select("code", F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull())).alias("problem"))


def titles(docs: DataFrame) -> DataFrame:
    """Documents whose title is not their heading without its code."""
    bare = F.regexp_replace("heading", r"^[A-Z]{1,10}-\w+:\s*", "")
    return docs.where(F.col("title") != bare).select("code", "title", bare.alias("heading"))


def undefined_statuses(declared: list[str]) -> list[str]:
    return sorted(set(declared) - set(STATUSES))


def tag_groups(docs: DataFrame, groups: tuple[TagGroup, ...]) -> DataFrame:
    """(code, group, rule, tags): tags of a group too many or missing, or beside tags that exclude it."""
    frames = []
    for g in groups:
        own = F.array_sort(F.array_intersect("tags", F.array(*map(F.lit, sorted(g.tags)))))
        clash = F.array_sort(F.array_intersect("tags", F.array(*map(F.lit, sorted(g.excluded_by))).cast("array<string>")))
        n, excluded = F.size(own), F.size(clash) > 0
        rule = F.lit(False)
        if g.require == "exactly-one":
            rule = F.when(excluded, n > 1).otherwise(n != 1)
        elif g.require == "at-most-one":
            rule = n > 1
        hits = F.array(
            F.when(rule, F.struct(F.lit(g.require).alias("rule"), F.array_join(own, ",").alias("tags"))),
            F.when(excluded & (n > 0), F.struct(F.lit("excluded").alias("rule"), F.array_join(F.concat(own, clash), ",").alias("tags"))),
        )
        frames.append(docs.select("code", F.lit(g.name).alias("group"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("code", "group", "h.rule", "h.tags"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def versions(docs: DataFrame) -> DataFrame:
    """Numbered documents whose version is not that of their last history entry."""
    last = F.try_element_at("history", F.lit(-1)).getField("version")
    return docs.where("number IS NOT NULL").where(F.when(F.coalesce(F.size("history"), F.lit(0)) > 0, ~last.eqNullSafe(F.col("version"))).otherwise(F.col("version") > 1)).select("code", "version", last.alias("last_version"))


def uniform_status(docs: DataFrame, floor: int = UNIFORM_FLOOR) -> DataFrame:
    """Schemes of at least ``floor`` documents that all have one status."""
    return docs.where("status_word <> ''").groupBy("scheme").agg(F.count("*").alias("n"), F.count_distinct("status_word").alias("words"), F.min("status_word").alias("status")).where((F.col("n") >= floor) & (F.col("words") == 1)).drop("words")


def narrow_titles(docs: DataFrame, terms: list[str], acknowledged: DataFrame | None = None) -> DataFrame:
    """(code, title, terms) of titles that name a narrow term; ``acknowledged(code, terms)`` are taken out."""
    hits = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("title", F.lit(T.narrow_pattern(terms)), F.lit(1)), F.lower)))
    rows = docs.where(F.col("title").rlike(T.narrow_pattern(terms))).select("code", "title", hits.alias("terms"))
    if acknowledged is not None:
        rows = rows.join(acknowledged.select("code", F.col("terms").alias("acked")), "code", "left").withColumn("terms", F.array_except("terms", F.coalesce("acked", F.array().cast("array<string>")))).drop("acked")
    return rows.where(F.size("terms") > 0)


def journals(entries: DataFrame) -> DataFrame:
    """(path, problem) of entries without a title, or filed under another time than theirs."""
    problems = [F.when(F.coalesce(F.trim("title"), F.lit("")) == "", F.lit("no title")), F.when(F.col("given").isNotNull() & ~F.col("path").endswith(T.journal_path(F.col("given"))), F.lit("path and created differ")), F.when(F.col("created").isNull(), F.lit("no created"))]
    return entries.select("path", F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull())).alias("problem"))


def unindexed(pages: DataFrame, index_text: DataFrame) -> DataFrame:
    """Pages that the index (one row, ``text``) does not link; the one join without equality, on a single row."""
    return pages.join(F.broadcast(index_text.limit(1).select(F.col("text").alias("_index"))), ~F.contains("_index", F.concat(F.lit("("), "path", F.lit(")"))), "inner").drop("_index")


def enforce(findings: DataFrame, fail_on: tuple[str, ...]) -> DataFrame:
    """Findings (class, message) with whether their class fails."""
    return findings.withColumn("fails", F.col("class").isin(list(fail_on)) if fail_on else F.lit(False))
