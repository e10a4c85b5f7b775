"""The citation graph: extraction, resolution, acknowledgement, and what follows from it.

Relations: docs(code, status_word, active, ...), citations(path, line, code),
annotations(path, kind, code, lo, hi, pos). Every interval join has equality on path
and code first, so it plans as a hash or merge join with the range as a residual.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: The directive names that acknowledge, and the shapes blanked before codes are read.
RETIRED, DANGLING = "inactive-ok", "unresolved-ok"
SHAPED = r"(?im)\b(?:inactive-ok|unresolved-ok|url-ok)(?:-block|-file)?:[^\n]*?(?=—|-->|\*/|$)"
URL = r"(?i)\b[a-z][a-z0-9+.-]*://[^\s<>)\]\"']+"
FORMERLY = r"(?m)^formerly:[ \t]*$(?:\n- [^\n]*)*"

#: Remotes as (lead, pattern of the rest): a prefix with its delimiter, longest first.
Remotes = tuple[tuple[str, str], ...]


def _foreign_pattern(remote: tuple[str, str]) -> str:
    return rf"(?<![\w-]){re.escape(remote[0])}((?:{remote[1]}))(?!\w)"


def _foreign(text: Column, remotes: Remotes) -> tuple[Column, Column]:
    """(array of (lead, tail) of the remotes' codes in ``text``, the text without them)."""
    found = F.array().cast("array<struct<lead: string, tail: string>>")
    for r in remotes:
        tails, lead = F.regexp_extract_all(text, F.lit(_foreign_pattern(r)), F.lit(1)), F.lit(r[0]).alias("lead")
        found = F.concat(found, F.transform(tails, lambda x: F.struct(lead, x.alias("tail"))))  # noqa: B023  called at once
        text = F.regexp_replace(text, _foreign_pattern(r), " ")
    return found, text


def _answered(rows: DataFrame, lock: DataFrame | None) -> DataFrame:
    """``rows(lead, tail)`` with ``known``: false where the remote has a lock that lacks the code."""
    if lock is None:
        return rows.withColumn("known", F.lit(True))
    has = lock.select(F.col("lead"), F.lit(True).alias("locked")).distinct()
    hit = lock.select("lead", F.col("code").alias("tail"), F.lit(True).alias("hit")).distinct()
    both = rows.join(F.broadcast(has), "lead", "left").join(hit, ["lead", "tail"], "left")
    return both.withColumn("known", F.col("locked").isNull() | F.col("hit").isNotNull()).drop("locked", "hit")


def extract(files: DataFrame, prefixes: tuple[str, ...], own: DataFrame | None = None, remotes: Remotes = (), lock: DataFrame | None = None) -> DataFrame:
    """Distinct (path, line, code) cited by ``files(path, text)``, code blocks included.

    Directives, URLs and ``formerly:`` lists are blanked first; line breaks stay.
    ``own(path, code)`` are documents, which do not cite themselves. A code of a remote is
    no local one: it counts, whole, only where ``lock(lead, code)`` says that the remote
    has no such document.
    """
    formerly = F.regexp_extract_all("text", F.lit(FORMERLY), F.lit(0))
    plain = F.aggregate(formerly, F.col("text"), lambda t, x: F.replace(t, x, F.regexp_replace(x, r"[^\n]", " ")))
    shown = F.regexp_replace(F.regexp_replace(plain, SHAPED, " "), URL, " ")
    mention = "|".join(map(re.escape, prefixes))
    # cheap test before anything is split
    some = "|".join([rf"\b(?:{mention})[- ]\d", *map(_foreign_pattern, remotes)])
    lines = files.where(F.col("text").rlike(some)).select("path", F.posexplode(F.split(shown, "\n")).alias("i", "l"))
    foreign, local = _foreign(F.col("l"), remotes)
    lines = lines.select("path", (F.col("i") + 1).alias("line"), foreign.alias("foreign"), local.alias("l"))
    found = lines.select("path", "line", F.explode(F.regexp_extract_all("l", F.lit(rf"\b(?:{mention})[- ]\d{{1,4}}\b"), F.lit(0))).alias("m"))
    cited = found.select("path", "line", T.canonical(F.col("m")).alias("code"))
    if remotes and lock is not None:
        asked = _answered(lines.select("path", "line", F.inline("foreign")), lock)
        cited = cited.unionByName(asked.where("NOT known").select("path", "line", F.concat("lead", "tail").alias("code")))
    cited = cited.distinct()
    if own is None:
        return cited
    return cited.join(own.select("path", F.col("code").alias("own")), "path", "left").where("own IS NULL OR own <> code").drop("own")


def annotations(directives: DataFrame, docs: DataFrame, remotes: Remotes = (), lock: DataFrame | None = None) -> DataFrame:
    """One row per annotation and code it names, with what is wrong with it.

    ``inactive-ok`` must name documents that exist, ``unresolved-ok`` codes that do not;
    a remote's code exists unless the remote's lock lacks it.
    """
    rows = directives.where(F.col("name").isin(RETIRED, DANGLING)).withColumn("spec", F.concat_ws(" ", "args"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("line", "name", "spec")))
    foreign, local = _foreign(F.col("spec"), remotes)
    codes = F.transform(F.regexp_extract_all("local", F.lit(r"\b[A-Za-z]{2,10}-\d{1,4}\b"), F.lit(0)), lambda x: F.struct(F.lit(None).cast("string").alias("lead"), T.canonical(x).alias("tail")))
    bare = F.regexp_replace("local", r"\b[A-Za-z]{2,10}-\d{1,4}\b", "").rlike(r"(?<![\w-])\d{1,4}(?![\w-])")
    rows = rows.withColumn("foreign", foreign).withColumn("local", local).withColumn("bare", bare).withColumn("codes", F.array_distinct(F.concat("foreign", codes)))
    each = rows.select("path", F.col("name").alias("kind"), "scope", "line", "lo", "hi", "pos", "bare", F.inline_outer("codes"))
    each = _answered(each, lock).withColumnRenamed("known", "answered").withColumn("code", F.concat(F.coalesce("lead", F.lit("")), F.col("tail")))
    known = docs.select("code", F.lit(True).alias("here"))
    exists = F.when(F.col("lead").isNotNull(), F.col("answered")).otherwise(F.coalesce("here", F.lit(False)))
    checked = each.join(known, "code", "left").withColumn("wrong", F.col("code").isNotNull() & (exists != (F.col("kind") == RETIRED)))
    same = Window.partitionBy("path", "pos")
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("wrong"), F.col("code"))).over(same)), ", ")
    missing, present = F.concat(F.lit("no such document: "), names), F.concat(F.lit("not unresolved: "), names)
    problem = F.when(F.col("code").isNull(), "without a code").when(F.col("bare"), "number without its prefix").when(names != "", F.when(F.col("kind") == RETIRED, missing).otherwise(present))
    return checked.withColumn("problem", problem).select("path", "kind", "scope", "line", "lo", "hi", "pos", "code", "problem")


def classify(citations: DataFrame, docs: DataFrame, annots: DataFrame) -> DataFrame:
    """Citations with their state (active, retired, dangling) and the first annotation that excuses them."""
    known = citations.join(docs.select("code", "active"), "code", "left")
    state = F.when(F.col("active").isNull(), "dangling").when(F.col("active"), "active").otherwise("retired")
    cites = known.select("path", "line", "code", state.alias("state")).withColumn("kind", F.when(F.col("state") == "dangling", DANGLING).when(F.col("state") == "retired", RETIRED))
    ann = annots.select("path", "code", "kind", "lo", "hi", "pos")
    found = cites.join(ann, ["path", "code", "kind"], "left").groupBy("path", "line", "code", "state").agg(F.min(F.when(F.expr("line BETWEEN lo AND hi"), F.col("pos"))).alias("excused_by"))
    return found


def flagged(classified: DataFrame, state: str = "retired") -> DataFrame:
    """Codes with citations that nothing excuses: loud and excused sites, distinct files; loudest first."""
    loud = F.col("excused_by").isNull()
    counts = classified.where(F.col("state") == state).groupBy("code").agg(
        F.count_if(loud).alias("loud"), F.count_if(~loud).alias("excused"), F.count_distinct(F.when(loud, F.col("path"))).alias("files")
    )
    return counts.where("loud > 0").orderBy(F.desc("loud"), "code")


def acknowledged(classified: DataFrame) -> DataFrame:
    """Excused citations of retired documents and of codes that resolve to nothing."""
    ok = F.col("excused_by").isNotNull()
    return classified.agg(F.count_if(ok & (F.col("state") == "retired")).alias("retired"), F.count_if(ok & (F.col("state") == "dangling")).alias("dangling"))


def stale_annotations(annots: DataFrame, classified: DataFrame, docs: DataFrame) -> DataFrame:
    """Annotations (without a problem of their own) that excuse nothing, and why."""
    used = classified.where("excused_by IS NOT NULL").select("path", F.col("excused_by").alias("pos"), "code").distinct()
    idle = annots.where("code IS NOT NULL").join(used, ["path", "pos", "code"], "left_anti").join(docs.select("code", "active"), "code", "left")
    reason = F.when(F.coalesce("active", F.lit(False)) & (F.col("kind") == RETIRED), "now active").otherwise("nothing cites it")
    return idle.select("path", "pos", "kind", "code", reason.alias("reason"))


def spread(classified: DataFrame, state: str = "retired", limit: int = 5) -> DataFrame:
    """At most ``limit`` loud sites of each code, over its files in turn (0: all)."""
    loud = classified.where((F.col("state") == state) & F.col("excused_by").isNull())
    turn = F.row_number().over(Window.partitionBy("code", "path").orderBy("line"))
    pick = F.row_number().over(Window.partitionBy("code").orderBy("turn", "path"))
    ranked = loud.select("code", "path", "line", turn.alias("turn")).withColumn("pick", pick).drop("turn")
    return ranked.where(F.col("pick") <= limit) if limit > 0 else ranked


def pending(docs: DataFrame, classified: DataFrame, undecided: tuple[str, ...] = ("Proposed", "Deferred")) -> DataFrame:
    """Undecided documents with how much relies on them; oldest first, undated last."""
    cites = classified.groupBy("code").agg(F.count("*").alias("n_cites"), F.count_if(F.col("excused_by").isNull()).alias("n_loud"))
    rows = docs.where(F.col("status_word").isin(*undecided)).join(cites, "code", "left")
    counted = rows.select("code", "status_word", "title", "date", F.coalesce("n_cites", F.lit(0)).alias("cites"), F.coalesce("n_loud", F.lit(0)).alias("unacknowledged"))
    return counted.orderBy(F.asc_nulls_last("date"), F.desc("cites"), "code")


def pending_headline(rows: DataFrame, as_of: str, stale_days: int) -> DataFrame:
    """One row: undecided documents, the oldest age, how many are stale, undated, or cited without acknowledgement."""
    day = F.lit(as_of).cast("date")
    age = T.age_days(F.col("date"), day)
    return rows.agg(
        F.count("*").alias("n"), F.max(age).alias("oldest"), F.count_if(T.is_stale(F.col("date"), day, stale_days)).alias("stale"), F.count_if(F.col("date").isNull()).alias("undated"),
        F.count_if(F.col("unacknowledged") > 0).alias("relied_on"),
    )


def badges(classified: DataFrame, waiting: DataFrame) -> DataFrame:
    """(name, value, url) of the two counters: retired codes still cited, undecided documents."""
    codes = flagged(classified).agg(F.count("*").alias("value")).select(F.lit("retired").alias("name"), "value")
    both = codes.unionByName(waiting.agg(F.count("*").alias("value")).select(F.lit("pending").alias("name"), "value"))
    return both.select("name", "value", F.when(F.col("name") == "retired", T.badge_url("retired", F.col("value"))).otherwise(T.badge_url("pending", F.col("value"))).alias("url"))
