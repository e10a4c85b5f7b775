"""Codes of other projects: spelling, the ladder of URL constructions, locks, and what is cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Remote
from ..functions import text as T

#: Columns of the two configured families, each a row a member.
REMOTES = "prefix string, name string, repo string, ref string, dir string, url string, delim string, uid string"
FAMILIES = "prefix string, scheme string, dir string, document string, anchor string, url string"


def canonical_tail(tail: Column, uid: Column) -> Column:
    """A tail's one spelling; an identifier of a project's own shape is exact already."""
    return F.when(F.coalesce(uid, F.lit("")) != "", tail).otherwise(T.canonical(tail))


def _filled(template: Column, values: dict[str, Column]) -> Column:
    for key, value in values.items():
        template = F.replace(template, F.lit("{" + key + "}"), F.coalesce(value, F.lit("")))
    return template


def ladder(refs: DataFrame, remotes: DataFrame, lock: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """``refs(prefix, tail)`` with (rung, link): the first construction that a remote allows.

    ``identifier``, ``family-url``, ``section`` and ``url`` are built from configuration
    alone. The rungs by file (``family-dir``, ``dir``) ask the lock where the remote has
    one: a name it knows is taken, a code it lacks is ``absent`` with an empty link.
    ``none`` is a remote that is not known or gives nothing to build from. ``remotes``
    and ``families`` are configuration and broadcast; the lock is joined by key.
    """
    spark = refs.sparkSession
    families = spark.createDataFrame([], FAMILIES) if families is None else families
    keys = ["prefix", "scheme"]
    # a lock's remotes are among the configured ones, so this stays as small as they are
    locked = lock.select(F.col("remote").alias("prefix")).distinct().withColumn("locked", F.lit(True))
    known = F.broadcast(remotes.join(locked, "prefix", "left"))
    fam = F.broadcast(families.select(*keys, *(F.nullif(F.col(c), F.lit("")).alias("f_" + c) for c in ("dir", "document", "anchor", "url"))))
    rows = refs.join(known, "prefix", "left").withColumn("code", canonical_tail(F.col("tail"), F.col("uid")))
    rows = rows.withColumn("scheme", F.upper(T.code_prefix(F.col("code")))).join(fam, keys, "left")
    names = lock.select(F.col("remote").alias("prefix"), "code", "filename").dropDuplicates(["prefix", "code"])
    rows = rows.join(names, ["prefix", "code"], "left")

    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    code, number = F.col("code"), F.regexp_extract("code", r"-(\d+)$", 1).try_cast("bigint").cast("string")
    values = {"code": code, "number": number, "prefix": F.col("scheme")}
    whole = F.expr("coalesce(uid, '') <> '' AND code RLIKE concat('^(?:', uid, ')$')")
    groups = {str(i): F.when(whole & F.expr(f"length(regexp_replace(uid, '[^(]', '')) >= {i}"), F.expr(f"regexp_extract(code, CASE WHEN length(regexp_replace(uid, '[^(]', '')) >= {i} THEN uid ELSE '()()()()' END, {i})")) for i in range(1, 4)}
    tree = lambda d: F.concat(F.lit("https://github.com/"), "repo", F.lit("/blob/"), "ref", F.when(F.coalesce(d, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("/"), d)))
    file = F.coalesce("filename", F.concat(code, F.lit(".md")))
    anchor = _filled(F.coalesce("f_anchor", F.concat(F.lower("scheme"), F.lit("-{number}"))), {"number": number, "prefix": F.col("scheme")})
    missing = F.col("locked") & F.col("filename").isNull()

    rung = (
        F.when(has("uid"), F.when(has("url"), "identifier").otherwise("none"))
        .when(has("f_url"), "family-url")
        .when(has("f_document") & has("repo"), "section")
        .when(has("f_dir") & has("repo") & ~has("url"), F.when(missing, "absent").otherwise("family-dir"))
        .when(has("f_dir") & has("repo"), "family-dir")
        .when(has("url"), "url")
        .when(~has("repo"), "none")
        .when(missing, "absent")
        .otherwise("dir")
    )
    # a remote with a template of its own never asks the lock, so a family's file goes by its code there
    by_code = F.when(has("url"), F.concat(code, F.lit(".md"))).otherwise(file)
    link = (
        F.when(F.col("rung") == "identifier", _filled(F.col("url"), {"0": code, "uid": code, "prefix": F.col("prefix"), **groups}))
        .when(F.col("rung") == "family-url", _filled(F.col("f_url"), values))
        .when(F.col("rung") == "section", F.concat(tree(F.lit("")), F.lit("/"), "f_document", F.lit("#"), anchor))
        .when(F.col("rung") == "family-dir", F.concat(tree(F.col("f_dir")), F.lit("/"), by_code))
        .when(F.col("rung") == "url", _filled(F.col("url"), values))
        .when(F.col("rung") == "dir", F.concat(tree(F.regexp_replace("dir", "/+$", "")), F.lit("/"), file))
        .otherwise("")
    )
    return rows.withColumn("rung", rung).select("prefix", "tail", "code", "rung", link.alias("link"))


def rung_summary(answers: DataFrame) -> DataFrame:
    """(prefix, rung, cites, codes) of ``ladder``'s rows."""
    return answers.groupBy("prefix", "rung").agg(F.count("*").alias("cites"), F.count_distinct("code").alias("codes"))


def cited(refs: DataFrame) -> DataFrame:
    """(prefix, tail, cites, files) of the foreign codes of ``refs(path, prefix, tail)``."""
    return refs.groupBy("prefix", "tail").agg(F.count("*").alias("cites"), F.count_distinct("path").alias("files"))


def composed(text: Column, remotes: tuple[Remote, ...]) -> Column:
    """(prefix, tail) of a text that is a whole foreign code, by the longest prefix that reads it; else null."""
    import re

    out = F.lit(None).cast("struct<prefix: string, tail: string>")
    for r in sorted(remotes, key=lambda r: (len(r.prefix), r.prefix)):
        shape = rf"^{re.escape(r.prefix + r.delim)}({r.uid or '[A-Za-z]+-[0-9]+'})$"
        tail = F.regexp_extract(text, shape, 1)
        out = F.when(text.rlike(shape), F.struct(F.lit(r.prefix).alias("prefix"), (tail if r.uid else T.canonical(tail)).alias("tail"))).otherwise(out)
    return out


def discovered(names: DataFrame) -> DataFrame:
    """(remote, code, filename) of a listing ``names(remote, name)``: of a code's files the first by name."""
    shape = r"^([A-Za-z]+)-0*(\d+)(?:-[^/]*)?\.md$"
    prefix, number = F.regexp_extract("name", shape, 1), F.regexp_extract("name", shape, 2)
    found = names.where(F.col("name").rlike(shape)).select("remote", T.code(F.upper(prefix), number.cast("int")).alias("code"), "name")
    return found.groupBy("remote", "code").agg(F.min("name").alias("filename"))


def lock_lines(lock: DataFrame) -> DataFrame:
    """(remote, code, line): a lock as ordered lines of JSON, one an entry, without the commas between them."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    return lock.select("remote", "code", F.concat(quoted(F.col("code")), F.lit(": "), quoted(F.col("filename"))).alias("line"))


def lock_file(lock: DataFrame, entries: int = 100_000) -> str:
    """A lock as the JSON text of its one file, keys sorted; more than ``entries`` rows are an error."""
    import json

    rows = lock.select("remote", "code", "filename").limit(entries + 1).collect()
    if len(rows) > entries:
        raise ValueError(f"a lock of more than {entries} entries does not belong in one file")
    maps: dict[str, dict[str, str]] = {}
    for r in sorted(rows):
        maps.setdefault(r.remote, {})[r.code] = r.filename
    return json.dumps({"remotes": maps}, indent=2) + "\n"


def empty_lock(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "remote string, code string, filename string")
