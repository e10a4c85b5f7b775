"""Links: codes of other projects to URLs, hand-written URLs, and targets that resolve to nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Inline links, and relative targets of markdown and raw HTML.
LINK = r"\[[^\]\n]*\]\(([^)\s]+)\)"
HREF = r"(?:href|src)=\"([^\"]*)\""


def targets(files: DataFrame) -> DataFrame:
    """(path, line, target) of inline links of ``files(path, text)``."""
    lines = files.where(F.contains("text", F.lit("]("))).select("path", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return lines.select("path", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("l", F.lit(LINK), F.lit(1))).alias("target"))


def broken(found: DataFrame, bases: DataFrame, existing: DataFrame, acks: DataFrame | None = None) -> DataFrame:
    """Local targets that no existing path answers; ``bases(path, base)`` is where prose renders,
    ``acks(path, target, lo, hi)`` acknowledges."""
    local = found.withColumn("local", T.local_path(F.col("target"))).where("local IS NOT NULL")
    at = local.join(bases, "path", "left").withColumn("resolved", T.normalize_path(F.concat_ws("/", F.coalesce("base", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "local")))
    missing = at.join(existing.select(F.col("path").alias("resolved")), "resolved", "left_anti").select("path", "line", "target", "resolved")
    if acks is None:
        return missing
    a = acks.select(F.col("path").alias("_p"), F.col("target").alias("_t"), "lo", "hi")
    return missing.join(a, (F.col("path") == F.col("_p")) & (F.col("target") == F.col("_t")) & F.expr("line BETWEEN lo AND hi"), "left_anti")


def remote_urls(refs: DataFrame, remotes: DataFrame, lock: DataFrame) -> DataFrame:
    """``refs(prefix, tail)`` with their URL: a template, else a locked file name, else by the code alone.

    A remote with a lock is answered by the lock: a code it lacks has an empty URL.
    """
    locked = lock.select(F.col("remote").alias("prefix"), F.col("code").alias("tail"), "filename")
    has_lock = lock.select(F.col("remote").alias("prefix")).distinct().withColumn("locked", F.lit(True))
    rows = refs.join(F.broadcast(remotes), "prefix", "left").join(locked, ["prefix", "tail"], "left").join(has_lock, "prefix", "left")
    number = F.regexp_extract("tail", r"(\d+)$", 1)
    filled = F.replace(F.replace(F.replace("url", F.lit("{code}"), F.col("tail")), F.lit("{number}"), number), F.lit("{prefix}"), F.col("prefix"))
    for i in range(3):
        group = F.when(F.coalesce("uid", F.lit("")) != "", F.expr(f"CASE WHEN coalesce(uid, '') <> '' AND length(regexp_replace(uid, '[^(]', '')) >= {i} THEN regexp_extract(tail, uid, {i}) ELSE '' END")).otherwise(F.lit(""))
        filled = F.replace(filled, F.lit(f"{{{i}}}"), group)
    base = F.concat(F.lit("https://github.com/"), "repo", F.lit("/blob/"), "ref", F.lit("/"), F.when(F.coalesce("dir", F.lit("")) == "", F.lit("")).otherwise(F.concat("dir", F.lit("/"))))
    url = (
        F.when(F.coalesce("url", F.lit("")) != "", filled)
        .when(F.coalesce("repo", F.lit("")) == "", F.lit(""))
        .when(F.col("filename").isNotNull(), F.concat(base, "filename"))
        .when(F.col("locked"), F.lit(""))
        .otherwise(F.concat(base, "tail", F.lit(".md")))
    )
    return rows.select("prefix", "tail", url.alias("link"))


def hand_written(links: DataFrame, urls: DataFrame, acks: DataFrame | None = None) -> DataFrame:
    """Links (path, line, prefix, tail, target) whose target is not the constructed URL."""
    wrong = links.join(urls, ["prefix", "tail"]).where("link <> '' AND target <> link")
    if acks is not None:
        a = acks.select(F.col("path").alias("_p"), F.col("code").alias("_c"), "lo", "hi")
        wrong = wrong.join(a, (F.col("path") == F.col("_p")) & (F.concat_ws("-", "prefix", "tail") == F.col("_c")) & F.expr("line BETWEEN lo AND hi"), "left_anti")
    return wrong.select("path", "line", "prefix", "tail", "target", "link")


def probe_status(urls: DataFrame, heads: DataFrame) -> DataFrame:
    """(prefix, tail, status) from ``heads(link, http)``: what a lock lacks is absent, other answers say why."""
    rows = urls.join(heads, "link", "left")
    status = F.when(F.col("link") == "", "absent").when(F.col("http").isNull(), "unchecked").when(F.col("http") < 400, "ok").when(F.col("http") == 404, "404").otherwise(F.concat(F.lit("unverifiable: "), F.col("http").cast("string")))
    return rows.select("prefix", "tail", status.alias("status"))


def html_targets(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, target, kind) of links and images of raw HTML outside comments."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    found = pages.select(key, F.explode(F.regexp_extract_all(shown, F.lit(HREF), F.lit(1))).alias("target"))
    kind = F.when(F.col("target").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "absolute").when(F.col("target").startswith("//"), "host").when(F.col("target").startswith("#"), "anchor").when(F.col("target").startswith("/"), "rooted").otherwise("relative")
    return found.withColumn("kind", kind)


def retarget(found: DataFrame, published: DataFrame, assets: DataFrame, tracked: DataFrame) -> DataFrame:
    """Where each (path, target) of a staged page goes: a page, an asset, the repository, or nowhere."""
    local = found.withColumn("resolved", T.normalize_path(F.concat_ws("/", F.regexp_extract("path", r"^(.*)/[^/]*$", 1), T.local_path(F.col("target"))))).where(T.local_path(F.col("target")).isNotNull())
    mark = lambda df, name: df.select(F.col("path").alias("resolved"), F.lit(True).alias(name)).dropDuplicates(["resolved"])
    rows = local.join(mark(published, "is_page"), "resolved", "left").join(mark(assets, "is_asset"), "resolved", "left").join(mark(tracked, "is_tracked"), "resolved", "left")
    return rows.select("path", "target", "resolved", F.when(F.col("is_page"), "page").when(F.col("is_asset"), "asset").when(F.col("is_tracked"), "repository").otherwise("unplaced").alias("place"))
