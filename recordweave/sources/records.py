"""Readers: text files as rows, documents of schemes, journal entries, locks, fragments.

Nothing is read on the driver. File text is read whole (``text`` source), and only
the frontmatter's YAML needs Python, in Arrow batches, returned as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Catalog, Scheme
from ..functions import text as T

HISTORY = "array<struct<version: int, date: string, note: string>>"


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, text) of every file under ``root``; paths are relative to it."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    base = root.rstrip("/").removeprefix("file:").rstrip("/") + "/"
    path = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    # what follows the root, by position: a root may hold any character
    return rows.select(F.substring(path, F.locate(base, path) + F.lit(len(base)), F.length(path)).alias("path"), F.col("value").alias("text"))


def is_historical(path, listed: tuple[str, ...], folders: tuple[str, ...]):
    """A listed file, or anything under a folder of fragments or a journal."""
    out = path.isin(list(listed)) if listed else F.lit(False)
    for f in folders:
        out = out | path.startswith(f.rstrip("/") + "/")
    return out


def is_generated(path, outputs: tuple[str, ...], folders: tuple[str, ...]):
    """A rendered view, or a file that lies directly in a folder of views."""
    out = path.isin(list(outputs)) if outputs else F.lit(False)
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return out | parent.isin([f.rstrip("/") for f in folders]) if folders else out


def scanned(found: DataFrame, c: Catalog, outputs: tuple[str, ...] = (), view_folders: tuple[str, ...] = ()) -> DataFrame:
    """The files whose citations count: markdown that is neither historical nor generated, and code by its globs."""
    import fnmatch

    folders = (*(f.name for f in c.fragments), *(j.dir for j in c.journals if j.dir), *(j.output for j in c.journals if j.output))
    prose = found.where(F.col("path").rlike(r"\.(md|stub)$") & ~is_historical(F.col("path"), c.historical, folders) & ~is_generated(F.col("path"), outputs, view_folders))
    for g in c.code_globs:
        prose = prose.unionByName(found.where(F.col("path").rlike(fnmatch.translate(g).replace(r"\z", r"\Z"))))
    return prose.dropDuplicates(["path"])


def split_frontmatter(found: DataFrame) -> DataFrame:
    """Adds ``yaml`` (null without frontmatter) and ``body``."""
    end = F.expr("locate('\n---\n', text, 4)")
    has = F.col("text").startswith("---\n") & (end > 0)
    return found.withColumn("yaml", F.when(has, F.expr("substring(text, 5, greatest(0, locate('\n---\n', text, 4) - 4))"))).withColumn("body", F.when(has, F.expr("substring(text, locate('\n---\n', text, 4) + 5)")).otherwise(F.col("text")))


def _yaml_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import yaml

    for b in batches:
        out = []
        for y in b.column("yaml").to_pylist():
            try:
                meta = yaml.safe_load(y) if y else None
            except yaml.YAMLError:
                meta = None
            out.append(json.dumps(meta, default=str) if isinstance(meta, dict) else "{}")
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "meta"])


def frontmatter(found: DataFrame) -> DataFrame:
    """``files`` with ``body`` and ``meta``, the frontmatter as a JSON object."""
    rows = split_frontmatter(found).select("path", "yaml", "body")
    return rows.mapInArrow(_yaml_json, "path string, yaml string, body string, meta string").drop("yaml")


def documents(found: DataFrame, scheme: Scheme) -> DataFrame:
    """The documents of a scheme: numbered ones (of equal numbers the first path), then those without a number yet."""
    name = F.element_at(F.split("path", "/"), -1)
    here = found.where(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1) == scheme.dir.rstrip("/"))
    number = F.regexp_extract(name, rf"(?i)^{scheme.prefix}-0*(\d+)(?:-[^/]*)?\.md$", 1)
    tail = F.regexp_extract(name, rf"^{scheme.prefix}-(tmp[a-z0-9]{{5}})\.md$", 1)
    rows = frontmatter(here).withColumn("number", F.nullif(number, F.lit("")).cast("int")).withColumn("tail", F.nullif(tail, F.lit("")))
    rows = rows.where("number IS NOT NULL OR tail IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("number", "tail").orderBy("path"))
    get = lambda key: F.get_json_object("meta", f"$.{key}")
    heading = F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1)
    bare = F.regexp_replace(heading, rf"^{scheme.prefix}-\w+:\s*", "")
    array = lambda key: F.coalesce(F.from_json(get(key), "array<string>"), F.array().cast("array<string>"))
    return rows.withColumn("nth", first).where("nth = 1").select(
        F.lit(scheme.prefix).alias("scheme"), "number", "tail", F.coalesce(T.code(F.lit(scheme.prefix), F.col("number")), F.concat(F.lit(f"{scheme.prefix}-"), "tail")).alias("code"), "path",
        F.coalesce(F.nullif(F.trim(get("title")), F.lit("")), bare).alias("title"), heading.alias("heading"),
        F.coalesce(get("status"), F.lit("")).alias("status"), T.status_word(F.coalesce(get("status"), F.lit(""))).alias("status_word"),
        (T.status_word(F.coalesce(get("status"), F.lit(""))) == scheme.active).alias("active"),
        F.transform(array("tags"), lambda t: F.lower(F.trim(t))).alias("tags"), array("tags").alias("raw_tags"),
        F.expr("try_cast(get_json_object(meta, '$.date') AS date)").alias("date"), F.coalesce(F.expr("try_cast(get_json_object(meta, '$.version') AS int)"), F.lit(1)).alias("version"),
        F.from_json(get("history"), HISTORY).alias("history"), array("influenced_by").alias("influenced_by"), array("formerly").alias("formerly"), get("summary").alias("summary"), get("origin").alias("origin"), "meta", "body",
    )


def entries(found: DataFrame, journal: str, folder: str) -> DataFrame:
    """Journal entries: their time from the field, else from the path."""
    here = found.where(F.col("path").startswith(folder.rstrip("/") + "/") & ~F.col("path").endswith("_template.md"))
    rows = frontmatter(here)
    given = F.try_to_timestamp(F.get_json_object("meta", "$.created"))
    return rows.select(
        F.lit(journal).alias("journal"), "path", F.coalesce(given, T.created_from_path(F.col("path"))).alias("created"), given.alias("given"), T.created_from_path(F.col("path")).alias("from_path"),
        F.get_json_object("meta", "$.title").alias("title"), F.coalesce(F.from_json(F.get_json_object("meta", "$.tags"), "array<string>"), F.array().cast("array<string>")).alias("tags"), "body",
    )


def lock(spark: SparkSession, path: str) -> DataFrame:
    """(remote, code, filename) of a lock file; an unreadable one has no rows."""
    schema = "remotes map<string, map<string, string>>"
    try:
        raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # a missing lock is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "remote string, code string, filename string")
    return raw.select(F.explode("remotes").alias("remote", "codes")).select("remote", F.explode("codes").alias("code", "filename"))


def fragments(found: DataFrame, added: DataFrame, folder: str) -> DataFrame:
    """Fragments in the order of their first commit (``added(path, committed_at)``), uncommitted ones last."""
    here = found.where(F.col("path").rlike(rf"^{folder.rstrip('/')}/[^/]+\.md$") & ~F.col("path").endswith("_template.md"))
    return here.join(added, "path", "left").select(F.lit(folder).alias("dir"), "path", "committed_at", F.col("text").alias("body"))


def published(found: DataFrame, excluded_dirs: tuple[str, ...] = (), globs: tuple[str, ...] = ()) -> DataFrame:
    """Pages of a site: markdown outside excluded folders, templates and globs."""
    import fnmatch

    rows = found.where(F.col("path").endswith(".md") & ~F.col("path").endswith("_template.md"))
    for d in excluded_dirs:
        rows = rows.where(~F.col("path").startswith(d.rstrip("/") + "/"))
    for g in globs:
        rows = rows.where(~F.col("path").rlike(fnmatch.translate(g).replace(r"\z", r"\Z")))
    return rows
