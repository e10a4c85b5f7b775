"""Rendered pages as ordered lines.

A page is rows ``(path, block, number, code, line)``, in that order of columns: no task
ever holds a page, and a writer that sorts by them puts it on disk. ``block`` separates
a page's parts (0 the head, then what it lists). Links are written from the page's own folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

ORDER = ("path", "block", "number", "code")
#: Documents without a number come after those with one.
LAST = (1 << 31) - 1


def _rows(df: DataFrame, path: Column, block: int, number: Column, code: Column, line: Column) -> DataFrame:
    return df.select(path.alias("path"), F.lit(block).alias("block"), number.cast("int").alias("number"), code.alias("code"), line.alias("line"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _placed(docs: DataFrame, views: DataFrame) -> DataFrame:
    """Documents with their scheme's ``view`` folder, and the way from there back to their own."""
    out = docs.join(F.broadcast(views.select("scheme", "view")), "scheme")
    source = P.parent(F.col("path"))
    back = F.when(source == F.col("view"), "").otherwise(F.concat(P.relative(source, F.col("view")), F.lit("/")))
    return out.withColumn("back", back).withColumn("place", F.coalesce("number", F.lit(LAST)))


def table_row(back: Column) -> Column:
    """A document's row: its link, its version from the second on, title and status."""
    version = F.when(F.col("version") > 1, F.concat(F.lit(" v"), F.col("version").cast("string"))).otherwise("")
    link = F.concat(F.lit("["), "code", F.lit("]("), back, P.name(F.col("path")), F.lit(")"), version)
    cells = [link, T.escape_cell(F.col("title")), T.escape_cell(P.rebase(F.col("status"), back))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def legend(statuses: DataFrame) -> DataFrame:
    """(scheme, ordinal, line) of a declared vocabulary ``statuses(scheme, status, label, blurb, ordinal)``."""
    cells = F.concat_ws(" | ", F.concat(F.lit("`"), "status", F.lit("`")), F.coalesce("label", F.lit("")), T.sentence_case(F.coalesce("blurb", F.lit(""))))
    return statuses.select("scheme", "ordinal", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def scheme_pages(docs: DataFrame, views: DataFrame, statuses: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """Each scheme's index: title, legend, a block of links for every tag, and the table of its documents.

    ``views(scheme, view, title)`` and the vocabularies are configuration; ``tags(scheme, tag,
    label, blurb, ordinal)`` puts declared tags first, others follow by name.
    """
    page, nothing = F.concat("view", F.lit("/README.md")), F.lit("")
    small = F.broadcast(views)
    out = [_rows(views, page, 0, F.lit(0), nothing, F.concat(F.lit("# "), "title"))]
    if statuses is not None:
        lines = legend(statuses).join(small, "scheme")
        out.append(_rows(lines, page, 1, F.col("ordinal"), nothing, F.col("line")))
    placed = _placed(docs, views)
    each = placed.select("scheme", "view", "place", "code", "number", "tail", "path", "back", F.explode("tags").alias("tag"))
    used = each.groupBy("scheme", "view", "tag").agg(F.count("*").alias("n"))
    if tags is None:
        named = used.withColumn("label", F.lit(None).cast("string")).withColumn("blurb", F.lit(None).cast("string")).withColumn("ordinal", F.lit(None).cast("int"))
    else:
        named = used.join(F.broadcast(tags), ["scheme", "tag"], "left")
    label = F.coalesce("label", P.title_words(F.col("tag")))
    blurb = F.when(F.coalesce("blurb", F.lit("")) != "", F.concat(F.lit(" — "), "blurb")).otherwise("")
    title = F.concat(F.lit("**["), label, F.lit("](tags/"), "tag", F.lit(".md)** ("), F.col("n").cast("string"), F.lit(")"), blurb, F.lit(":"))
    rank = F.coalesce("ordinal", F.lit(LAST))
    out.append(_rows(named, page, 2, rank, F.col("tag"), title))
    # a tag's links sort right behind its title: the separator comes before anything a tag holds
    short = F.when(F.col("number").isNull(), F.col("tail")).otherwise(T.code_tail(F.col("code")))
    link = F.concat(F.lit("["), short, F.lit("]("), "back", P.name(F.col("path")), F.lit(")"))
    after = F.concat("tag", F.lit("\x01"), F.format_string("%010d", "place"), F.lit("\x01"), "code")
    ranks = named.select("scheme", "tag", rank.alias("rank"))
    out.append(_rows(each.join(ranks, ["scheme", "tag"]).withColumn("line", link), page, 2, F.col("rank"), after, F.col("line")))
    out.append(_rows(placed.withColumn("line", table_row(F.col("back"))), page, 3, F.col("place"), F.col("code"), F.col("line")))
    return _union(out)


def assembled_pages(docs: DataFrame, outputs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Schemes that are read as one page: every document under its anchor, its heading one level
    down with its number, and a line of version, influences, status and origin.

    ``outputs(scheme, output, active)`` is configuration. An influence links to its document
    where ``targets(code, path)`` (by default the documents themselves) knows it.
    """
    own = docs.join(F.broadcast(outputs.select("scheme", "output", F.col("active").alias("in_force"))), "scheme")
    known = (docs if targets is None else targets).select(F.col("code").alias("influence"), F.col("path").alias("found"))
    each = own.select("code", F.posexplode("influenced_by").alias("at", "influence"), "output").join(known, "influence", "left")
    shown = F.when(F.col("found").isNull(), F.col("influence")).otherwise(F.concat(F.lit("["), "influence", F.lit("]("), P.relative(F.col("found"), P.parent(F.col("output"))), F.lit(")")))
    shaped = each.select("code", F.struct("at", shown.alias("s")).alias("x")).groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), ", ").alias("shaped"))
    slot = F.coalesce(F.col("number").cast("string"), F.col("tail"))
    label = F.coalesce(F.col("number").cast("string"), F.col("code"))
    heading = r"^#\s*[A-Z]+-[A-Za-z0-9]+\s*(?::|—|-)\s*"
    clean = F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", "")
    body = F.when(clean.rlike(heading), F.concat(F.lit("## "), label, F.lit(". "), F.substring(clean, F.length(F.regexp_extract(clean, heading, 0)) + 1, F.length(clean)))).otherwise(clean)
    origin = F.regexp_replace(F.trim(F.coalesce(F.get_json_object("meta", "$.origin"), F.lit(""))), r"\.+$", "")
    notes = F.array(
        F.concat(F.lit("*v"), F.coalesce("version", F.lit(1)).cast("string")),
        F.concat(F.lit("shaped by "), "shaped"),
        F.when(F.col("status") != F.col("in_force"), F.concat(F.lit("**"), "status", F.lit("**"))),
        F.when(origin != "", F.concat(F.lit("origin: "), origin)),
    )
    text = F.concat(F.lit('<a name="'), F.lower("scheme"), F.lit("-"), slot, F.lit('"></a>\n\n'), body, F.lit("\n\n"), F.array_join(F.filter(notes, lambda n: n.isNotNull()), " · "), F.lit("*"))
    rows = own.join(shaped, "code", "left").withColumn("line", text)
    head = _rows(outputs, F.col("output"), 0, F.lit(0), F.lit(""), F.concat(F.lit("# "), "scheme", F.lit(" documents")))
    return head.unionByName(_rows(rows, F.col("output"), 1, F.coalesce("number", F.lit(LAST)), F.col("code"), F.col("line")))


def journal_pages(entries: DataFrame, granularity: str = "month") -> DataFrame:
    """(journal, book, block, created, path, line): a book's table of contents (1), then its entries (2), by time and path."""
    keyed = entries.withColumn("book", T.book_key(F.col("created"), granularity))
    anchor = T.entry_anchor(F.col("created"))
    toc = F.concat(F.lit("- ["), F.date_format("created", "d MMM HH:mm"), F.lit(" — "), "title", F.lit("](#"), anchor, F.lit(")"))
    entry = F.concat(F.lit('<a id="'), anchor, F.lit('"></a>\n\n## '), "title", F.lit("\n\n"), F.trim("body"))
    parts = F.array(F.struct(F.lit(1).alias("block"), toc.alias("line")), F.struct(F.lit(2).alias("block"), entry.alias("line")))
    return keyed.select("journal", "book", "created", "path", F.inline(parts))


def anchors(pages: DataFrame) -> DataFrame:
    """(path, number, anchor) of ``pages(path, text)``: an explicit anchor (its last), else the slug of the first numbered heading."""
    lines = pages.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    explicit, heading = r'^<a name="([a-z]+-(\d+))"></a>\s*$', r"^##\s+(\d+)\.\s+(.+?)\s*$"
    named = F.regexp_extract("line", explicit, 1)
    number = F.coalesce(F.regexp_extract("line", explicit, 2).try_cast("int"), F.regexp_extract("line", heading, 1).try_cast("int"))
    slug = T.heading_slug(F.concat(number.cast("string"), F.lit(". "), F.regexp_extract("line", heading, 2)))
    found = lines.where(F.col("line").rlike(explicit) | F.col("line").rlike(heading)).select("path", "at", number.alias("number"), F.nullif(named, F.lit("")).alias("named"), slug.alias("slug"))
    last, first = F.max_by("named", F.when(F.col("named").isNotNull(), F.col("at"))), F.min_by("slug", F.when(F.col("named").isNull(), F.col("at")))
    return found.groupBy("path", "number").agg(F.coalesce(last, first).alias("anchor"))


def outputs(pages: list[DataFrame]) -> DataFrame:
    """All rendered lines of several views, in the columns of a page."""
    return _union([p.select(*ORDER, "line") for p in pages])


def write(pages: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Lines as text under ``folder``/view=<path>, in order.

    Rows are dealt by ranges of (path, block, number, code), so a long page is written by
    several tasks; its parts, by name, are the page.
    """
    keyed = pages.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    keyed.select(F.col("path").alias("view"), F.col("line").alias("value")).write.mode(mode).partitionBy("view").text(folder)


def vocabulary(spark: SparkSession, scheme: str, text: str, key: str) -> DataFrame:
    """(scheme, ``key``, label, blurb, ordinal) of a vocabulary in YAML, in the order of its file."""
    import yaml

    rows = [(scheme, str(k), (v or {}).get("label"), (v or {}).get("blurb"), i) for i, (k, v) in enumerate((yaml.safe_load(text) or {}).items())]
    return spark.createDataFrame(rows, f"scheme string, {key} string, label string, blurb string, ordinal int")
