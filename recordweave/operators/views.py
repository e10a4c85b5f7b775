"""Rendered views as (path, text) rows: ordered aggregation per view, no driver-side assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _joined(rows: DataFrame, keys: list[str], order: list[str], line: Column, name: str = "text", sep: str = "\n") -> DataFrame:
    """Lines of each key in order, as one text."""
    made = rows.select(*keys, F.struct(*order).alias("_o"), line.alias("_l"))
    return made.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_l"))), lambda x: x["_l"]), sep).alias(name))


def row(base: str = "") -> Column:
    """A table row of a document."""
    link = F.concat(F.lit("["), "code", F.lit("]("), F.lit(base), "path", F.lit(")"))
    return F.concat(F.lit("| "), link, F.lit(" | "), T.escape_cell(F.col("title")), F.lit(" | "), T.escape_cell(F.col("status")), F.lit(" |"))


def tag_order(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(tag, n, ordinal) of used tags: declared ones (``vocabulary(tag, ordinal)``) first, others by name."""
    used = docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    if vocabulary is None:
        return used.withColumn("ordinal", F.lit(None).cast("int")).orderBy("tag")
    return used.join(F.broadcast(vocabulary), "tag", "left").orderBy(F.asc_nulls_last("ordinal"), "tag")


def index(docs: DataFrame) -> DataFrame:
    """(scheme, text): the table of a scheme's documents."""
    head = F.lit("| Document | Title | Status |\n| --- | --- | --- |\n")
    return _joined(docs, ["scheme"], ["number", "code"], row()).withColumn("text", F.concat(head, "text"))


def categories(docs: DataFrame) -> DataFrame:
    """(scheme, tag, n, text): one line per tag with its documents."""
    each = docs.select("scheme", "number", "code", F.explode("tags").alias("tag"))
    lines = _joined(each, ["scheme", "tag"], ["number", "code"], F.col("code"), "codes", ", ")
    counts = each.groupBy("scheme", "tag").agg(F.count("*").alias("n"))
    return lines.join(counts, ["scheme", "tag"]).select("scheme", "tag", "n", F.concat(F.lit("**"), F.initcap("tag"), F.lit("** — "), "codes").alias("text"))


def tag_pages(docs: DataFrame) -> DataFrame:
    """(scheme, tag, text): a tag's documents under 'k of n'."""
    total = docs.groupBy("scheme").agg(F.count("*").alias("of"))
    each = docs.withColumn("tag", F.explode("tags"))
    rows = _joined(each, ["scheme", "tag"], ["number", "code"], row("../")).join(each.groupBy("scheme", "tag").agg(F.count("*").alias("k")), ["scheme", "tag"]).join(F.broadcast(total), "scheme")
    return rows.select("scheme", "tag", F.concat(F.lit("# "), F.initcap("tag"), F.lit("\n\n"), F.col("k").cast("string"), F.lit(" of "), F.col("of").cast("string"), F.lit("\n\n"), "text").alias("text"))


def document_view(docs: DataFrame) -> DataFrame:
    """(scheme, text): bodies in order under anchors, their first heading one level down."""
    body = F.concat(F.lit('<a id="'), T.anchor(F.col("scheme"), F.coalesce(F.col("number").cast("string"), F.col("tail"))), F.lit('"></a>\n\n'), F.regexp_replace(F.trim("body"), r"(?m)^# ", "## "))
    return _joined(docs, ["scheme"], ["number", "code"], body, sep="\n\n")


def legend(docs: DataFrame) -> DataFrame:
    """(scheme, status_word, n) of the statuses in use."""
    return docs.where("status_word <> ''").groupBy("scheme", "status_word").agg(F.count("*").alias("n"))


def books(entries: DataFrame, granularity: str = "month") -> DataFrame:
    """(journal, book, label, n, first, last): entries by calendar period."""
    keyed = entries.withColumn("book", T.book_key(F.col("created"), granularity))
    out = keyed.groupBy("journal", "book").agg(F.count("*").alias("n"), F.min("created").alias("first"), F.max("created").alias("last"))
    return out.withColumn("label", T.book_label(F.col("first"), granularity))


def book_pages(entries: DataFrame, granularity: str = "month") -> DataFrame:
    """(journal, book, text): a table of contents, then the entries by time and path."""
    keyed = entries.withColumn("book", T.book_key(F.col("created"), granularity))
    toc = F.concat(F.lit("- ["), F.date_format("created", "d MMM HH:mm"), F.lit(" — "), "title", F.lit("](#"), T.entry_anchor(F.col("created")), F.lit(")"))
    entry = F.concat(F.lit('<a id="'), T.entry_anchor(F.col("created")), F.lit('"></a>\n\n## '), "title", F.lit("\n\n"), F.trim("body"))
    head, full = _joined(keyed, ["journal", "book"], ["created", "path"], toc, "toc"), _joined(keyed, ["journal", "book"], ["created", "path"], entry, "entries", "\n\n")
    return head.join(full, ["journal", "book"]).select("journal", "book", F.concat("toc", F.lit("\n\n"), "entries").alias("text"))


def collected(fragments: DataFrame, style: str = "append", date: str = "") -> DataFrame:
    """(dir, n, block): fragments that are no stubs, oldest first (``changelog``: newest first under a date)."""
    real = fragments.where(~T.is_stub(F.col("body")))
    age = F.coalesce(F.col("committed_at"), F.lit((1 << 62) - 1).cast("long"))
    made = real.select("dir", F.struct(age.alias("at"), F.col("path").alias("path"), F.trim("body").alias("b")).alias("x")).groupBy("dir").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("x")).alias("xs"))
    bodies = F.transform("xs", lambda x: x["b"])
    if style == "changelog":
        return made.select("dir", "n", F.concat(F.lit(f"## {date}\n\n"), F.array_join(F.reverse(bodies), "\n\n")).alias("block"))
    return made.select("dir", "n", F.array_join(bodies, "\n\n").alias("block"))


#: The marks where collected entries are inserted, by preference.
MARKERS = ("<!-- insert-here -->", "<!-- devlog-insert-here -->", "<!-- scriv-insert-here -->")


def insert(view: Column, block: Column, style: str = "append") -> Column:
    """``view`` with ``block`` at its mark; without one null (the caller decides), without a block as it is."""
    mark = F.coalesce(*(F.when(F.contains(view, F.lit(m)), F.lit(m)) for m in MARKERS))
    at = F.instr(view, mark)
    head, tail = F.substring(view, F.lit(1), at - 1), F.substring(view, at + F.length(mark), F.length(view))
    empty = F.coalesce(block, F.lit("")) == ""
    if style == "changelog":
        rest = F.regexp_replace(tail, r"^\n+", "")
        made = F.concat(head, mark, F.lit("\n\n"), block, F.when(rest == "", F.lit("\n")).otherwise(F.concat(F.lit("\n\n"), rest)))
    else:
        made = F.concat(F.rtrim(F.regexp_replace(head, r"\s+$", "")), F.lit("\n\n"), block, F.lit("\n\n"), mark, tail)
    return F.when(mark.isNull(), F.lit(None).cast("string")).when(empty, view).otherwise(made)


def staleness(rendered: DataFrame, on_disk: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """(path, state): rendered views that are missing or differ on disk, and files no view renders."""
    have = on_disk if ignored is None else on_disk.join(ignored.select("path"), "path", "left_anti")
    want = rendered if ignored is None else rendered.join(ignored.select("path"), "path", "left_anti")
    both = want.select("path", F.col("text").alias("want"), F.lit(True).alias("r")).join(have.select("path", F.col("text").alias("have"), F.lit(True).alias("d")), "path", "full")
    state = F.when(F.col("r").isNull(), "orphaned").when(F.col("d").isNull(), "missing").when(~F.col("want").eqNullSafe(F.col("have")), "stale")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")


def findings(frames: dict[str, DataFrame]) -> DataFrame:
    """(class, n) over finding frames by class; classes without a finding are left out."""
    parts = [f.agg(F.count("*").alias("n")).select(F.lit(k).alias("class"), "n") for k, f in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


def backlinks(docs: DataFrame) -> DataFrame:
    """(code, influence, path): what a document names as its influences, with their paths where they resolve."""
    each = docs.select("code", F.explode("influenced_by").alias("influence"))
    return each.join(docs.select(F.col("code").alias("influence"), "path"), "influence", "left").select("code", "influence", "path")


def record_line(docs: DataFrame) -> DataFrame:
    """(code, line): status, version, date and issue numbers of a document."""
    issues = F.array_join(F.regexp_extract_all(F.coalesce(F.get_json_object("meta", "$.issue"), F.lit("")), F.lit(r"#\d+"), F.lit(0)), ", ")
    parts = F.array("status", F.when(F.col("version") > 1, F.concat(F.lit("v"), F.col("version").cast("string"))), F.date_format("date", "yyyy-MM-dd"), F.nullif(issues, F.lit("")))
    return docs.select("code", F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " · ").alias("line"))


def settings_diff(now: DataFrame, defaults: DataFrame) -> DataFrame:
    """Settings (key, value) that differ from their defaults."""
    both = now.join(defaults.withColumnRenamed("value", "default"), "key", "full")
    return both.where(~F.col("value").eqNullSafe(F.col("default")))


def latest_first(rows: DataFrame) -> DataFrame:
    """Books of a journal, newest first, with whether they are the newest."""
    return rows.withColumn("newest", F.col("book") == F.max("book").over(Window.partitionBy("journal"))).orderBy("journal", F.desc("book"))
