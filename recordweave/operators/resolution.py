"""Where references lead, and plans that move documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from . import identity


def link_base(path: Column, fragments: dict[str, str], schemes: list[tuple[str, str, str, str]], journals: dict[str, str]) -> Column:
    """The folder that links written in ``path`` start from.

    ``fragments`` maps an inbox to the file it is collected into, ``schemes`` are (folder,
    render, output, view) and ``journals`` maps a folder to that of its pages. The first
    family that holds the path decides; other files start where they lie.
    """
    here, out = P.parent(path), None

    def rule(test: Column, folder: str) -> None:
        nonlocal out
        out = F.when(test, F.lit(folder)) if out is None else out.when(test, F.lit(folder))

    for inbox, target in fragments.items():
        rule(here == inbox, target.rpartition("/")[0])
    for folder, render, output, view in schemes:
        if render == "document" and output:
            rule(here == folder, output.rpartition("/")[0])
        elif render == "index":
            rule(path == f"{folder}/README.stub", view)
    for folder, output in journals.items():
        rule(path.startswith(folder + "/"), output)
    return here if out is None else out.otherwise(here)


def targets(refs: DataFrame, docs: DataFrame, schemes: DataFrame, anchors: DataFrame, issue_url: str = "", remote: DataFrame | None = None, highest: int | Column = 0) -> DataFrame:
    """References with their ``target``, written from the folder ``base`` that their file's links start from; null where they lead nowhere.

    ``refs(path, base, kind, prefix, num, tail, cued)``: a tail is looked up among live
    documents, then among former codes. ``schemes(scheme, render, output)`` says whether a
    document is a file or a section of a page; ``anchors(path, number, anchor)`` are the
    sections that a page itself names. ``remote(prefix, tail, link)`` answers foreign codes.
    A document never links to itself.
    """
    tailed = F.coalesce("tail", F.lit("")) != ""
    spelled = F.when(tailed, F.concat_ws("-", "prefix", "tail")).otherwise(T.code(F.col("prefix"), F.col("num")))
    rows = refs.withColumn("code", F.when(F.col("kind") == "scheme", spelled))
    known = docs.select("code", F.struct(F.col("code").alias("code"), "scheme", "path", F.coalesce(F.col("number").cast("string"), "tail").alias("slot"), "number").alias("doc"))
    former = identity.aliases(docs).withColumnRenamed("code", "now").join(known.withColumnRenamed("code", "now"), "now").select(F.col("old"), F.col("doc").alias("once"))
    rows = rows.join(known, "code", "left").join(former, F.when(tailed, T.canonical(F.col("code"))) == F.col("old"), "left").drop("old")
    rows = rows.withColumn("doc", F.coalesce("doc", "once")).drop("once")
    rows = rows.withColumn("family", F.coalesce("doc.scheme", "prefix")).join(F.broadcast(schemes.select(F.col("scheme").alias("family"), "render", "output")), "family", "left")
    named = anchors.select(F.col("path").alias("page"), F.col("number").alias("section"), "anchor")
    section = F.coalesce("doc.number", F.when(~tailed, F.col("num")))
    rows = rows.join(named, (F.col("output") == F.col("page")) & (section == F.col("section")), "left")

    own = F.coalesce(F.col("doc.path") == F.col("path"), F.lit(False))
    file = F.when(F.col("doc").isNotNull(), P.relative(F.col("doc.path"), F.col("base")))
    slot = F.coalesce("anchor", F.concat(F.lower("family"), F.lit("-"), "doc.slot"))
    part = F.concat(F.when(F.col("path") == F.col("output"), "").otherwise(P.relative(F.col("output"), F.col("base"))), F.lit("#"), slot)
    local = F.when(own, F.lit(None).cast("string")).when(F.col("render") == "document", part).otherwise(file)
    issue = F.when((F.col("num") > highest) | F.col("cued"), F.replace(F.lit(issue_url), F.lit("{n}"), F.col("num").cast("string"))) if issue_url else F.lit(None).cast("string")
    target = F.when(F.col("kind") == "scheme", local).when(F.col("kind") == "issue", issue)
    if remote is not None:
        answers = remote.select("prefix", "tail", F.nullif("link", F.lit("")).alias("answer")).dropDuplicates(["prefix", "tail"])
        rows = rows.join(answers, ["prefix", "tail"], "left")
        target = target.when(F.col("kind") == "remote", F.col("answer"))
    return rows.withColumn("target", target).select(*refs.columns, "target")


def minted(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted(scheme, seed)`` with a temporary tail each, none of which a document or another row has.

    A tail depends on its seed. Of rows with one tail the first by seed keeps it, unless it
    is taken; the others take the second of their own. Each attempt is settled before the
    next, and a row still without a tail after four of them has null (the space is 36**5 a scheme).
    """
    taken = docs.where("tail IS NOT NULL").select("scheme", "tail")
    left, done = wanted.select("scheme", "seed"), None
    for attempt in range(4):
        tried = left.withColumn("tail", P.minted_tail(F.col("seed"), attempt))
        held = taken if done is None else taken.unionByName(done.select("scheme", "tail"))
        first = tried.join(held.withColumn("used", F.lit(True)).distinct(), ["scheme", "tail"], "left")
        first = first.withColumn("nth", F.row_number().over(Window.partitionBy("scheme", "tail").orderBy("seed")))
        ok = F.col("used").isNull() & (F.col("nth") == 1)
        got = first.where(ok).select("scheme", "seed", "tail")
        done = got if done is None else done.unionByName(got)
        left = first.where(~ok).select("scheme", "seed")
    return done.unionByName(left.withColumn("tail", F.lit(None).cast("string")))


def move_plan(operations: DataFrame, docs: DataFrame, schemes: DataFrame) -> DataFrame:
    """What moving documents does: ``operations(doc, to, strategy, tail)`` by former code.

    A document arrives under a temporary code in its new scheme's folder. ``supersede``
    copies it and leaves a tombstone with a status that names the new code; otherwise it
    moves, is stamped with its former code, and its old address (a section's anchor or a
    file name, as its scheme renders) is mapped. ``problem`` says why an operation cannot be done.
    """
    conf = schemes.select("scheme", "dir", "render")
    rows = operations.withColumn("old", T.canonical(F.col("doc"))).withColumn("to", F.upper("to"))
    rows = rows.join(docs.select(F.col("code").alias("old"), "scheme", "number", "path"), "old", "left")
    rows = rows.withColumn("source", F.coalesce("scheme", T.code_prefix(F.col("old")))).drop("scheme")
    rows = rows.join(F.broadcast(conf.select(F.col("scheme").alias("source"), "render")), "source", "left")
    rows = rows.join(F.broadcast(conf.select(F.col("scheme").alias("to"), "dir")), "to", "left")
    problem = (
        F.when(~F.col("old").rlike(r"^[A-Z]+-\d+$"), F.concat("doc", F.lit(" is not a code")))
        .when(F.col("render").isNull() | F.col("dir").isNull(), "both schemes must be configured")
        .when(F.col("path").isNull(), F.concat("old", F.lit(" has no document")))
    )
    new = F.concat_ws("-", "to", "tail")
    copy = F.coalesce(F.col("strategy") == "supersede", F.lit(False))
    address = F.when(F.col("render") == "document", F.concat(F.lit("#"), F.lower("source"), F.lit("-"), F.col("number").cast("string"))).otherwise(P.name(F.col("path")))
    made = rows.withColumn("problem", problem).withColumn("new", F.when(F.col("problem").isNull(), new))
    return made.select(
        "doc", "old", "new", "path", F.concat("dir", F.lit("/"), "new", F.lit(".md")).alias("new_path"),
        F.when(F.col("new").isNotNull(), F.when(copy, "copy").otherwise("move")).alias("act"),
        F.when(copy & F.col("new").isNotNull(), F.concat(F.lit("Superseded — by "), "new")).alias("status"),
        F.when(~copy & F.col("new").isNotNull(), F.concat(F.col("source"), F.lit("-"), F.col("number").cast("string"))).alias("formerly"),
        F.when(~copy & F.col("new").isNotNull(), address).alias("old_address"), "problem",
    )


def pending_numbers(docs: DataFrame) -> DataFrame:
    """(code, path) of documents that still wait for a number; a check of a merge fails unless it is empty."""
    return docs.where("number IS NULL").select("code", "path")


def links_only(before: DataFrame, after: DataFrame, prose: tuple[str, ...] = ("summary",)) -> DataFrame:
    """Rewrites of frontmatter (``path``, ``meta`` in JSON on both sides) with whether they only added links.

    All other keys must be as they were, and prose must be as it was once its links are labels again.
    """
    kind = "map<string, string>"
    b, a = F.from_json("b.meta", kind), F.from_json("a.meta", kind)
    rest = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: ~k.isin(*prose))))
    same = rest(a).eqNullSafe(rest(b)) & a.isNotNull() & b.isNotNull()
    for key in prose:
        was, is_ = F.coalesce(b[key], F.lit("")), F.coalesce(a[key], F.lit(""))
        same = same & (P.unlinked(is_) == was)
    return before.alias("b").join(after.alias("a"), "path").select("path", same.alias("survives"))
