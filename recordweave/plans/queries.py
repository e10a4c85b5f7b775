"""The registered queries of the record engine, and the same in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import TagGroup
from ..functions import paths as P
from ..functions import scanner
from ..functions import text as T
from ..operators import checks, citations, identity, links, pages, remotes, reports, resolution, views
from . import derived

AS_OF, STALE_DAYS = "2024-06-30", 365
_GROUPS = (TagGroup("metal", ("small brushed brass", "promo brushed brass", "brand#11", "brand#12"), "at-most-one"), TagGroup("brand", ("brand#11", "brand#12", "brand#13"), "exactly-one", ("standard",)))
_TERMS = ["rings", "bolt", "gears", "widget"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- the derived relations in SQL ----
_P = "(CASE {k} % 3 WHEN 0 THEN 'ADR' WHEN 1 THEN 'RFC' ELSE 'SPEC' END)"


def _sql_code(key: str, shift: str = "0") -> str:
    return f"({_P.format(k=key)} || '-' || printf('%03d', {key} // 3 + {shift}))"


_STATUS = "(['Active', 'Proposed', 'Deferred', 'Superseded', 'Rejected'])[CAST(p_size % 5 AS INT) + 1]"
_WITH = f"""
docs AS (SELECT {_P.format(k='p_partkey')} AS scheme, CAST(p_partkey // 3 AS INT) AS number, {_sql_code('p_partkey')} AS code, 'docs/' || {_sql_code('p_partkey')} || '.md' AS path, p_name AS title,
  {_sql_code('p_partkey')} || ': ' || CASE WHEN p_partkey % 11 = 0 THEN upper(p_name) ELSE p_name END AS heading,
  {_STATUS} || CASE WHEN p_partkey % 4 = 0 THEN ' — noted' ELSE '' END AS status, {_STATUS} AS status_word, {_STATUS} = 'Active' AS active, [lower(p_type), lower(p_brand)] AS tags,
  CASE WHEN p_partkey % 7 > 0 THEN DATE '2020-01-01' + CAST(p_partkey % 1500 AS INT) END AS date, CAST(p_partkey % 3 + 1 AS INT) AS version,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 4 + 1 AS INT) END AS last_version, {_sql_code('p_partkey', '1')} AS influence, 'old-' || (p_partkey // 2) AS former FROM part),
cites AS (SELECT DISTINCT 'f' || (l_orderkey % 997) AS path, l_linenumber AS line, {_sql_code('l_partkey', '(CASE WHEN l_suppkey % 7 = 0 THEN 5000 ELSE 0 END)')} AS code FROM lineitem),
annots AS (SELECT 'f' || (o_orderkey % 997) AS path, CASE WHEN o_custkey % 2 = 0 THEN 'inactive-ok' ELSE 'unresolved-ok' END AS kind, {_sql_code('k', '(CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 5000 END)')} AS code,
  CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 4 + 1 ELSE 1 END AS lo, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 4 + 2 WHEN o_orderkey % 3 = 1 THEN o_custkey % 5 + 1 ELSE 9999 END AS hi, o_orderkey AS pos
  FROM (SELECT *, (o_orderkey * 13 + o_custkey) % 2000 AS k FROM orders)),
known AS (SELECT c.*, CASE WHEN d.code IS NULL THEN 'dangling' WHEN d.active THEN 'active' ELSE 'retired' END AS state FROM cites c LEFT JOIN docs d USING (code)),
classified AS (SELECT k.path, k.line, k.code, k.state, min(CASE WHEN k.line BETWEEN a.lo AND a.hi THEN a.pos END) AS excused_by FROM known k
  LEFT JOIN annots a ON a.path = k.path AND a.code = k.code AND a.kind = CASE k.state WHEN 'dangling' THEN 'unresolved-ok' WHEN 'retired' THEN 'inactive-ok' END GROUP BY ALL)
"""


def _query(name: str, sql: str | None = None, with_: bool = True):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (f"WITH {_WITH} " if with_ else "") + sql
        return f

    return add


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return citations.classify(derived.citations(spark, d), derived.docs(spark, d), derived.annotations(spark, d))


_LOUD = "SELECT code, count(*) FILTER (excused_by IS NULL) AS loud, count(*) FILTER (excused_by IS NOT NULL) AS excused, count(DISTINCT CASE WHEN excused_by IS NULL THEN path END) AS files FROM classified WHERE state = '{}' GROUP BY code HAVING loud > 0"


@_query("retired_citations", _LOUD.format("retired"))
def retired_citations(spark: SparkSession, d: str) -> DataFrame:
    return citations.flagged(_classified(spark, d))


@_query("unresolved_codes", _LOUD.format("dangling"))
def unresolved_codes(spark: SparkSession, d: str) -> DataFrame:
    return citations.flagged(_classified(spark, d), "dangling")


@_query("classified_citations", "SELECT * FROM classified")
def classified_citations(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)


@_query("acknowledged_totals", "SELECT count(*) FILTER (excused_by IS NOT NULL AND state = 'retired') AS retired, count(*) FILTER (excused_by IS NOT NULL AND state = 'dangling') AS dangling FROM classified")
def acknowledged_totals(spark: SparkSession, d: str) -> DataFrame:
    return citations.acknowledged(_classified(spark, d))


@_query("stale_annotations", """SELECT a.path, a.pos, a.kind, a.code, CASE WHEN coalesce(d.active, false) AND a.kind = 'inactive-ok' THEN 'now active' ELSE 'nothing cites it' END AS reason
FROM annots a LEFT JOIN docs d USING (code) WHERE NOT EXISTS (SELECT 1 FROM classified c WHERE c.path = a.path AND c.code = a.code AND c.excused_by = a.pos)""")
def stale_annotations(spark: SparkSession, d: str) -> DataFrame:
    return citations.stale_annotations(derived.annotations(spark, d), _classified(spark, d), derived.docs(spark, d))


@_query("sites_top5", """SELECT code, path, line, pick FROM (SELECT code, path, line, row_number() OVER (PARTITION BY code ORDER BY turn, path) AS pick FROM
(SELECT code, path, line, row_number() OVER (PARTITION BY code, path ORDER BY line) AS turn FROM classified WHERE state = 'retired' AND excused_by IS NULL)) WHERE pick <= 5""")
def sites_top5(spark: SparkSession, d: str) -> DataFrame:
    return citations.spread(_classified(spark, d))


_PENDING = """SELECT d.code, status_word, title, date, coalesce(n, 0) AS cites, coalesce(m, 0) AS unacknowledged FROM docs d LEFT JOIN
(SELECT code, count(*) AS n, count(*) FILTER (excused_by IS NULL) AS m FROM classified GROUP BY code) USING (code) WHERE status_word IN ('Proposed', 'Deferred')"""


@_query("pending_documents", _PENDING)
def pending_documents(spark: SparkSession, d: str) -> DataFrame:
    return citations.pending(derived.docs(spark, d), _classified(spark, d))


@_query("pending_headline", f"""SELECT count(*) AS n, max(date_diff('day', date, DATE '{AS_OF}')) AS oldest, count(*) FILTER (date_diff('day', date, DATE '{AS_OF}') >= {STALE_DAYS}) AS stale,
count(*) FILTER (date IS NULL) AS undated, count(*) FILTER (unacknowledged > 0) AS relied_on FROM ({_PENDING})""")
def pending_headline(spark: SparkSession, d: str) -> DataFrame:
    return citations.pending_headline(pending_documents(spark, d), AS_OF, STALE_DAYS)


@_query("badges", f"""SELECT name, value, 'https://img.shields.io/badge/' || name || '-' || value || '-' || CASE WHEN value = 0 THEN 'brightgreen' ELSE 'orange' END AS url FROM
(SELECT 'retired' AS name, count(*) AS value FROM ({_LOUD.format('retired')}) UNION ALL SELECT 'pending', count(*) FROM docs WHERE status_word IN ('Proposed', 'Deferred'))""")
def badges(spark: SparkSession, d: str) -> DataFrame:
    return citations.badges(_classified(spark, d), derived.docs(spark, d).where(F.col("status_word").isin("Proposed", "Deferred")))


@_query("title_heading", "SELECT code, title, upper(title) AS heading FROM docs WHERE heading <> code || ': ' || title")
def title_heading(spark: SparkSession, d: str) -> DataFrame:
    return checks.titles(derived.docs(spark, d))


@_query("version_history", "SELECT code, version, last_version FROM docs WHERE CASE WHEN last_version IS NOT NULL THEN last_version <> version ELSE version > 1 END")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    return checks.versions(derived.docs(spark, d))


@_query("frontmatter_checks", "SELECT code, 'undeclared status: ' || status_word AS problem FROM docs WHERE status_word = 'Rejected' UNION ALL SELECT code, 'missing owner' FROM docs")
def frontmatter_checks(spark: SparkSession, d: str) -> DataFrame:
    return checks.frontmatter(derived.docs(spark, d), ("owner",), ("Active", "Proposed", "Deferred", "Superseded"))


@_query("tag_groups", """, g AS (SELECT code, list_sort(list_intersect(tags, ['small brushed brass', 'promo brushed brass', 'brand#11', 'brand#12'])) AS m, list_sort(list_intersect(tags, ['brand#11', 'brand#12', 'brand#13'])) AS b,
list_intersect(tags, ['standard']) AS x FROM docs)
SELECT code, 'metal' AS "group", 'at-most-one' AS rule, array_to_string(m, ',') AS tags FROM g WHERE len(m) > 1
UNION ALL SELECT code, 'brand', 'exactly-one', array_to_string(b, ',') FROM g WHERE CASE WHEN len(x) > 0 THEN len(b) > 1 ELSE len(b) <> 1 END
UNION ALL SELECT code, 'brand', 'excluded', array_to_string(list_concat(b, x), ',') FROM g WHERE len(x) > 0 AND len(b) > 0""")
def tag_groups(spark: SparkSession, d: str) -> DataFrame:
    return checks.tag_groups(derived.docs(spark, d), _GROUPS)


@_query("uniform_status", "SELECT scheme, count(*) AS n, min(status_word) AS status FROM (SELECT scheme || '/' || status_word AS scheme, status_word FROM docs) GROUP BY scheme HAVING count(*) >= 10 AND count(DISTINCT status_word) = 1")
def uniform_status(spark: SparkSession, d: str) -> DataFrame:
    return checks.uniform_status(derived.docs(spark, d).withColumn("scheme", F.concat_ws("/", "scheme", "status_word")))


@_query("narrow_titles", """SELECT code, title, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(title, '(?i)\\b(widget|bolt|gear|ring)s?\\b', 1), lambda x: lower(x)))), ',') AS terms
FROM docs WHERE regexp_matches(title, '(?i)\\b(widget|bolt|gear|ring)s?\\b')""")
def narrow_titles(spark: SparkSession, d: str) -> DataFrame:
    return checks.narrow_titles(derived.docs(spark, d), _TERMS).withColumn("terms", F.array_join("terms", ","))


@_query("tag_index", "SELECT scheme, tag, count(*) AS n, string_agg(code, ', ' ORDER BY number, code) AS codes FROM (SELECT scheme, number, code, unnest(tags) AS tag FROM docs) GROUP BY scheme, tag")
def tag_index(spark: SparkSession, d: str) -> DataFrame:
    return views.categories(derived.docs(spark, d)).select("scheme", "tag", "n", F.element_at(F.split("text", r"\*\* — ", 2), 2).alias("codes"))


@_query("scheme_index", """SELECT scheme, '| Document | Title | Status |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
string_agg('| [' || code || '](' || path || ') | ' || title || ' | ' || status || ' |', chr(10) ORDER BY number, code) AS text FROM docs GROUP BY scheme""")
def scheme_index(spark: SparkSession, d: str) -> DataFrame:
    return views.index(derived.docs(spark, d))


@_query("next_numbers", "SELECT scheme, max(number) + 1 AS next FROM docs GROUP BY scheme")
def next_numbers(spark: SparkSession, d: str) -> DataFrame:
    return identity.next_number(derived.docs(spark, d))


@_query("alias_map", "SELECT 'OLD-' || printf('%03d', CAST(substr(former, 5) AS INT)) AS old, arg_max(code, number * 100000 + ascii(code)) AS code FROM docs GROUP BY 1")
def alias_map(spark: SparkSession, d: str) -> DataFrame:
    return identity.aliases(derived.docs(spark, d))


@_query("backlinks", "SELECT d.code, d.influence, e.path FROM docs d LEFT JOIN docs e ON e.code = d.influence")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    return views.backlinks(derived.docs(spark, d))


@_query("legend", "SELECT scheme, status_word, count(*) AS n FROM docs GROUP BY ALL")
def legend(spark: SparkSession, d: str) -> DataFrame:
    return views.legend(derived.docs(spark, d))


@_query("allocation", """SELECT scheme, tail, CAST(m + rn AS INT) AS number, scheme || '-' || printf('%03d', m + rn) AS code, path FROM (SELECT 'ADR' AS scheme, 'tmp' || printf('%05d', s_suppkey) AS tail, printf('%05d', s_suppkey) AS path,
row_number() OVER (ORDER BY CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey * 7919 % 101 END NULLS LAST, printf('%05d', s_suppkey)) AS rn, (SELECT max(number) FROM docs WHERE scheme = 'ADR') AS m FROM supplier)""")
def allocation(spark: SparkSession, d: str) -> DataFrame:
    s = derived.table(spark, d, "supplier")
    waiting = s.select(F.lit("ADR").alias("scheme"), F.format_string("tmp%05d", "s_suppkey").alias("tail"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") * 7919 % 101).alias("committed_at"), F.format_string("%05d", "s_suppkey").alias("path"))
    return identity.allocate(waiting, derived.docs(spark, d))


@_query("rename_plan", "SELECT code AS old, 'DOC-' || printf('%03d', number) AS new, path, 'docs/DOC-' || printf('%03d', number) || '.md' AS new_path FROM docs WHERE scheme = 'RFC'")
def rename_plan(spark: SparkSession, d: str) -> DataFrame:
    return identity.rename_plan(derived.docs(spark, d), "RFC", "DOC")


_ENTRIES = "SELECT event_type AS journal, printf('%012d', event_id) AS path, date_trunc('second', ts) AS created, event_type || ' ' || user_id AS title FROM events"


@_query("journal_books", f"SELECT journal, strftime(created, '%Y-%m-%d') AS book, count(*) AS n, min(created) AS first, max(created) AS last, strftime(min(created), '%-d %B %Y') AS label FROM ({_ENTRIES}) GROUP BY 1, 2", with_=False)
def journal_books(spark: SparkSession, d: str) -> DataFrame:
    return views.books(derived.entries(spark, d), "day")


@_query("journal_contents", f"""SELECT journal, strftime(created, '%Y-%m') AS book, string_agg('- [' || strftime(created, '%-d %b %H:%M') || ' — ' || title || '](#' || strftime(created, '%Y%m%d%H%M%S') || ')', chr(10) ORDER BY created, path) AS toc
FROM ({_ENTRIES}) GROUP BY 1, 2""", with_=False)
def journal_contents(spark: SparkSession, d: str) -> DataFrame:
    pages = views.book_pages(derived.entries(spark, d).withColumn("body", F.lit("")), "month")
    return pages.select("journal", "book", F.split("text", "\n\n", 2)[0].alias("toc"))


@_query("journal_seconds", f"""SELECT journal, path, created, title, max(sec - nth) OVER (PARTITION BY journal ORDER BY sec, path ROWS UNBOUNDED PRECEDING) + nth AS assigned FROM
(SELECT *, CAST(epoch(created) AS BIGINT) AS sec, row_number() OVER (PARTITION BY journal ORDER BY epoch(created), path) AS nth FROM ({_ENTRIES}))""", with_=False)
def journal_seconds(spark: SparkSession, d: str) -> DataFrame:
    return identity.step_forward(derived.entries(spark, d).drop("body"))


@_query("journal_paths", f"SELECT path, strftime(created, '%Y/%m/%d/%H%M%S') || '.md' AS filed FROM ({_ENTRIES})", with_=False)
def journal_paths(spark: SparkSession, d: str) -> DataFrame:
    return derived.entries(spark, d).select("path", T.journal_path(F.col("created")).alias("filed"))


@_query("collected_fragments", """SELECT 'inbox/' || conv_id AS dir, count(*) AS n, string_agg(trim(text), chr(10) || chr(10) ORDER BY CASE WHEN turn % 3 <> 2 THEN turn * 10 END NULLS LAST, printf('%08d', turn)) AS block
FROM conversations WHERE regexp_replace(regexp_replace(coalesce(text, ''), '<!--.*?-->', '', 'gs'), '\\s', '', 'g') <> '' GROUP BY 1""", with_=False)
def collected_fragments(spark: SparkSession, d: str) -> DataFrame:
    return views.collected(derived.fragments(spark, d))


_N = "doc_id % 600"


@_query("file_citations", f"""SELECT DISTINCT 'notes/' || doc_id || '.md' AS path, CAST(line AS INT) AS line, code FROM documents, LATERAL (VALUES (2, 'ADR-' || printf('%03d', {_N})), (2, 'RFC-' || printf('%03d', {_N} % 50)), (4, 'SPEC-' || printf('%03d', {_N} + 1))) v(line, code)""", with_=False)
def file_citations(spark: SparkSession, d: str) -> DataFrame:
    return citations.extract(derived.files(spark, d), ("ADR", "RFC", "SPEC"))


@_query("file_link_targets", f"""SELECT 'notes/' || doc_id || '.md' AS path, 5 AS line, unnest(['../part/' || ({_N} % 300) || '.md#top', './a/../p' || ({_N} % 9) || '.md', 'http://x.test']) AS target FROM documents""", with_=False)
def file_link_targets(spark: SparkSession, d: str) -> DataFrame:
    return links.targets(derived.files(spark, d))


@_query("broken_targets", f"""SELECT path, 5 AS line, target, resolved FROM (SELECT 'notes/' || doc_id || '.md' AS path, unnest([{{'target': '../part/' || ({_N} % 300) || '.md#top', 'resolved': 'part/' || ({_N} % 300) || '.md'}}, {{'target': './a/../p' || ({_N} % 9) || '.md', 'resolved': 'notes/p' || ({_N} % 9) || '.md'}}], recursive := true) FROM documents)
WHERE resolved NOT IN (SELECT 'part/' || p_partkey || '.md' FROM part)""", with_=False)
def broken_targets(spark: SparkSession, d: str) -> DataFrame:
    here = derived.table(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))
    files = derived.files(spark, d)
    return links.broken(links.targets(files), files.select("path", F.lit("notes").alias("base")), here)


@_query("page_targets", """SELECT kind, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'absolute' WHEN starts_with(t, '//') THEN 'host' WHEN starts_with(t, '#') THEN 'anchor' WHEN starts_with(t, '/') THEN 'rooted' ELSE 'relative' END AS kind
FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '(?:href|src)="([^"]*)"', 1)) AS t FROM pages)) GROUP BY kind""", with_=False)
def page_targets(spark: SparkSession, d: str) -> DataFrame:
    return links.html_targets(derived.table(spark, d, "pages")).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@_query("view_staleness", """, k AS (SELECT 'docs/' || d.influence || '.md' AS path, coalesce(substr(e.heading, length(e.code) + 3), '') AS text FROM docs d LEFT JOIN docs e ON e.code = d.influence)
SELECT path, state FROM (SELECT coalesce(r.path, k.path) AS path, CASE WHEN r.path IS NULL THEN 'orphaned' WHEN k.path IS NULL THEN 'missing' WHEN r.title <> k.text THEN 'stale' END AS state FROM docs r FULL JOIN k ON r.path = k.path) WHERE state IS NOT NULL""")
def view_staleness(spark: SparkSession, d: str) -> DataFrame:
    """On disk is a page for every influence, with the heading's text: each scheme's first document has none, its last an orphan."""
    docs = derived.docs(spark, d)
    headings = docs.select(F.col("code").alias("influence"), F.substr("heading", F.length("code") + 3).alias("text"))
    have = views.backlinks(docs).join(headings, "influence", "left").select(F.concat(F.lit("docs/"), "influence", F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return views.staleness(docs.select("path", F.col("title").alias("text")), have)


@_query("finding_classes", f"""SELECT class, n FROM (SELECT 'retired-citations' AS class, count(*) AS n FROM ({_LOUD.format('retired')}) UNION ALL SELECT 'unresolved-codes', count(*) FROM ({_LOUD.format('dangling')})
UNION ALL SELECT 'pending-documents', count(*) FROM docs WHERE status_word IN ('Proposed', 'Deferred')) WHERE n > 0""")
def finding_classes(spark: SparkSession, d: str) -> DataFrame:
    c = _classified(spark, d)
    return views.findings({"retired-citations": citations.flagged(c), "unresolved-codes": citations.flagged(c, "dangling"), "pending-documents": derived.docs(spark, d).where(F.col("status_word").isin("Proposed", "Deferred"))})


@_query("remote_urls", """SELECT prefix, tail, CASE prefix WHEN 'UP' THEN CASE WHEN k % 2 = 0 THEN 'https://github.com/o/r/blob/main/docs/' || lower(tail) || '-x.md' ELSE '' END WHEN 'TK' THEN 'https://t.test/' || tail || '/' || k ELSE 'https://github.com/a/b/blob/main/' || tail || '.md' END AS link
FROM (SELECT s_suppkey AS k, ['UP', 'TK', 'NO'][CAST(s_suppkey % 3 AS INT) + 1] AS prefix, 'ADR-' || s_suppkey AS tail FROM supplier)""", with_=False)
def remote_urls(spark: SparkSession, d: str) -> DataFrame:
    s = derived.table(spark, d, "supplier")
    tail = F.concat(F.lit("ADR-"), F.col("s_suppkey").cast("string"))
    refs = s.select(F.element_at(F.array(F.lit("UP"), F.lit("TK"), F.lit("NO")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("prefix"), tail.alias("tail"))
    even = F.concat(F.lit("ADR-"), (F.col("s_suppkey") * 2).cast("string"))
    lock = s.select(F.lit("UP").alias("remote"), even.alias("code"), F.concat(F.lower(even), F.lit("-x.md")).alias("filename"))
    remotes = spark.createDataFrame([("UP", "o/r", "main", "docs", "", ""), ("TK", "", "main", "", "https://t.test/{code}/{number}", ""), ("NO", "a/b", "main", "", "", "")], "prefix string, repo string, ref string, dir string, url string, uid string")
    return links.remote_urls(refs, remotes, lock)


@_query("masked_references")
def masked_references(spark: SparkSession, d: str) -> DataFrame:
    return scanner.scan_references(derived.files(spark, d), ("ADR", "RFC", "SPEC"))


@_query("file_directives")
def file_directives(spark: SparkSession, d: str) -> DataFrame:
    return scanner.scan_directives(derived.files(spark, d))


@_query("swept_files")
def swept_files(spark: SparkSession, d: str) -> DataFrame:
    return identity.sweep(derived.files(spark, d), {f"ADR-{n:03d}": f"DOC-{n:03d}" for n in range(600)})


# ---- rendered pages as ordered lines, references resolved, reports, plans ----
_SCHEMES = ("ADR", "RFC", "SPEC")
_MEANINGS = [("Active", "in force", "it holds"), ("Proposed", "open", ""), ("Rejected", None, "was declined | for good")]
_DECLARED = [("brand#12", "Brand twelve", "made | here"), ("small brushed brass", None, None)]


def _views(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, f"views/{s.lower()}", f"{s} documents") for s in _SCHEMES], "scheme string, view string, title string")


_V = "(SELECT unnest(['ADR', 'RFC', 'SPEC']) AS scheme)"
_README = "'views/' || lower(scheme) || '/README.md'"
_TITLED = "array_to_string(list_transform(regexp_extract_all(tag, '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '')"


@_query("scheme_pages", f""", t AS (SELECT scheme, number, code, unnest(tags) AS tag FROM docs),
g AS (SELECT *, CASE tag WHEN 'brand#12' THEN 0 WHEN 'small brushed brass' THEN 1 ELSE 2147483647 END AS rank FROM t)
SELECT {_README} AS path, 0 AS block, 0 AS number, '' AS code, '# ' || scheme || ' documents' AS line FROM {_V}
UNION ALL SELECT {_README}, 1, n, '', line FROM {_V}, (VALUES (0, '| `Active` | in force | It holds |'), (1, '| `Proposed` | open |  |'), (2, '| `Rejected` |  | Was declined | for good |')) m(n, line)
UNION ALL SELECT {_README}, 2, rank, tag, '**[' || CASE tag WHEN 'brand#12' THEN 'Brand twelve' ELSE {_TITLED} END || '](tags/' || tag || '.md)** (' || count(*) || ')' || CASE tag WHEN 'brand#12' THEN ' — made | here' ELSE '' END || ':' FROM g GROUP BY scheme, tag, rank
UNION ALL SELECT {_README}, 2, rank, tag || chr(1) || printf('%010d', number) || chr(1) || code, '[' || printf('%03d', number) || '](../../docs/' || code || '.md)' FROM g
UNION ALL SELECT {_README}, 3, number, code, '| [' || code || '](../../docs/' || code || '.md)' || CASE WHEN version > 1 THEN ' v' || version ELSE '' END || ' | ' || title || ' | ' || status || ' |' FROM docs""")
def scheme_pages(spark: SparkSession, d: str) -> DataFrame:
    meanings = spark.createDataFrame([(s, *m, i) for s in _SCHEMES for i, m in enumerate(_MEANINGS)], "scheme string, status string, label string, blurb string, ordinal int")
    declared = spark.createDataFrame([(s, *t, i) for s in _SCHEMES for i, t in enumerate(_DECLARED)], "scheme string, tag string, label string, blurb string, ordinal int")
    return pages.scheme_pages(derived.docs(spark, d), _views(spark), meanings, declared)


@_query("assembled_pages", """SELECT 'docs/' || lower(scheme) || '.md' AS path, 0 AS block, 0 AS number, '' AS code, '# ' || scheme || ' documents' AS line FROM (SELECT unnest(['RFC', 'SPEC']) AS scheme)
UNION ALL SELECT 'docs/' || lower(d.scheme) || '.md', 1, d.number, d.code, '<a name="' || lower(d.scheme) || '-' || d.number || '"></a>' || chr(10) || chr(10) || '## ' || d.number || '. ' || d.title || chr(10) || chr(10) || 'Body.' || chr(10) || chr(10) || '*v' || d.version
|| ' · shaped by ' || CASE WHEN e.code IS NULL THEN d.influence ELSE '[' || d.influence || '](' || d.influence || '.md)' END || CASE WHEN d.status <> 'Active' THEN ' · **' || d.status || '**' ELSE '' END || ' · origin: ' || d.title || '*' FROM docs d LEFT JOIN docs e ON e.code = d.influence WHERE d.scheme <> 'ADR'""")
def assembled_pages(spark: SparkSession, d: str) -> DataFrame:
    outputs = spark.createDataFrame([("RFC", "docs/rfc.md", "Active"), ("SPEC", "docs/spec.md", "Active")], "scheme string, output string, active string")
    docs = derived.docs(spark, d)
    body, origin = F.concat(F.lit("# "), "code", F.lit(": "), "title", F.lit("\n\nBody.\n")), F.to_json(F.struct(F.concat("title", F.lit(".")).alias("origin")))
    return pages.assembled_pages(docs.withColumn("body", body).withColumn("meta", origin), outputs)


@_query("journal_pages", """SELECT event_type AS journal, strftime(ts, '%Y-%m') AS book, date_trunc('second', ts) AS created, printf('%012d', event_id) AS path, block, CASE block WHEN 1 THEN '- [' || strftime(ts, '%-d %b %H:%M') || ' — ' || event_type || ' ' || user_id || '](#' || strftime(ts, '%Y%m%d%H%M%S') || ')'
ELSE '<a id="' || strftime(ts, '%Y%m%d%H%M%S') || '"></a>' || chr(10) || chr(10) || '## ' || event_type || ' ' || user_id || chr(10) || chr(10) || trim(coalesce(props, '')) END AS line FROM events, (VALUES (1), (2)) b(block)""", with_=False)
def journal_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.journal_pages(derived.entries(spark, d), "month")


@_query("page_anchors", """SELECT path, number, coalesce(max(CASE WHEN named THEN anchor END), max(anchor)) AS anchor FROM (SELECT 'p/' || s_suppkey || '.md' AS path, CAST(s_suppkey % 7 AS INT) AS number, (s_suppkey % 7) || '-' || replace(regexp_replace(lower(s_name), '[^a-z0-9 -]', '', 'g'), ' ', '-') AS anchor, false AS named FROM supplier
UNION ALL SELECT 'p/' || s_suppkey || '.md', CAST(s_nationkey % 7 AS INT), 'dp-' || (s_nationkey % 7), true FROM supplier) GROUP BY path, number""", with_=False)
def page_anchors(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: (F.col(c) % 7).cast("string")
    text = F.concat(F.lit("# Head\n\n## "), n("s_suppkey"), F.lit(". "), "s_name", F.lit("!\n\ntext\n<a name=\"dp-"), n("s_nationkey"), F.lit("\"></a>\n"))
    return pages.anchors(derived.table(spark, d, "supplier").select(F.concat(F.lit("p/"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"), text.alias("text")))


@_query("resolved_references", f""", former AS (SELECT former, arg_max(code, number * 100000 + ascii(code)) AS code FROM docs GROUP BY 1),
r AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'docs/' || {_sql_code('o_custkey')} || '.md' WHEN 1 THEN 'docs/spec.md' ELSE 'notes/n.md' END AS path, CASE WHEN o_orderkey % 4 < 2 THEN 'docs' ELSE 'notes' END AS base, o_custkey,
  CASE o_orderkey % 3 WHEN 0 THEN 'issue' ELSE 'scheme' END AS kind, CASE WHEN o_orderkey % 3 = 2 THEN 'old-' || o_custkey ELSE {_sql_code('o_custkey')} END AS code FROM orders)
SELECT k, CASE WHEN kind = 'issue' THEN CASE WHEN o_custkey // 3 > 20 THEN 'https://x.test/' || (o_custkey // 3) END WHEN d.code IS NULL OR d.path = r.path THEN NULL
  WHEN d.scheme = 'SPEC' THEN CASE r.path WHEN 'docs/spec.md' THEN '' ELSE CASE r.base WHEN 'docs' THEN 'spec.md' ELSE '../docs/spec.md' END END || '#' || CASE d.number % 2 WHEN 1 THEN 'odd-' || d.number ELSE 'spec-' || d.number END
  WHEN r.base = 'docs' THEN d.code || '.md' ELSE '../docs/' || d.code || '.md' END AS target
FROM r LEFT JOIN former f ON f.former = r.code LEFT JOIN docs d ON d.code = coalesce(f.code, r.code)""")
def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    docs, o = derived.docs(spark, d), derived.table(spark, d, "orders")
    number, code, key = F.expr("CAST(o_custkey div 3 AS int)"), derived._code("o_custkey"), F.col("o_orderkey")
    tailed = key % 3 == 2
    refs = o.select(
        key.alias("k"), F.when(key % 4 == 0, F.concat(F.lit("docs/"), code, F.lit(".md"))).when(key % 4 == 1, "docs/spec.md").otherwise("notes/n.md").alias("path"), F.when(key % 4 < 2, "docs").otherwise("notes").alias("base"),
        F.when(key % 3 == 0, "issue").otherwise("scheme").alias("kind"), F.when(tailed, "old").otherwise(derived._prefix("o_custkey")).alias("prefix"), F.when(~tailed, number).alias("num"),
        F.when(tailed, F.col("o_custkey").cast("string")).otherwise("").alias("tail"), F.lit(False).alias("cued"),
    )
    schemes = spark.createDataFrame([("ADR", "index", ""), ("RFC", "index", ""), ("SPEC", "document", "docs/spec.md")], "scheme string, render string, output string")
    odd = docs.where("scheme = 'SPEC'").select(F.lit("docs/spec.md").alias("path"), "number", F.when(F.col("number") % 2 == 1, F.concat(F.lit("odd-"), F.col("number").cast("string"))).alias("anchor"))
    return resolution.targets(refs, docs, schemes, odd, "https://x.test/{n}", highest=20).select("k", "target")


_FOREIGN = """f AS (SELECT s_suppkey AS k, (['UP', 'TK', 'ID', 'NO', 'XX'])[CAST(s_suppkey % 5 AS INT) + 1] AS prefix, (['ADR', 'DP', 'RFC'])[CAST(s_nationkey % 3 AS INT) + 1] AS family FROM supplier),
a AS (SELECT k, prefix, family, family || '-' || printf('%03d', k) AS code, EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey * 2 = k) AS listed FROM f),
l AS (SELECT k, prefix, CASE prefix WHEN 'ID' THEN family || '-' || k ELSE lower(family) || '-' || k END AS tail, CASE prefix WHEN 'ID' THEN family || '-' || k ELSE code END AS code,
  CASE prefix WHEN 'XX' THEN 'none' WHEN 'ID' THEN 'identifier' WHEN 'TK' THEN 'url' WHEN 'NO' THEN 'dir' ELSE CASE family WHEN 'DP' THEN 'section' WHEN 'RFC' THEN CASE WHEN listed THEN 'family-dir' ELSE 'absent' END ELSE CASE WHEN listed THEN 'dir' ELSE 'absent' END END END AS rung,
  CASE prefix WHEN 'XX' THEN '' WHEN 'ID' THEN 'https://i.test/' || family || '/' || k || '?id=' || family || '-' || k WHEN 'TK' THEN 'https://t.test/' || code || '/' || k || '/' || family WHEN 'NO' THEN 'https://github.com/a/b/blob/main/' || code || '.md'
  ELSE CASE family WHEN 'DP' THEN 'https://github.com/o/r/blob/main/docs/dp.md#dp-' || k WHEN 'RFC' THEN CASE WHEN listed THEN 'https://github.com/o/r/blob/main/rfcs/' || lower(code) || '-x.md' ELSE '' END ELSE CASE WHEN listed THEN 'https://github.com/o/r/blob/main/docs/' || lower(code) || '-x.md' ELSE '' END END END AS link FROM a)
"""


def _foreign(spark: SparkSession, d: str) -> DataFrame:
    s = derived.table(spark, d, "supplier")
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    families, key = ("ADR", "DP", "RFC"), F.col("s_suppkey").cast("string")
    prefix, family = pick(("UP", "TK", "ID", "NO", "XX"), "s_suppkey"), pick(families, "s_nationkey")
    refs = s.select(prefix.alias("prefix"), F.concat(F.when(prefix == "ID", family).otherwise(F.lower(family)), F.lit("-"), key).alias("tail"))
    even = s.select(F.explode(F.array(*map(F.lit, families))).alias("f"), (F.col("s_suppkey") * 2).alias("n")).select(T.code(F.col("f"), F.col("n")).alias("code"))
    lock = even.select(F.lit("UP").alias("remote"), "code", F.concat(F.lower("code"), F.lit("-x.md")).alias("filename"))
    known = spark.createDataFrame([("UP", "", "o/r", "main", "docs", "", "-", ""), ("TK", "", "", "main", "", "https://t.test/{code}/{number}/{prefix}", "-", ""), ("ID", "", "", "", "", "https://i.test/{1}/{2}?id={uid}", ":", "([A-Z]+)-([0-9]+)"), ("NO", "", "a/b", "main", "", "", "-", "")], remotes.REMOTES)
    shapes = spark.createDataFrame([("UP", "DP", "", "docs/dp.md", "", ""), ("UP", "RFC", "rfcs", "", "", "")], remotes.FAMILIES)
    return remotes.ladder(refs, known, lock, shapes)


@_query("remote_ladder", f"WITH {_FOREIGN} SELECT prefix, tail, code, rung, link FROM l", with_=False)
def remote_ladder(spark: SparkSession, d: str) -> DataFrame:
    return _foreign(spark, d)


@_query("remote_rungs", f"WITH {_FOREIGN} SELECT prefix, rung, count(*) AS cites, count(DISTINCT code) AS codes FROM l GROUP BY prefix, rung", with_=False)
def remote_rungs(spark: SparkSession, d: str) -> DataFrame:
    return remotes.rung_summary(_foreign(spark, d))


@_query("discovered_names", f"""SELECT 'R' || (p_size % 3) AS remote, {_sql_code('p_partkey')} AS code, min(lower({_P.format(k='p_partkey')}) || '-' || (p_partkey // 3) || '-' || replace(p_name, ' ', '-') || '.md') AS filename FROM part GROUP BY 1, 2""", with_=False)
def discovered_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lower(derived._prefix("p_partkey")), F.lit("-"), F.expr("CAST(p_partkey div 3 AS string)"), F.lit("-"), F.translate("p_name", " ", "-"), F.lit(".md"))
    return remotes.discovered(derived.table(spark, d, "part").select(F.concat(F.lit("R"), (F.col("p_size") % 3).cast("string")).alias("remote"), name.alias("name")))


_LINKED = "'[' || code || '](../docs/' || code || '.md)'"


@_query("pending_report", f"""SELECT 1 AS block, date, cites, code, '| ' || coalesce(strftime(date, '%Y-%m-%d'), 'undated') || ' | ' || status_word || ' | ' || {_LINKED} || ' | ' || cites || ' | ' || unacknowledged || ' | ' || title || ' |' AS line FROM ({_PENDING})
UNION ALL SELECT 2, date, cites, code, {_LINKED} FROM ({_PENDING}) WHERE cites = 0""")
def pending_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.pending_report(pending_documents(spark, d), derived.docs(spark, d), "reports")


@_query("pending_console", f"""SELECT date, cites, code, CASE WHEN length(age) < 6 THEN lpad(age, 6, ' ') ELSE age END || CASE WHEN days >= {STALE_DAYS} THEN '!' ELSE ' ' END || ' ' || CASE WHEN length(status_word) < 8 THEN rpad(status_word, 8, ' ') ELSE status_word END || '  ' || CASE WHEN length(code) < 10 THEN rpad(code, 10, ' ') ELSE code END
|| '  ' || CASE WHEN length(CAST(cites AS VARCHAR)) < 5 THEN lpad(CAST(cites AS VARCHAR), 5, ' ') ELSE CAST(cites AS VARCHAR) END || '  ' || title AS line FROM (SELECT *, date_diff('day', date, DATE '{AS_OF}') AS days, coalesce(date_diff('day', date, DATE '{AS_OF}') || 'd', '?') AS age FROM ({_PENDING}))""")
def pending_console(spark: SparkSession, d: str) -> DataFrame:
    return reports.pending_console(pending_documents(spark, d), AS_OF, STALE_DAYS, code_width=10)


@_query("pending_sentence", f"""SELECT 'pending decisions: ' || n || ' undecided document(s), oldest ' || oldest || ' days' || CASE WHEN stale > 0 THEN ', ' || stale || ' over {STALE_DAYS} days' ELSE '' END || CASE WHEN undated > 0 THEN ', ' || undated || ' undated' ELSE '' END
|| CASE WHEN relied_on <> n THEN ', ' || relied_on || ' with unacknowledged references' ELSE '' END AS line FROM ({ORACLES['pending_headline'].partition(_WITH)[2]})""")
def pending_sentence(spark: SparkSession, d: str) -> DataFrame:
    return reports.pending_sentence(pending_headline(spark, d), STALE_DAYS)


@_query("status_counters", "SELECT state, count(DISTINCT code) AS codes, count(*) AS cites, count(*) FILTER (excused_by IS NOT NULL) AS excused, count(DISTINCT path) AS files FROM classified GROUP BY state")
def status_counters(spark: SparkSession, d: str) -> DataFrame:
    return reports.status_counters(_classified(spark, d))


@_query("reference_report", f"""SELECT c.code, 0 AS pick, '### ' || CASE WHEN d.code IS NULL THEN c.code ELSE '[' || c.code || '](../docs/' || c.code || '.md) — ' || d.title END || ' (' || n || CASE n WHEN 1 THEN ' citation' ELSE ' citations' END || ' in ' || m || CASE m WHEN 1 THEN ' file)' ELSE ' files)' END AS line
FROM (SELECT code, count(*) AS n, count(DISTINCT path) AS m FROM classified WHERE excused_by IS NULL AND state <> 'active' GROUP BY code) c LEFT JOIN docs d USING (code)
UNION ALL SELECT code, pick, '- [' || path || ':' || line || '](../' || path || ')' FROM ({ORACLES['sites_top5'].partition(_WITH)[2]})""")
def reference_report(spark: SparkSession, d: str) -> DataFrame:
    found = _classified(spark, d)
    return reports.reference_report(found, citations.spread(found), derived.docs(spark, d), "reports")


@_query("journal_listing", f"SELECT journal, count(DISTINCT strftime(created, '%Y-%m-%d')) AS books, count(*) AS entries, min(created) AS first, max(created) AS last FROM ({_ENTRIES}) GROUP BY journal", with_=False)
def journal_listing(spark: SparkSession, d: str) -> DataFrame:
    return reports.journal_listing(journal_books(spark, d))


@_query("move_plan", f""", o AS (SELECT s_suppkey AS k, lower({_sql_code('s_suppkey')}) AS doc, {_sql_code('s_suppkey')} AS old, CASE WHEN s_nationkey < 20 THEN 'RFC' ELSE 'NOPE' END AS dest, s_nationkey < 5 AS copy, 'tmp' || printf('%05d', s_suppkey) AS tail FROM supplier),
m AS (SELECT o.*, d.number, d.scheme, d.path, CASE WHEN dest = 'NOPE' THEN 'both schemes must be configured' WHEN d.code IS NULL THEN old || ' has no document' END AS problem FROM o LEFT JOIN docs d ON d.code = o.old)
SELECT doc, old, CASE WHEN problem IS NULL THEN dest || '-' || tail END AS new, path, CASE WHEN problem IS NULL THEN 'docs/' || dest || '-' || tail || '.md' END AS new_path, CASE WHEN problem IS NULL THEN CASE WHEN copy THEN 'copy' ELSE 'move' END END AS act,
CASE WHEN problem IS NULL AND copy THEN 'Superseded — by ' || dest || '-' || tail END AS status, CASE WHEN problem IS NULL AND NOT copy THEN scheme || '-' || number END AS formerly, CASE WHEN problem IS NULL AND NOT copy THEN CASE scheme WHEN 'SPEC' THEN '#spec-' || number ELSE old || '.md' END END AS old_address, problem FROM m""")
def move_plan(spark: SparkSession, d: str) -> DataFrame:
    s, key = derived.table(spark, d, "supplier"), F.col("s_nationkey")
    operations = s.select(F.lower(derived._code("s_suppkey")).alias("doc"), F.when(key < 20, "rfc").otherwise("nope").alias("to"), F.when(key < 5, "supersede").alias("strategy"), F.format_string("tmp%05d", "s_suppkey").alias("tail"))
    schemes = spark.createDataFrame([("ADR", "docs", "index"), ("RFC", "docs", "index"), ("SPEC", "docs", "document")], "scheme string, dir string, render string")
    return resolution.move_plan(operations, derived.docs(spark, d), schemes)


_LINES = f"""'# note ' || doc_id || chr(10) || 'per ADR-' || printf('%03d', {_N}) || ' and RFC ' || ({_N} % 50) || ' it works' || chr(10) || '<!-- inactive-ok: ADR-' || printf('%03d', {_N}) || ' — kept -->' || chr(10) || 'see https://example.test/SPEC-' || printf('%03d', {_N}) || ' for SPEC-' || printf('%03d', {_N} + 1) || chr(10)"""


@_query("rebased_files", f"""SELECT 'notes/' || doc_id || '.md' AS path, md5({_LINES} || '[doc](../part/' || ({_N} % 300) || '.md#top) and [other](../notes/p' || ({_N} % 9) || '.md) and [web](http://x.test)' || chr(10) || coalesce(text, '')) AS digest FROM documents""", with_=False)
def rebased_files(spark: SparkSession, d: str) -> DataFrame:
    """Whole files as seen from another folder; the SQL knows the derived lines' links alone."""
    return derived.files(spark, d).select("path", F.md5(P.rebase(F.col("text"), F.concat(P.relative(P.parent(F.col("path")), F.lit("docs")), F.lit("/")))).alias("digest"))


@_query("site_counters", f"""SELECT count(*) AS links, count(DISTINCT doc_id) AS pages, count(*) FILTER (place = 'page') AS page, count(*) FILTER (place = 'asset') AS asset, count(*) FILTER (place = 'repository') AS repository, count(*) FILTER (place = 'unplaced') AS unplaced FROM (
SELECT doc_id, CASE WHEN r IN (SELECT 'part/' || p_size || '.md' FROM part) THEN 'page' WHEN r IN (SELECT 'notes/p' || s_nationkey || '.md' FROM supplier) THEN 'asset' WHEN r IN (SELECT 'part/' || p_partkey || '.md' FROM part) THEN 'repository' ELSE 'unplaced' END AS place
FROM (SELECT doc_id, unnest(['part/' || ({_N} % 300) || '.md', 'notes/p' || ({_N} % 9) || '.md']) AS r FROM documents))""", with_=False)
def site_counters(spark: SparkSession, d: str) -> DataFrame:
    named = lambda table, lead, key: derived.table(spark, d, table).select(F.concat(F.lit(lead), F.col(key).cast("string"), F.lit(".md")).alias("path")).distinct()
    placed = links.retarget(links.targets(derived.files(spark, d)), named("part", "part/", "p_size"), named("supplier", "notes/p", "s_nationkey"), named("part", "part/", "p_partkey"))
    return reports.site_counters(placed)
