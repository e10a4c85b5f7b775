"""A small tree of files, end to end."""

import pytest
from pyspark.sql import functions as F

from recordweave import catalog
from recordweave.functions import scanner
from recordweave.functions import text as T
from recordweave.operators import checks, citations, identity, links, views
from recordweave.sources import records
from recordweave.streaming import inbox


def doc(status, title, tags="[a]", extra="", body="Body.", code="ADR-001"):
    return f"---\nstatus: {status}\ntitle: {title}\ntags: {tags}\ndate: '2024-01-05'\n{extra}---\n# {code}: {title}\n\n{body}\n"


TREE = {
    "record/ADR-001.md": doc("Active", "First", "[ Infra, b]", "version: 2\nhistory:\n- {version: 1, date: x, note: n}\n"),
    "record/ADR-012.md": doc("Superseded — by 1", "Old", code="ADR-012", body="mentions ADR-012 and ADR-001"),
    "record/ADR-012-again.md": doc("Active", "Twice", code="ADR-012"),
    "record/ADR-003.md": "---\ntitle: None\n---\n# ADR-003: Other\n",
    "record/ADR-tmpab1c2.md": doc("Proposed", "New", code="ADR-tmpab1c2", extra="formerly: [ADR-tmpzzzzz]\n"),
    "notes.md": "intro\nper ADR-012 and ADR-012 it works\nADR-012 <!-- inactive-ok: ADR-012 — kept -->\nsee https://x.test/ADR-012 and ADR-099\nADR-001 [dead](gone.md#x) [ok](record/ADR-001.md)\n",
    "journal/2024/01/05/101500.md": "---\ntitle: Entry\ncreated: '2024-01-05 10:15:00'\n---\nText\n",
    "journal/2024/02/01/000000.md": "---\ncreated: '2024-02-01 00:00:01'\n---\nText\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return records.files(spark, str(root))


@pytest.fixture(scope="module")
def docs(files):
    return records.documents(files, catalog.Scheme("ADR", "record")).cache()


def test_files_and_documents(files, docs):
    assert {r.path: r.text for r in files.collect()} == TREE
    got = {r.code: r for r in docs.collect()}
    assert set(got) == {"ADR-001", "ADR-012", "ADR-003", "ADR-tmpab1c2"}
    assert got["ADR-012"].path == "record/ADR-012-again.md" and got["ADR-001"].tags == ["infra", "b"] and got["ADR-003"].status == ""
    assert got["ADR-001"].active and got["ADR-001"].version == 2 and got["ADR-001"].history[0].version == 1 and str(got["ADR-001"].date) == "2024-01-05"


def test_citations(files, docs):
    status = docs.withColumn("active", F.col("code") != "ADR-012").where("number IS NOT NULL")
    notes = files.where("path = 'notes.md' OR path LIKE 'record/%'")
    cites = citations.extract(notes, ("ADR",), docs)
    at = {(r.path, r.line, r.code) for r in cites.collect()}
    assert ("notes.md", 2, "ADR-012") in at and ("notes.md", 4, "ADR-012") not in at and ("notes.md", 4, "ADR-099") in at
    ann = citations.annotations(scanner.scan_directives(notes), status)
    found = citations.classify(cites.where("path = 'notes.md'"), status, ann).cache()
    assert {(r.line, r.code, r.state, r.excused_by) for r in found.collect()} == {(2, "ADR-012", "retired", None), (3, "ADR-012", "retired", 1), (4, "ADR-099", "dangling", None), (5, "ADR-001", "active", None)}
    assert [(r.code, r.loud, r.excused, r.files) for r in citations.flagged(found).collect()] == [("ADR-012", 1, 1, 1)]
    assert [r.code for r in citations.flagged(found, "dangling").collect()] == ["ADR-099"]
    assert citations.stale_annotations(ann, found, status).count() == 0
    assert tuple(citations.acknowledged(found).first()) == (1, 0)


def test_annotation_problems(spark):
    d = spark.createDataFrame([("p", "inactive-ok", "line", ["ADR-001"], "", 1, 1, 2), ("p", "inactive-ok", "line", ["ADR-009"], "", 2, 2, 3), ("p", "unresolved-ok", "line", ["adr-1"], "", 3, 3, 4), ("p", "inactive-ok", "line", ["x"], "", 4, 4, 5), ("p", "inactive-ok", "line", ["ADR-001", "12"], "", 5, 5, 6)], "path string, name string, scope string, args array<string>, reason string, line int, lo int, hi int")
    known = spark.createDataFrame([("ADR-001", True)], "code string, active boolean")
    got = {r.line: r.problem for r in citations.annotations(d, known).collect()}
    assert got == {1: None, 2: "no such document: ADR-009", 3: "not unresolved: ADR-001", 4: "without a code", 5: "number without its prefix"}


def test_checks(docs):
    problems = {(r.code, r.problem) for r in checks.frontmatter(docs, ("owner",)).collect()}
    assert ("ADR-003", "no status") in problems and ("ADR-003", "no tags") in problems and ("ADR-001", "missing owner") in problems
    assert [r.code for r in checks.titles(docs).collect()] == ["ADR-003"]
    assert [(r.code, r.last_version) for r in checks.versions(docs).collect()] == [("ADR-001", 1)]
    assert [(r.code, r.terms) for r in checks.narrow_titles(docs, ["firsts"]).collect()] == [("ADR-001", ["first"])]
    assert checks.undefined_statuses(["Active", "Done"]) == ["Done"]


def test_tag_groups(spark):
    groups = (catalog.TagGroup("strength", ("sound", "overreach", "invalid"), "exactly-one"), catalog.TagGroup("failure", ("equivocation", "gap"), "any", ("sound",)))
    rows = spark.createDataFrame([("a", ["overreach"]), ("b", ["gap"]), ("c", ["sound", "invalid"]), ("d", ["sound", "gap"])], "code string, tags array<string>")
    got = {}
    for r in checks.tag_groups(rows, groups).collect():
        got[r.code] = got.get(r.code, 0) + 1
    assert got == {"b": 1, "c": 1, "d": 1}


def test_journals(files):
    e = records.entries(files, "log", "journal").cache()
    assert {(r.path, r.problem) for r in checks.journals(e).collect()} == {("journal/2024/02/01/000000.md", "no title"), ("journal/2024/02/01/000000.md", "path and created differ")}
    assert [(r.book, r.n, r.label) for r in views.books(e, "month").orderBy("book").collect()] == [("2024-01", 1, "January 2024"), ("2024-02", 1, "February 2024")]
    assert "## Entry" in views.book_pages(e.where("title IS NOT NULL"), "day").first().text


def test_links(spark, files):
    found = links.targets(files.where("path = 'notes.md'"))
    missing = links.broken(found, spark.createDataFrame([("notes.md", ".")], "path string, base string"), files.select("path"))
    assert [(r.line, r.target) for r in missing.collect()] == [(5, "gone.md#x")]
    paths = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../y",), (".",), ("",)], "p string")
    assert [r[0] for r in paths.select(T.normalize_path(F.col("p"))).collect()] == ["a/c", "../x", "../y", ".", "."]
    locals_ = spark.createDataFrame([("http://x",), ("#a",), ("/r",), ("a%20b+c.md#z",), ("x{1}",), ("?q",)], "t string")
    assert [r[0] for r in locals_.select(T.local_path(F.col("t"))).collect()] == [None, None, None, "a b+c.md", None, None]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(T.canonical(F.lit("adr 7"))) == "ADR-007" and get(T.canonical(F.lit("ADR-1234"))) == "ADR-1234"
    assert get(T.escape_cell(F.lit("a|b\\|c"))) == "a\\|b\\|c" and get(T.sentence_case(F.lit("aB c"))) == "AB c"
    assert get(T.status_word(F.lit("Active — note — x"))) == "Active" and get(T.is_stub(F.lit(" <!-- a\nb --> \n")))
    assert get(T.code_prefix(F.lit("A-B-3"))) == "A-B" and get(T.plural(F.lit(1), "site")) == "1 site"
    assert str(get(T.created_from_path(F.lit("j/2024/01/05/101500.md")))) == "2024-01-05 10:15:00"
    for style, want in (("append", "head\n\nnew\n\n<!-- insert-here -->tail"), ("changelog", "head\n<!-- insert-here -->\n\nnew\n\ntail")):
        assert get(views.insert(F.lit("head\n<!-- insert-here -->tail"), F.lit("new"), style)) == want
    assert get(views.insert(F.lit("no mark"), F.lit("new"))) is None


def test_identity(spark, docs):
    waiting = spark.createDataFrame([("ADR", "tmpb", 5, "b"), ("ADR", "tmpa", 5, "a"), ("ADR", "tmpc", None, "c"), ("NEW", "tmpd", 1, "d")], "scheme string, tail string, committed_at long, path string")
    assert {r.tail: r.code for r in identity.allocate(waiting, docs).collect()} == {"tmpa": "ADR-013", "tmpb": "ADR-014", "tmpc": "ADR-015", "tmpd": "NEW-001"}
    files = spark.createDataFrame([("a.md", "ADR-1 ADR-001 ADR 12 XADR-1\nformerly: [ADR-001]\n- ADR-001"), ("b.md", "none")], "path string, text string")
    got = identity.sweep(files, {"ADR-001": "DOC-007"}).collect()
    assert [(r.path, r.text, r.n) for r in got] == [("a.md", "DOC-7 DOC-007 ADR 12 XADR-1\nformerly: [ADR-001]\n- ADR-001", 2)]
    linked = identity.linkify(spark.createDataFrame([("n.md", "ADR-001\n\n<div>\nADR-001\n\n`ADR-001`")], "path string, text string"), {"ADR-001": "d.md"}, ("ADR",))
    once = linked.first().text
    assert once == '[ADR-001](d.md)\n\n<div>\n<a href="d.md">ADR-001</a>\n\n`ADR-001`'
    assert identity.linkify(spark.createDataFrame([("n.md", once)], "path string, text string"), {"ADR-001": "d.md"}, ("ADR",)).count() == 0


def test_views(spark, docs):
    assert views.index(docs).first().text.count("\n") == 5
    assert {(r.tag, r.n) for r in views.categories(docs).collect()} == {("infra", 1), ("b", 1), ("a", 2)}
    rendered = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "path string, text string")
    disk = spark.createDataFrame([("a", "x"), ("b", "Y"), ("d", ""), ("e", "")], "path string, text string")
    assert {(r.path, r.state) for r in views.staleness(rendered, disk, disk.where("path = 'e'")).collect()} == {("b", "stale"), ("c", "missing"), ("d", "orphaned")}


def test_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.md").write_text("one")
    (tmp_path / "in/2.md").write_text("<!-- stub -->")
    run = lambda: inbox.collect(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), delete=True).awaitTermination()
    run()
    (tmp_path / "in/3.md").write_text("three")
    run()
    assert {r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"one", "three"} and not list((tmp_path / "in").glob("*.md"))


def test_codes_of_other_projects(spark):
    files = spark.createDataFrame([("a.md", "see UP-ADR-032 here\nand ADR-002, UP-ADR-001"), ("b.md", "UP-ADR-040"), ("c.md", "formerly: [ADR-002]"), ("d.md", "formerly:\n- ADR-002\n- ADR-001\nADR-002")], "path string, text string")
    lock = spark.createDataFrame([("UP-", "ADR-001"), ("UP-", "ADR-032")], "lead string, code string")
    remotes = (("UP-", r"[A-Z]{2,10}-\d{1,4}"),)
    local = [("a.md", 2, "ADR-002"), ("c.md", 1, "ADR-002"), ("d.md", 4, "ADR-002")]
    rows = lambda df: sorted(tuple(r) for r in df.select("path", "line", "code").collect())
    assert rows(citations.extract(files, ("ADR",), remotes=remotes)) == local
    assert rows(citations.extract(files, ("ADR",), remotes=remotes, lock=lock)) == sorted([*local, ("b.md", 1, "UP-ADR-040")])
    docs = spark.createDataFrame([("ADR-032", True)], "code string, active boolean")
    d = spark.createDataFrame([("a.md", "unresolved-ok", "line", ["UP-ADR-040"], 1), ("a.md", "unresolved-ok", "line", ["UP-ADR-032"], 2), ("a.md", "inactive-ok", "line", ["UP-ADR-032"], 3)], "path string, name string, scope string, args array<string>, line int")
    d = d.withColumn("lo", d.line).withColumn("hi", d.line + 1)
    got = {r.line: (r.code, r.problem) for r in citations.annotations(d, docs, remotes, lock).collect()}
    assert got == {1: ("UP-ADR-040", None), 2: ("UP-ADR-032", "not unresolved: UP-ADR-032"), 3: ("UP-ADR-032", None)}


def test_steps_go_on_after_midnight(spark):
    rows = [("j", "a", "2024-01-01 23:59:59"), ("j", "b", "2024-01-01 23:59:59"), ("j", "c", "2024-01-02 00:00:00"), ("j", "d", "2024-01-02 00:00:05"), ("k", "e", "2024-01-01 23:59:59")]
    entries = spark.createDataFrame(rows, "journal string, path string, created string").selectExpr("journal", "path", "cast(created as timestamp) as created")
    got = {r.path: r.assigned for r in identity.step_forward(entries).collect()}
    first = got["a"]
    assert got == {"a": first, "b": first + 1, "c": first + 2, "d": first + 6, "e": first}


def test_roots_hold_any_character(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    (root / "x").mkdir(parents=True)
    (root / "x" / "n 1+2.md").write_text("t")
    assert [(r.path, r.text) for r in records.files(spark, str(root)).collect()] == [("x/n 1+2.md", "t")]
