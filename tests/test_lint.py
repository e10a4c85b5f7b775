"""The whole record: violations, findings, rewrites."""

from recordweave import catalog
from recordweave.operators import citations, lint
from recordweave.sources import records
from test_records import TREE


def record(spark, tmp_path):
    for path, text in {**TREE, "w.md": "see [[ADR-001|first]] and [[NO-1]] and `[[ADR-001]]` [UP-ADR-032](http://wrong)\n<!-- unlinted-file: all -->"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = records.files(spark, str(tmp_path))
    docs = records.documents(files, catalog.Scheme("ADR", "record")).cache()
    return lint.Record(files.where("path IN ('notes.md', 'w.md')"), docs, records.entries(files, "log", "journal")), files


def test_lint(spark, tmp_path):
    c = catalog.load('[record]\nissue_url = "https://i.test/{n}"\nfail_on = ["unresolved-codes"]\n[record.schemes.ADR]\ndir = "record"\n[record.remotes.UP]\nrepo = "o/r"\n')
    r, files = record(spark, tmp_path)
    bad = {(v.check, v.path) for v in lint.violations(r, c).collect()}
    assert {("frontmatter", "record/ADR-003.md"), ("title", "record/ADR-003.md"), ("version", "record/ADR-001.md"), ("journal", "journal/2024/02/01/000000.md"), ("bare-reference", "notes.md"), ("wikilink", "w.md")} <= bad
    found = [(f["class"], f.message, f.fails) for f in lint.findings(r, c, files.select("path")).collect()]
    kinds = {k for k, _, _ in found}
    assert {"unresolved-codes", "unlinted-files", "broken-targets"} <= kinds
    assert all(fails == (k == "unresolved-codes") for k, _, fails in found)
    assert [(h.path, h.prefix, h.tail, h.target) for h in lint.hand_links(r.files, c).collect()] == [("w.md", "UP", "ADR-032", "http://wrong")]
    assert {(w.inner, w.target) for w in lint.wikilinks(r.files, r.docs).collect()} == {("ADR-001", "record/ADR-001.md"), ("NO-1", None)}
    text = lint.expand_wikilinks(r.files, {"ADR-001": "a.md"}).first().text
    assert text.startswith("see [first](a.md) and [[NO-1]] and `[[ADR-001]]`")


def test_report_and_rewrites(spark):
    docs = spark.createDataFrame([("ADR-001", "T", "Rejected", False)], "code string, title string, status string, active boolean")
    cites = spark.createDataFrame([("b", 2, "ADR-001"), ("a", 9, "ADR-001"), ("a", 1, "ADR-001")], "path string, line int, code string")
    none = spark.createDataFrame([], "path string, code string, kind string, lo int, hi int, pos int")
    assert lint.report(citations.classify(cites, docs, none), docs, sites=2).first().text == "## ADR-001 — T (Rejected)\n\n3 sites in 2 files\n\n- a:1\n- b:2"
    files = spark.createDataFrame([("x", "ADR-tmpab1c2 adr-tmpab1c2 ADR-tmpzzzzz"), ("y", "none")], "path string, text string")
    allocated = spark.createDataFrame([("ADR", "tmpab1c2", "ADR-013")], "scheme string, tail string, code string")
    assert [tuple(r) for r in lint.settle_codes(files, allocated).collect()] == [("x", "ADR-013 adr-013 ADR-tmpzzzzz")]
    stamped = spark.createDataFrame([("a", "---\nx: 1\n---\nb", "O-1"), ("b", "---\nformerly: [O-2]\n---\n", "O-1"), ("c", "---\nformerly: [O-1]\n---\n", "O-1"), ("d", "b", "O-1")], "path string, text string, old string")
    assert {r.path: r.text for r in lint.stamp_formerly(stamped).collect()} == {"a": "---\nformerly: [O-1]\nx: 1\n---\nb", "b": "---\nformerly: [O-2, O-1]\n---\n", "c": "---\nformerly: [O-1]\n---\n", "d": "---\nformerly: [O-1]\n---\nb"}
    lines = spark.createDataFrame([("t", 1, "[a.x]"), ("t", 2, 'd = "old"'), ("t", 3, "[b]"), ("t", 4, 'd = "old"')], "path string, line_no int, line string")
    assert [r.line for r in lint.section_paths(lines, ("a",), {"old": "new"}).orderBy("line_no").collect()] == ["[a.x]", 'd = "new"', "[b]", 'd = "old"']


def test_every_check_and_finding_is_wired(spark, tmp_path):
    doc = "---\ntitle: Nine\nstatus: Active\ntags: [x]\ndate: '2024-01-01'\nformerly: [ADR-tmpaaaaa]\n---\n# ADR-009: Nine\n"
    note = "see ADR-tmpaaaaa and [UP-ADR-032](http://wrong) and [UP-ADR-033](https://github.com/o/r/blob/main/ADR-033.md)\n\nthen [UP-ADR-034](http://kept) <!-- url-ok: UP-ADR-034 — moved -->\n"
    for path, text in {"record/ADR-009.md": doc, "n.md": note}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    c = catalog.load('[record]\n[record.schemes.ADR]\ndir = "record"\n[record.remotes.UP]\nrepo = "o/r"\n')
    files = records.files(spark, str(tmp_path))
    text = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    r = lint.Record(
        files.where("path = 'n.md'"), records.documents(files, c.schemes[0]),
        rendered=text(("v/a.md", "new"), ("v/b.md", "same")), on_disk=text(("v/a.md", "old"), ("v/b.md", "same"), ("v/c.md", "x")),
        pages=text(("docs/a.md", ""), ("docs/b.md", "")).select("path"), index=text(("docs/README.md", "[a](docs/a.md)")).select("text"),
        statuses=spark.createDataFrame([("ADR", "Active"), ("ADR", "Sleeping")], "scheme string, status string"),
    )
    bad = {(v.check, v.path) for v in lint.violations(r, c).collect()}
    assert {("view", "v/a.md"), ("view", "v/c.md"), ("index", "docs/b.md"), ("status", "ADR")} <= bad
    assert not {("view", "v/b.md"), ("index", "docs/a.md")} & bad
    found = {(f["class"], f.message) for f in lint.findings(r, c).collect()}
    assert ("legacy-spellings", "n.md:1 ADR-tmpaaaaa is ADR-009") in found
    assert {m for k, m in found if k == "hand-written-urls"} == {"n.md:1 http://wrong is not https://github.com/o/r/blob/main/ADR-032.md"}
