"""Scanner queries over texts whose codes, links, fences and comments lie behind their first 200 characters."""

import pytest

from recordweave.plans import derived, queries

LONG = "Plain prose, 12 words: (a) & [b]; 100 % of it!\n" * 9
TAIL = "then ADR-007 holds, as RFC 8 says\n```\nADR-009 in a fence\n```\n<!-- SPEC-011 in a comment -->\n<!-- unresolved-ok: RFC-012 — later -->\nsee [more](../part/4.md) and [nothing](gone/2.md)\n\n`SPEC-013` but SPEC-014\n"
TEXTS = {1: LONG + TAIL, 2: None, 3: "", 4: "short: ADR-015", 5: "é" * 300 + " SPEC-016"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(4,), (5,)], "p_partkey long").write.parquet(f"{d}/part.parquet")
    return d


def own(rows, after=5):
    """Rows of the text itself: the derived lines before it are ``after``."""
    return sorted(r for r in rows if r[1] > after)


def line(text, what):
    """1-based line of ``what`` in a file around ``text``."""
    return 6 + text[: text.index(what)].count("\n")


def test_files_hold_whole_texts(spark, folder):
    got = {r.path: r.text for r in derived.files(spark, folder).collect()}
    assert {k: v.split("\n", 5)[5] for k, v in got.items()} == {f"notes/{k}.md": v or "" for k, v in TEXTS.items()}


def test_references_and_citations(spark, folder):
    t = TEXTS[1]
    refs = own([(r.path, r.line, r.text) for r in queries.QUERIES["masked_references"](spark, folder).collect()])
    shown = [("notes/1.md", line(t, x), x) for x in ("ADR-007", "RFC 8", "SPEC-014")]
    assert refs == sorted([*shown, ("notes/4.md", 6, "ADR-015"), ("notes/5.md", 6, "SPEC-016")])
    cited = own([(r.path, r.line, r.code) for r in queries.QUERIES["file_citations"](spark, folder).collect()])
    assert {("notes/1.md", line(t, "ADR-007"), "ADR-007"), ("notes/1.md", line(t, "RFC 8"), "RFC-008"), ("notes/1.md", line(t, "ADR-009"), "ADR-009"), ("notes/1.md", line(t, "SPEC-014"), "SPEC-014"), ("notes/4.md", 6, "ADR-015"), ("notes/5.md", 6, "SPEC-016")} <= set(cited)
    assert "RFC-012" not in {c for _, _, c in cited}


def test_directives_and_links(spark, folder):
    t = TEXTS[1]
    found = own([(r.path, r.line, r.name, tuple(r.args), r.reason) for r in queries.QUERIES["file_directives"](spark, folder).collect()])
    assert found == [("notes/1.md", line(t, "<!-- unresolved-ok"), "unresolved-ok", ("RFC-012",), "later")]
    at = line(t, "[more]")
    assert own([(r.path, r.line, r.target) for r in queries.QUERIES["file_link_targets"](spark, folder).collect()]) == [("notes/1.md", at, "../part/4.md"), ("notes/1.md", at, "gone/2.md")]
    assert own([(r.path, r.line, r.target) for r in queries.QUERIES["broken_targets"](spark, folder).collect()]) == [("notes/1.md", at, "gone/2.md")]


def test_sweep_returns_whole_texts(spark, folder):
    got = {r.path: r.text for r in queries.QUERIES["swept_files"](spark, folder).collect()}
    assert {k: v.split("\n", 5)[5] for k, v in got.items()} == {f"notes/{k}.md": (v or "").replace("ADR-", "DOC-") for k, v in TEXTS.items()}
