"""Paths, pages, resolution and reports on small rows, beside the queries that have SQL."""

import json
import posixpath
import random
from urllib.parse import unquote

from pyspark.sql import functions as F

from recordweave.catalog import Remote
from recordweave.functions import paths as P
from recordweave.functions.register import register
from recordweave.operators import pages, remotes, reports, resolution


def test_relative_paths_agree_with_posixpath(spark):
    rnd = random.Random(5)
    pick = lambda: "/".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5)))
    rows = [(pick(), pick()) for _ in range(200)] + [("a", "a"), ("a/b", "a/b/c"), ("a/./b/../c", "a")]
    got = spark.createDataFrame(rows, "t string, b string").select("t", "b", P.relative(F.col("t"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == [posixpath.relpath("/" + t, "/" + b) for t, b in rows]


def test_rebase_moves_relative_targets_alone(spark):
    cases = {
        "see [a](x.md#t), [b](../y/./z.md)": "see [a](../d/x.md#t), [b](../y/z.md)",
        "[a](#t) [b](/r) [c](https://x.test/q) [d](mailto:e)": "[a](#t) [b](/r) [c](https://x.test/q) [d](mailto:e)",
        "](x)": "](../d/x)",
        "none": "none",
        "": "",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", P.rebase(F.col("t"), F.lit("../d/")).alias("r"), P.rebase(F.col("t"), F.lit("")).alias("same")).collect()
    assert {r.t: r.r for r in got} == cases and all(r.t == r.same for r in got)
    assert spark.range(1).select(P.rebase(F.lit(None).cast("string"), F.lit("../")).alias("r")).first().r is None


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(P.title_words(F.lit("open-source_tools v2x"))) == "open-source_tools v2x".title()
    assert one(P.after_title(F.lit("pre\n# T\n\nbody"), F.lit("L"))) == "pre\n# T\n\nL\n\nbody"
    assert one(P.after_title(F.lit("body"), F.lit("L"))) == "L\n\nbody" and one(P.after_title(F.lit("# T"), F.lit(""))) == "# T"
    assert one(P.staged(F.lit("README.md"))) == "index.md" and one(P.staged(F.lit("docs/README.md"))) == "docs/README.md"
    assert one(P.anchor_tail(F.lit("GP-004"))) == "4" and one(P.anchor_tail(F.lit("GP-tmp47fje"))) == "tmp47fje"
    assert one(P.set_field(F.lit("a: 1\ntags:\n- x\n- y\nb: 2"), "tags", F.lit("[z]"))) == "a: 1\ntags: [z]\nb: 2"
    assert one(P.set_field(F.lit("a: 1"), "tags", F.lit("[z]"))) == "a: 1"
    assert one(P.issue_site(F.lit("https://github.com/Own/Repo/issues/{n}"))).base_url == "own.github.io/Repo" and one(P.issue_site(F.lit("https://x.test/1"))) is None
    d = lambda kind, num, tail, text="": one(P.describe(F.lit(kind), F.lit("ADR"), F.lit(num), F.lit(tail), F.lit(text)))
    assert (d("scheme", 7, ""), d("scheme", None, "tmpabcde"), d("issue", 7, ""), d("remote", None, "X-1", "UP-X-1")) == ("ADR-007", "ADR-tmpabcde", "#7", "UP-X-1")


def test_link_base_is_where_prose_renders(spark):
    base = resolution.link_base(F.col("p"), {"inbox": "docs/log/CHANGES.md"}, [("rec/gp", "document", "docs/gp.md", ""), ("rec/adr", "index", "", "docs/adr")], {"rec/log": "docs/journal"})
    want = {"inbox/a.md": "docs/log", "rec/gp/GP-1.md": "docs", "rec/adr/README.stub": "docs/adr", "rec/adr/ADR-1.md": "rec/adr", "rec/log/2024/01/x.md": "docs/journal", "top.md": ""}
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", base.alias("b")).collect()
    assert {r.p: r.b for r in got} == want


def test_targets_of_live_tails_aliases_sections_and_other_projects(spark):
    docs = spark.createDataFrame(
        [("ADR", 1, None, "ADR-001", "r/ADR-001.md", ["ADR-tmpaaaaa"]), ("ADR", None, "tmpbbbbb", "ADR-tmpbbbbb", "r/ADR-tmpbbbbb.md", []), ("GP", 2, None, "GP-002", "g/GP-002.md", ["GP-tmpccccc"])],
        "scheme string, number int, tail string, code string, path string, formerly array<string>",
    )
    schemes = spark.createDataFrame([("ADR", "index", ""), ("GP", "document", "docs/gp.md")], "scheme string, render string, output string")
    refs = [
        (1, "n.md", "", "scheme", "ADR", None, "tmpaaaaa"), (2, "n.md", "", "scheme", "ADR", None, "tmpbbbbb"), (3, "n.md", "", "scheme", "GP", None, "tmpccccc"), (4, "docs/gp.md", "docs", "scheme", "GP", 2, ""),
        (5, "r/ADR-001.md", "r", "scheme", "ADR", 1, ""), (6, "n.md", "", "scheme", "ADR", 9, ""), (7, "n.md", "", "remote", "UP", None, "ADR-001"), (8, "n.md", "", "issue", "", 7, ""), (9, "n.md", "", "scheme", "GP", 5, ""),
    ]
    rows = spark.createDataFrame([(*r, False) for r in refs], "k int, path string, base string, kind string, prefix string, num int, tail string, cued boolean")
    anchors = spark.createDataFrame([("docs/gp.md", 5, "by-hand")], "path string, number int, anchor string")
    remote = spark.createDataFrame([("UP", "ADR-001", "https://u.test")], "prefix string, tail string, link string")
    got = {r.k: r.target for r in resolution.targets(rows, docs, schemes, anchors, "https://i.test/{n}", remote, highest=10).collect()}
    assert got == {1: "r/ADR-001.md", 2: "r/ADR-tmpbbbbb.md", 3: "docs/gp.md#gp-2", 4: "#gp-2", 5: None, 6: None, 7: "https://u.test", 8: None, 9: "docs/gp.md#by-hand"}


def test_minted_tails_are_new_and_repeatable(spark):
    wanted = spark.range(3000).select(F.lit("ADR").alias("scheme"), F.col("id").cast("string").alias("seed"))
    first = wanted.limit(1).select("scheme", F.lit(0).alias("n"), P.minted_tail(F.lit("7")).alias("tail"))
    made = resolution.minted(wanted, first).collect()
    tails = [r.tail for r in made]
    assert len(set(tails)) == 3000 and first.first().tail not in tails
    assert all(t.startswith("tmp") and len(t) == 8 and t.isalnum() and t == t.lower() for t in tails)
    assert sorted(made) == sorted(resolution.minted(wanted.repartition(7), first).collect())


def test_rewrites_that_only_add_links(spark):
    meta = lambda **k: json.dumps(k)
    before = spark.createDataFrame([(p, meta(title="T", summary="see ADR-001")) for p in "abc"], "path string, meta string")
    after = spark.createDataFrame([("a", meta(title="T", summary="see [ADR-001](x.md)")), ("b", meta(title="U", summary="see ADR-001")), ("c", meta(title="T", summary="saw [ADR-001](x.md)"))], "path string, meta string")
    assert {r.path: r.survives for r in resolution.links_only(before, after).collect()} == {"a": True, "b": False, "c": False}


def test_foreign_codes_and_locks(spark):
    family = (Remote("UP"), Remote("UPX"), Remote("ID", delim=":", uid=r"[a-z]{3}"))
    texts = spark.createDataFrame([("UP-adr-7",), ("UPX-DP-018",), ("ID:abc",), ("ID:abcd",), ("see UP-ADR-1",)], "t string")
    got = [r.c and tuple(r.c) for r in texts.select(remotes.composed(F.col("t"), family).alias("c")).collect()]
    assert got == [("UP", "ADR-007"), ("UPX", "DP-018"), ("ID", "abc"), None, None]
    lock = remotes.discovered(spark.createDataFrame([("UP", "adr-7-b.md"), ("UP", "ADR-007-a.md"), ("UP", "notes.md"), ("AB", "DP-1.md")], "remote string, name string"))
    assert json.loads(remotes.lock_file(lock)) == {"remotes": {"AB": {"DP-001": "DP-1.md"}, "UP": {"ADR-007": "ADR-007-a.md"}}}
    assert list(json.loads(remotes.lock_file(lock))["remotes"]) == ["AB", "UP"]
    assert remotes.lock_lines(lock).where("remote = 'AB'").first().line == '"DP-001": "DP-1.md"'


def test_pages_are_written_in_order(spark, tmp_path):
    rows = [("a/x.md", 1, n, f"C-{n:03d}", f"line {n}") for n in range(50)] + [("a/x.md", 0, 0, "", "# x"), ("y.md", 0, 0, "", "# y")]
    frame = spark.createDataFrame(rows, "path string, block int, number int, code string, line string").repartition(5)
    pages.write(pages.outputs([frame]), str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).select("view", "value", F.input_file_name().alias("f")).collect()
    files = sorted({unquote(r.f) for r in back if r.view == "a/x.md"})
    lines = [x for f in files for x in spark.read.text(f).toPandas()["value"]]
    assert lines == ["# x", *(f"line {n}" for n in range(50))] and [r.value for r in back if r.view == "y.md"] == ["# y"]


def test_vocabulary_keeps_the_order_of_its_file(spark):
    got = pages.vocabulary(spark, "ADR", "Zeta: {label: z}\nAlpha:\n", "status").collect()
    assert [(r.status, r.label, r.ordinal) for r in got] == [("Zeta", "z", 0), ("Alpha", None, 1)]


def test_exit_code(spark):
    none = spark.createDataFrame([], "check string, path string, message string")
    found = spark.createDataFrame([("a", "m", False)], "class string, message string, fails boolean")
    assert (reports.exit_code(none, found), reports.exit_code(none, found.withColumn("fails", F.lit(True)))) == (0, 1)


def test_functions_in_sql(spark):
    assert register(spark, ("ADR",)) == ["references_of", "yaml_to_json"]
    row = spark.sql("SELECT references_of('see ADR-7 and `ADR-8`') AS r, yaml_to_json('a: [1, 2]') AS j, yaml_to_json(': [') AS bad").first()
    assert [(x.kind, x.num) for x in row.r] == [("scheme", 7)] and json.loads(row.j) == {"a": [1, 2]} and row.bad is None
