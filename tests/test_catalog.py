import pytest

from recordweave import catalog

TOML = """
[record]
issue_url = "https://example.test/issues/{n}"
fail_on = ["retired-citations"]
[record.schemes.ADR]
dir = "record/decisions.d"
requires = ["owner"]
[record.schemes.ARG]
dir = "record/args.d"
[record.schemes.ARG.tag_groups.strength]
tags = ["sound", "invalid"]
require = "exactly-one"
[record.fragments]
"inbox.d" = "CHANGELOG.md"
[record.remotes.UP]
repo = "o/r"
[record.remotes.UPX]
url = "https://t.test/{code}"
"""


def test_load_replaces_families_and_keeps_other_defaults():
    c = catalog.load(TOML)
    assert [s.prefix for s in c.schemes] == ["ADR", "ARG"] and c.stale_days == 90 and c.fail_on == ("retired-citations",)
    assert c.schemes[1].tag_groups[0].require == "exactly-one" and c.fragments[0].target == "CHANGELOG.md"
    assert [r.prefix for r in c.remote_order()] == ["UPX", "UP"]
    assert ("adr", "scheme") in catalog.kinds(c) and catalog.load("").schemes[0].prefix == "ADR"


def test_bad_catalogs_are_refused():
    with pytest.raises(ValueError):
        catalog.TagGroup("g", ("a",), "sometimes")
    with pytest.raises(ValueError):
        catalog.TagGroup("g", ())
    with pytest.raises(ValueError):
        catalog.load('[record]\nfail_on = ["no-such-class"]')


def test_frames(spark):
    c = catalog.load(TOML)
    assert {r.prefix for r in catalog.remotes_frame(spark, c).collect()} == {"UP", "UPX"}
    assert catalog.schemes_frame(spark, c).where("scheme = 'ADR'").first().requires == ["owner"]
