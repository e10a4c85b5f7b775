"""The declared catalog of a record: document schemes, journals, fragments, remotes.

A catalog is small and lives on the driver; its families become one-row-a-member
frames for joins. Settings merge per key with the defaults, a declared family
replaces its default whole.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

RULES = ("any", "at-most-one", "exactly-one")
#: The closed status vocabulary, and what counts as undecided.
STATUSES = ("Active", "Proposed", "Deferred", "Superseded", "Rejected")
UNDECIDED = ("Proposed", "Deferred")
#: The finding classes that may be promoted to violations.
FINDINGS = ("retired-citations", "unresolved-codes", "unlinted-files", "hand-written-urls", "broken-targets", "inert-status", "legacy-spellings", "narrow-titles", "stale-directives", "pending-documents")


@dataclass(frozen=True)
class TagGroup:
    name: str
    tags: tuple[str, ...]
    require: str = "any"
    excluded_by: tuple[str, ...] = ()

    def __post_init__(self):
        if self.require not in RULES:
            raise ValueError(f"tag group {self.name}: unknown rule {self.require!r}; one of {', '.join(RULES)}")
        if not self.tags:
            raise ValueError(f"tag group {self.name} names no tags")


@dataclass(frozen=True)
class Scheme:
    prefix: str
    dir: str = ""
    active: str = "Active"
    render: str = "index"
    output: str = ""
    allocate: str = "filing"
    titles_generalize: bool = False
    requires: tuple[str, ...] = ()
    tag_groups: tuple[TagGroup, ...] = ()


@dataclass(frozen=True)
class Journal:
    name: str
    dir: str = ""
    output: str = ""
    granularity: str = "month"


@dataclass(frozen=True)
class Fragment:
    name: str
    target: str
    style: str = "append"


@dataclass(frozen=True)
class Remote:
    prefix: str
    name: str = ""
    repo: str = ""
    ref: str = "main"
    dir: str = ""
    url: str = ""
    delim: str = "-"
    uid: str = ""


@dataclass(frozen=True)
class Catalog:
    issue_url: str = ""
    stale_days: int = 90
    fail_on: tuple[str, ...] = ()
    narrow_terms: tuple[str, ...] = ()
    historical: tuple[str, ...] = ()
    code_globs: tuple[str, ...] = ()
    schemes: tuple[Scheme, ...] = (Scheme("ADR", "docs/decisions"),)
    journals: tuple[Journal, ...] = ()
    fragments: tuple[Fragment, ...] = ()
    remotes: tuple[Remote, ...] = field(default=())

    def __post_init__(self):
        unknown = [f for f in self.fail_on if f not in FINDINGS]
        if unknown:
            raise ValueError(f"unknown finding classes in fail_on: {', '.join(sorted(unknown))}")

    def remote_order(self) -> list[Remote]:
        """Longer prefixes claim their text first."""
        return sorted(self.remotes, key=lambda r: (-len(r.prefix), r.prefix))


def _member(kind: type, key: str, first: str, table: object) -> object:
    values = {"target": table} if isinstance(table, str) else dict(table)  # a fragment may be a bare target
    known = {f.name for f in fields(kind)}
    if kind is Scheme:
        values["tag_groups"] = tuple(
            TagGroup(name, tuple(g.get("tags", ())), g.get("require", "any"), tuple(g.get("excluded_by", ()))) for name, g in values.get("tag_groups", {}).items()
        )
    return kind(**{first: key}, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known and k != first})


def load(text: str, section: str = "record") -> Catalog:
    """A catalog from TOML: settings and families under ``[section]``."""
    raw = tomllib.loads(text).get(section, {})
    given: dict[str, object] = {}
    for name, kind, first in (("schemes", Scheme, "prefix"), ("journals", Journal, "name"), ("fragments", Fragment, "name"), ("remotes", Remote, "prefix")):
        if name in raw:
            given[name] = tuple(_member(kind, k, first, v) for k, v in raw[name].items())
    for f in fields(Catalog):
        if f.name in raw and f.name not in given:
            given[f.name] = tuple(raw[f.name]) if isinstance(raw[f.name], list) else raw[f.name]
    return Catalog(**given)


def kinds(c: Catalog) -> list[tuple[str, str]]:
    """What can be filed: (kind, family) of every scheme, fragment and journal, and a migration."""
    return [*((s.prefix.lower(), "scheme") for s in c.schemes), *((f.name, "fragment") for f in c.fragments), *((j.name, "journal") for j in c.journals), ("migration", "migration")]


def remotes_frame(spark: SparkSession, c: Catalog) -> DataFrame:
    rows = [(r.prefix, r.name, r.repo, r.ref, r.dir, r.url, r.delim, r.uid) for r in c.remotes]
    return spark.createDataFrame(rows, "prefix string, name string, repo string, ref string, dir string, url string, delim string, uid string")


def schemes_frame(spark: SparkSession, c: Catalog) -> DataFrame:
    rows = [(s.prefix, s.dir, s.active, s.render, s.output, s.allocate, s.titles_generalize, list(s.requires)) for s in c.schemes]
    return spark.createDataFrame(rows, "scheme string, dir string, active string, render string, output string, allocate string, titles_generalize boolean, requires array<string>")
