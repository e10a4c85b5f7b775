"""Paths and link targets as Column expressions: relative paths, moved links, slugs of headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Where an inline link's target starts and ends.
_TARGET = r"(?<=\]\()[^)\s]+"


def _parts(path: Column) -> Column:
    return F.filter(F.split(T.normalize_path(path), "/"), lambda p: (p != "") & (p != "."))


def parent(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative(target: Column, base: Column) -> Column:
    """``target`` as written from the folder ``base``; both are relative to the same root."""
    t, b = _parts(target), _parts(base)
    differs = F.array_position(F.transform(b, lambda x, i: ~x.eqNullSafe(F.get(t, i))), True)
    shared = F.when(differs == 0, F.size(b)).otherwise(differs.cast("int") - 1)
    steps = F.concat(F.array_repeat(F.lit(".."), F.size(b) - shared), F.slice(t, shared + 1, F.size(t)))
    return F.when(F.size(steps) == 0, F.lit(".")).otherwise(F.array_join(steps, "/"))


def is_relative(target: Column) -> Column:
    """Neither an anchor nor rooted nor a URL."""
    return ~target.rlike(r"^(?:[#/]|[A-Za-z][A-Za-z0-9+.-]*:)")


def rebase(text: Column, prefix: Column) -> Column:
    """``text`` with its relative link targets as seen from where ``prefix`` leads back; fragments stay."""
    marks = F.regexp_extract_all(text, F.lit(_TARGET), F.lit(0))

    def moved(m: Column) -> Column:
        path, rest = F.regexp_extract(m, r"^([^#]*)(.*)$", 1), F.regexp_extract(m, r"^([^#]*)(.*)$", 2)
        return F.when(is_relative(m), F.concat(T.normalize_path(F.concat(prefix, path)), rest)).otherwise(m)

    gaps = F.split(text, _TARGET)
    joined = F.zip_with(gaps, F.concat(F.transform(marks, moved), F.array(F.lit(""))), lambda g, m: F.concat(g, m))
    return F.when((prefix == "") | (F.size(marks) == 0), text).otherwise(F.array_join(joined, ""))


def title_words(c: Column) -> Column:
    """Every run of letters with a capital, also after ``-`` and ``_``."""
    words = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def after_title(body: Column, line: Column) -> Column:
    """``line`` under the first heading of level one, or on top where there is none."""
    heading = r"(?m)^# .+$"
    at = F.regexp_instr(body, F.lit(heading))
    end = at + F.length(F.regexp_extract(body, heading, 0))
    under = F.concat(F.substring(body, F.lit(1), end - 1), F.lit("\n\n"), line, F.substring(body, end, F.length(body)))
    return F.when(F.coalesce(line, F.lit("")) == "", body).when(at == 0, F.concat(line, F.lit("\n\n"), body)).otherwise(under)


def staged(path: Column) -> Column:
    """Where a page lands on the site: the front page is its index."""
    return F.when(path == "README.md", F.lit("index.md")).otherwise(path)


def anchor_tail(code: Column) -> Column:
    """A code's tail inside an anchor: numbers lose their padding, tails without a number stay."""
    tail = T.code_tail(code)
    return F.when(T.is_temp_tail(tail), tail).otherwise(tail.cast("bigint").cast("string"))


def minted_tail(seed: Column, attempt: Column | int = 0) -> Column:
    """A temporary tail that depends on ``seed`` alone: ``tmp`` and five digits of base 36."""
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
    value = F.pmod(F.xxhash64(seed, attempt), F.lit(36**5))
    return F.concat(F.lit("tmp"), F.lpad(F.lower(F.conv(value.cast("string"), 10, 36)), 5, "0"))


def describe(kind: Column, prefix: Column, num: Column, tail: Column, text: Column) -> Column:
    """A reference as a message names it."""
    by_tail = F.concat_ws("-", prefix, tail)
    scheme = F.when(F.coalesce(tail, F.lit("")) != "", by_tail).otherwise(T.code(prefix, num))
    return F.when(kind == "scheme", scheme).when(kind == "remote", F.coalesce(F.nullif(text, F.lit("")), by_tail)).otherwise(F.concat(F.lit("#"), num.cast("string")))


def set_field(text: Column, field: str, value: Column) -> Column:
    """The first ``field`` of a frontmatter, with its continuation lines, given ``value`` (a YAML text)."""
    old = F.regexp_extract(text, rf"(?m)^{field}:.*(?:\n(?:  |- ).*)*", 0)
    at = F.instr(text, old)
    made = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(f"{field}: "), value, F.substring(text, at + F.length(old), F.length(text)))
    return F.when(old == "", text).otherwise(made)


def unlinked(text: Column) -> Column:
    """Links as their labels."""
    return F.regexp_replace(text, r"\[([^\]]+)\]\([^)\s]*\)", "$1")


def issue_site(issue_url: Column) -> Column:
    """(title, base_url, source_url) that an issue URL of a known host implies; null elsewhere."""
    shape = r"^https?://github\.com/([^/]+)/([^/]+)/issues\b"
    owner, repo = F.regexp_extract(issue_url, shape, 1), F.regexp_extract(issue_url, shape, 2)
    made = F.struct(repo.alias("title"), F.concat(F.lower(owner), F.lit(".github.io/"), repo).alias("base_url"), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/blob/HEAD")).alias("source_url"))
    return F.when(issue_url.rlike(shape), made)
