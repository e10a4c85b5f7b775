"""Scalar functions over codes, statuses, titles and dates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tail of a code that has no number yet, and the dash before a status note.
TEMP_TAIL, NOTE = r"^tmp[a-z0-9]{5}$", r"\s+—\s+"
#: Calendar formats of a journal's books and their labels.
BOOK_KEY = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}
BOOK_LABEL = {"year": "yyyy", "month": "MMMM yyyy", "day": "d MMMM yyyy"}


def code(prefix: Column, number: Column) -> Column:
    """ADR-007; numbers of four digits keep them."""
    return F.concat(prefix, F.lit("-"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


def canonical(text: Column) -> Column:
    """A code in any case, with a dash or a space, in its canonical spelling; other text as it is."""
    part = lambda i: F.regexp_extract(text, r"^([A-Za-z]{1,10})[- ](\d{1,9})$", i)
    return F.when(part(2) == "", text).otherwise(code(F.upper(part(1)), part(2).cast("int")))


def code_prefix(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)-[^-]*$", 1)


def code_tail(c: Column) -> Column:
    return F.substring_index(c, "-", -1)


def is_temp_tail(c: Column) -> Column:
    return c.rlike(TEMP_TAIL)


def status_word(status: Column) -> Column:
    return F.split(status, NOTE, 2)[0]


def escape_cell(c: Column) -> Column:
    """Pipes escaped for a table cell; those already escaped stay."""
    return F.regexp_replace(c, r"\\?\|", r"\\|")


def heading_slug(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(c), "[^a-z0-9 -]", ""), " ", "-")


def anchor(prefix: Column, number: Column) -> Column:
    return F.concat(F.lower(prefix), F.lit("-"), number.cast("string"))


def sentence_case(c: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def age_days(date: Column, as_of: Column) -> Column:
    return F.datediff(as_of, date)


def is_stale(date: Column, as_of: Column, days: int) -> Column:
    """At least ``days`` old; what has no date is not stale."""
    return F.coalesce(age_days(date, as_of) >= days, F.lit(False))


def book_key(created: Column, granularity: str) -> Column:
    return F.date_format(created, BOOK_KEY[granularity])


def book_label(created: Column, granularity: str) -> Column:
    return F.date_format(created, BOOK_LABEL[granularity])


def journal_path(created: Column) -> Column:
    return F.concat(F.date_format(created, "yyyy/MM/dd/HHmmss"), F.lit(".md"))


def created_from_path(path: Column) -> Column:
    digits = F.regexp_replace(F.regexp_extract(path, r"(\d{4}/\d{2}/\d{2}/\d{6})\.md$", 1), "/", "")
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss"))


def entry_anchor(created: Column) -> Column:
    return F.date_format(created, "yyyyMMddHHmmss")


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one + "s")))


def is_stub(body: Column) -> Column:
    """Nothing but comments and white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"\s+", " ")) == ""


def local_path(target: Column) -> Column:
    """The path a link target names on disk, or null for URLs, anchors, rooted paths and patterns."""
    plain = F.split(F.split(target, "#", 2)[0], r"\?", 2)[0]
    path = F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))
    foreign = target.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|/|#)") | target.rlike(r"[{}\\|()\[\]*?<>]")
    return F.when(foreign | (plain == ""), F.lit(None).cast("string")).otherwise(path)


def normalize_path(path: Column) -> Column:
    """``a/./b/../c`` as ``a/c``: a fold over the parts, without touching a file system."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when(
        (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    ).otherwise(F.concat(acc, F.array(p)))
    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(out == "", F.lit(".")).otherwise(out)


def narrow_pattern(terms: list[str]) -> str:
    """One pattern for terms in either number, longest first."""
    import re

    stems = sorted({t.lower().rstrip("s") for t in terms}, key=lambda t: (-len(t), t))
    return r"(?i)\b(" + "|".join(map(re.escape, stems)) + r")s?\b"


def legend_label(c: Column) -> Column:
    return sentence_case(c)


def badge_url(label: str, value: Column) -> Column:
    color = F.when(value == 0, F.lit("brightgreen")).otherwise(F.lit("orange"))
    return F.concat(F.lit(f"https://img.shields.io/badge/{label}-"), value.cast("string"), F.lit("-"), color)
