"""Text columns: normalising, cleaning, slugs, identifiers and hashes. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import tables as D

_FROM = D.DASHES + "".join(D.SUBSCRIPTS) + D.HARD_SPACES + "".join(D.QUOTES) + D.SOFT_HYPHEN
_TO = "-" * len(D.DASHES) + "".join(D.SUBSCRIPTS.values()) + " " * len(D.HARD_SPACES) + "".join(D.QUOTES.values())


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used; keeps generated code small."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def normalize_text(value: Column) -> Column:
    """For matching only: dashes, digits, blanks and quotes made plain, lower case, single blanks; null is empty."""
    plain = F.lower(F.translate(F.coalesce(value.cast("string"), F.lit("")), _FROM, _TO))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def clean_cell(value: Column) -> Column:
    """One line without surrounding or repeated white space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)\s+", " "))


def clean_lines(value: Column) -> Column:
    """Array of the lines that are not blank, each cleaned."""
    lines = F.transform(F.split(F.coalesce(value, F.lit("")), r"\R"), clean_cell)
    return F.filter(lines, lambda x: x != "")


def slug(value: Column) -> Column:
    """Signs other than letters, digits, dot, underscore and hyphen become one hyphen; 80 signs at most."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9._\-]+", "-"), "-{2,}", "-")
    return F.left(F.btrim(one, F.lit("-.")), F.lit(80))


def record_uid(registration: Column, uuid: Column, file_sha: Column, canonical: Column) -> Column:
    """Registration number with a digit, else dataset UUID, else file hash, else hash of the record."""
    own = slug(F.upper(F.trim(registration)))
    return F.coalesce(
        F.when(own.rlike(r"\d"), own),
        F.when(F.length(uuid) > 0, F.concat(F.lit("ilcd-"), F.lower(uuid))),
        F.when(F.length(file_sha) > 0, F.concat(F.lit("sha-"), F.left(file_sha, F.lit(20)))),
        F.concat(F.lit("rec-"), F.left(F.sha2(canonical, 256), F.lit(20))),
    )


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the named columns as JSON with nulls kept; map entries come sorted by key."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def sorted_map(value: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def contains_all(text: Column, tokens: list[str]) -> Column:
    """Every token occurs; ``%`` and ``_`` in a token stay wildcards, as they were typed."""
    out = F.lit(True)
    for token in tokens:
        out = out & text.like("%" + token.lower().replace("\\", "\\\\") + "%")
    return out


def any_of(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def first_listed(text: Column, terms: list[str]) -> Column:
    """The first term of the list that the text holds, or null."""
    return F.get(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)), F.lit(0))


def earliest(text: Column, terms: list[str]) -> Column:
    """Struct of place (from 1) and term of the earliest hit, ties in the order of the list; null without one."""
    hits = F.array(
        *[F.struct(F.instr(text, F.lit(t)).alias("at"), F.lit(k).alias("ord"), F.lit(t).alias("term")) for k, t in enumerate(terms)]
    )
    return F.array_min(F.filter(hits, lambda h: h["at"] > 0))


def sentence_around(text: Column, at: Column, size: Column, limit: int = 320) -> Column:
    """The sentence that holds a place: from after the last full stop or blank line to the next, both ends within the limit."""
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at + size, F.length(text))
    head = F.regexp_extract(before, r"(?s)([^.]*?)$", 1)
    head = F.regexp_replace(head, r"(?s)^.*\n\s*\n", "")
    tail = F.regexp_extract(after, r"(?s)^(.*?(?:\.|\n\s*\n|$))", 1)
    whole = clean_cell(F.concat(head, F.substring(text, at, size), tail))
    shift = F.greatest(F.lit(1), F.length(head) + size / 2 - F.lit(limit // 2))
    return F.when(F.length(whole) <= limit, whole).otherwise(F.substring(whole, shift.cast("int"), F.lit(limit)))


def find_page(pages: Column, needle: Column) -> Column:
    """Number of the first page that holds the first 80 signs of the needle, normalised."""
    wanted = F.left(normalize_text(needle), F.lit(80))
    hits = F.filter(pages, lambda p: (wanted != "") & F.contains(normalize_text(p["text"]), wanted))
    return F.get(hits, F.lit(0))["page_number"]


def evidence(page: Column, text: Column, method: Column, confidence: Column) -> Column:
    return F.struct(
        page.alias("source_page"), F.left(text, F.lit(500)).alias("source_text"), method.alias("extraction_method"), F.bround(confidence, 3).alias("confidence")
    )
