"""Dates as declarations print them, with what is known of their precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import tables as D
from .text import let, normalize_text

_WORD = "([a-zæøåäöü]+)"


def _date(year: Column, month: Column, day: Column) -> Column:
    """null where there is no such day."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return text.try_cast("date")


def _month(name: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in D.MONTHS.items() for x in pair])
    return F.try_element_at(names, name)


def _parts(text: Column, pattern: str, n: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in range(1, n + 1)]


def parse_date(raw: Column) -> Column:
    """struct(iso date, format, ambiguous, precision) or null; numeric dates are day first unless a part is over 12."""
    return let(normalize_text(raw), _parsed)


def _parsed(low: Column) -> Column:
    y, m, d = _parts(low, r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b", 3)
    ymd = _date(y, m, d)
    a, b, c = (x.cast("int") for x in _parts(low, r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})\b", 3))
    year = F.when(c < 100, c + 2000).otherwise(c)
    american = (b > 12) & (a <= 12)
    numeric = F.when(american, _date(year, a, b)).otherwise(_date(year, b, a))
    unsure = (a <= 12) & (b <= 12) & (a != b)
    d1, m1, y1 = _parts(low, rf"\b(\d{{1,2}})\.?\s+{_WORD}\.?,?\s+(\d{{4}})\b", 3)
    day_first = _date(y1, _month(m1), d1)
    m2, d2, y2 = _parts(low, rf"\b{_WORD}\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b", 3)
    month_first = _date(y2, _month(m2), d2)
    m3, y3 = _parts(low, rf"\b{_WORD}\.?\s+(\d{{4}})\b", 2)
    month_only = _date(y3, _month(m3), F.lit(1))
    y4 = F.nullif(F.regexp_extract(low, r"^((?:19|20)\d{2})$", 1), F.lit(""))
    year_only = _date(y4, F.lit(1), F.lit(1))

    def found(value: Column, name: Column | str, ambiguous: Column | None = None, precision: str = "day") -> Column:
        return F.when(
            value.isNotNull(),
            F.struct(
                value.alias("iso"),
                (F.lit(name) if isinstance(name, str) else name).alias("format"),
                F.coalesce(ambiguous, F.lit(False)).alias("ambiguous") if ambiguous is not None else F.lit(False).alias("ambiguous"),
                F.lit(precision).alias("precision"),
            ),
        )

    return F.coalesce(
        found(ymd, "yyyy-mm-dd"),
        found(numeric, F.when(american, "mm/dd/yyyy").otherwise("dd/mm/yyyy"), unsure),
        found(day_first, "d month yyyy"),
        found(month_first, "month d yyyy"),
        found(month_only, "month yyyy", precision="month"),
        found(year_only, "yyyy", precision="year"),
    )


def _swapped(value: Column) -> Column:
    return F.coalesce(_date(F.year(value), F.dayofmonth(value), F.month(value)), value)


def resolve_validity(published: Column, valid: Column) -> Column:
    """struct(published, valid): two unsure dates are both swapped if that is nearer to five years by over 0.05."""
    both = F.struct(parse_date(published).alias("p"), parse_date(valid).alias("v"))
    return let(both, lambda x: _resolved(x["p"], x["v"]))


def _resolved(p: Column, v: Column) -> Column:
    off = lambda a, b: F.abs(F.datediff(b, a) / 365.25 - 5)
    p2, v2 = _swapped(p["iso"]), _swapped(v["iso"])
    swap = F.coalesce(p["ambiguous"] & v["ambiguous"] & (off(p2, v2) + 0.05 < off(p["iso"], v["iso"])), F.lit(False))
    return F.struct(F.when(swap, p2).otherwise(p["iso"]).alias("published"), F.when(swap, v2).otherwise(v["iso"]).alias("valid"))


def validity(valid_until: Column, as_of: Column) -> Column:
    """struct(valid_today, days_remaining); both null without a date."""
    left = F.datediff(valid_until, as_of)
    return F.struct((left >= 0).alias("valid_today"), left.alias("days_remaining"))
