"""Numbers as declarations print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: What may be cast at last; Spark's own cast would also take ``1d`` or ``NaN``.
NUMBER = r"^[+\-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[Ee][+\-]?\d+)?$"


def parse_number(raw: Column) -> Column:
    """double or null: decimal comma or point, exponents with blanks, thousands blanks, footnote marks."""
    t = F.translate(F.trim(raw.cast("string")), "−‐–   ", "---   ")
    t = F.trim(F.regexp_replace(t, r"(?<=\d)[*¹²³⁴⁵⁶⁷⁸⁹⁰†‡]+$|(?<=\d)\s*\d\)$", ""))
    t = F.regexp_replace(t, r"\s+(?=[Ee][+\-]?\d+$)", "")
    t = F.regexp_replace(t, r"(?<=[Ee])\s+(?=[+\-]?\d+$)", "")
    t = F.regexp_replace(t, r"(?<=\d) (?=\d{3}(?:\D|$))", "")
    # Each step is used several times, so each is worked out once.
    return let(let(t, lambda t: F.struct(F.regexp_extract(t, r"([Ee][+\-]?\d+)$", 1).alias("e"), F.regexp_replace(t, r"[Ee][+\-]?\d+$", "").alias("m"))), _number)


def _number(parts: Column) -> Column:
    exponent, m = parts["e"], parts["m"]
    comma, point = F.contains(m, F.lit(",")), F.contains(m, F.lit("."))
    last = lambda sign: F.instr(F.reverse(m), sign)
    mantissa = (
        F.when(comma & point & (last(",") < last(".")), F.replace(F.replace(m, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & point, F.replace(m, F.lit(","), F.lit("")))
        .when(comma & (F.length(m) - F.length(F.replace(m, F.lit(","), F.lit(""))) > 1), F.lit(None).cast("string"))
        .when(comma, F.replace(m, F.lit(","), F.lit(".")))
        .otherwise(m)
    )
    return let(F.concat(mantissa, exponent), lambda whole: F.when(whole.rlike(NUMBER), whole.try_cast("double")))


def same_number(a: Column, b: Column) -> Column:
    """Both null, or close: within 1e-9 of the larger, or 1e-12."""
    near = F.abs(a - b) <= F.greatest(F.lit(1e-12), F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(near, a.isNull() & b.isNull())


def number_text(value: Column) -> Column:
    """Four significant digits without zeros at the end, powers of ten from 1e4 and below 1e-4; null is empty."""
    digits = F.format_string("%.3e", value)
    power = F.regexp_extract(digits, r"e([+-]\d+)$", 1).cast("int")
    plain = F.regexp_replace(digits.cast("decimal(30,10)").cast("string"), r"\.?0+$", "")
    far = F.regexp_replace(digits, r"\.?0*e", "e")
    return F.coalesce(F.when(value == 0, "0").when(power.between(-4, 3), plain).otherwise(far), F.lit(""))


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / F.lit(size))).cast("long")
