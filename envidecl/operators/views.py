"""Flat views for people, and records of older schemas brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import tables as D
from ..functions.dates import resolve_validity
from ..functions.units import parse_declared_unit


def checklist(step1: DataFrame) -> DataFrame:
    """epd_uid, ord, parameter, requirement, status: one row for each parameter of the checklist."""
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(p).alias("parameter"), F.lit(r).alias("requirement"), F.col(p).alias("status")) for k, (p, r) in enumerate(D.PARAMETERS)])
    return step1.select("epd_uid", F.inline(rows))


def evidence(facts: DataFrame) -> DataFrame:
    """Where every value comes from, in total order."""
    return facts.select("epd_uid", "indicator", "module", "scenario", "raw_value", "raw_unit", "source_page", "source_table", "extraction_method", "confidence").orderBy("epd_uid", "indicator", "module", "scenario")


def categories(spark) -> DataFrame:
    rows = [(k, c, parent, ", ".join(strong), ", ".join(weak)) for k, (c, parent, strong, weak, _, _) in enumerate(D.CATEGORIES)]
    return spark.createDataFrame(rows, "ord int, category string, parent string, strong string, weak string")


def operators(spark) -> DataFrame:
    rows = [(k, i, n, c, ", ".join(a)) for k, (i, n, c, a, _) in enumerate(D.OPERATORS)]
    return spark.createDataFrame(rows, "ord int, operator_id string, name string, country string, aliases string")


def page_metrics(facts: DataFrame) -> DataFrame:
    """Values, indicators and pages of each declaration."""
    return facts.groupBy("epd_uid").agg(F.count("value").alias("n_values"), F.count_distinct("indicator").alias("n_indicators"), F.count_distinct("source_page").alias("n_pages"))


def migrate(records: DataFrame, version: str = "2.0") -> DataFrame:
    """Older records (schema_version, metadata columns) get what they lack; nothing that is there changes."""
    old = F.coalesce("schema_version", F.lit("1.0"))
    dates, unit = resolve_validity(F.col("publication_date"), F.col("valid_until")), parse_declared_unit(F.col("declared_unit_raw"))
    keep = lambda name, value: F.coalesce(F.col(name), value).alias(name) if name in records.columns else value.alias(name)
    new = {
        "publication_date_iso": dates["published"].cast("string"), "valid_until_iso": dates["valid"].cast("string"), "declared_quantity": unit["quantity"], "declared_unit": unit["unit"],
        "declared_unit_dimension": unit["dimension"], "source_format": F.when(F.endswith(F.lower("source_file"), F.lit(".pdf")), "pdf").otherwise("unknown"),
    }
    rest = [F.col(c) for c in records.columns if c not in (*new, "schema_version")]
    return records.select(*rest, *[keep(k, v) for k, v in new.items()], F.when(old != version, old).alias("migrated_from_schema"), F.lit(version).alias("schema_version"))
