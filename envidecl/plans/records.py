"""Whole records from pages to checklists over the driver's parts: assembly, sections, checks, validation and edits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble, rules
from ..session import kept, shared_folder
from ..sources import sections
from .datasets import _documents, _page, _table, _text, _word
from .driver import register, t

_NUMBER = "'MD-' || lpad(p_partkey::VARCHAR, 5, '0') || '-EN'"


def _number() -> Column:
    return F.concat(F.lit("MD-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("-EN"))


def declarations(spark: SparkSession, d: str) -> DataFrame:
    """A document for every part: a cover with labels, a section, wordings that depend on the size, and a table of results."""
    life = F.when(F.col("p_size") > 25, F.concat(F.lit("Reference service life: "), F.col("p_size").cast("string"), F.lit(" years."))).otherwise("Reference service life is not declared.")
    text = F.concat_ws(
        "\n", F.lit("EN 15804+A2 and ISO 14025"), life, F.lit("The declared unit is 2 m2 of product."), F.when(F.col("p_size") % 2 == 0, "Independent external verifier").otherwise("nobody"),
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Area weight "), F.col("p_size") * 100, F.lit(" g/m2"))), F.lit("Product description"), F.concat(F.lit("The "), "p_name", F.lit(" is a panel for inner walls and ceilings.")), F.lit("Application"), F.lit("never read"),
    )
    labels = [["Declaration number", _number()], ["Manufacturer", F.col("p_brand")], ["Product name", F.concat(F.lit("Part "), "p_name")], ["Issue date", "2020-01-31"], ["Valid until", F.concat((F.col("p_size") + 2000).cast("string"), F.lit("-06-30"))], ["Programme operator", F.when(F.col("p_size") % 3 == 0, "EPD Danmark").otherwise("Nobody at all")]]
    parts = F.when(F.col("p_size") % 4 == 0, F.col("p_size") + 10.0).otherwise(F.col("p_size") + 0.5)
    results = [["Indicator", "Unit", "A1", "A2", "A3", "A1-A3", "C3", "D"], ["GWP-total", "kg CO2 eq", F.col("p_size"), "0.25", "0.25", parts, "MND", "-1.25"], ["ODP", "kg CFC 11 eq", "1E-7", "0", "0", "1E-7", "ND", "ND"]]
    return _documents(t(spark, d, "part"), "p_partkey", [_page(1, text, [], [_table(labels)]), _page(2, "Results", [], [_table(results)])])


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A record for every part; numbers of parts from 100,000 on are cut, so several documents may have one."""
    return assemble.from_documents(declarations(spark, d))[0]


def _numbered(found: DataFrame, records: DataFrame) -> DataFrame:
    """What was derived of records under their documents' ids, with the numbers that they have."""
    return records.select(F.col("epd_uid").alias("_uid"), F.col("doc_id").alias("epd_uid")).join(found, "epd_uid").drop("epd_uid").withColumnRenamed("_uid", "epd_uid")


@register(
    f"SELECT {_NUMBER} AS epd_uid, 'Part ' || p_name AS product_name, p_brand AS manufacturer, 'EN 15804+A2' AS standard, (p_size + 2000) || '-06-30' AS valid_until, 'English' AS language, "
    "'The ' || p_name || ' is a panel for inner walls and ceilings.' AS product_description, CASE WHEN p_size % 5 = 0 THEN round_even(p_size * 0.2, 6) END::DOUBLE AS mass_per_declared_unit_kg, "
    "CASE WHEN p_size % 5 = 0 THEN round_even(2 / (p_size * 0.2), 8) END::DOUBLE AS conversion_factor_to_1kg, 12 AS n_values, 6 AS n_declared FROM part"
)
def assembled_records(spark: SparkSession, d: str) -> DataFrame:
    md = ("product_name", "manufacturer", "standard", "valid_until", "language", "product_description", "mass_per_declared_unit_kg", "conversion_factor_to_1kg")
    slots = F.aggregate(F.map_values("results"), F.lit(0), lambda n, r: n + F.size(r["modules"]))
    declared = F.size(F.map_keys(F.map_from_entries(F.filter(F.map_entries("results"), lambda e: e["key"] == "GWP-total")))) * 6
    return _records(spark, d).select("epd_uid", *[F.col(f"metadata.{c}").alias(c) for c in md], slots.alias("n_values"), declared.alias("n_declared"))


_VERIFIED = "CASE WHEN p_size % 2 = 0 THEN 'pass' ELSE 'warning' END"


@register(
    f"SELECT {_NUMBER} AS epd_uid, 'pass' AS core_standard, {_VERIFIED} AS third_party_verification, 'pass' AS programme_operator, "
    "CASE WHEN p_size > 25 THEN 'pass' ELSE 'warning' END AS reference_service_life, CASE WHEN p_size % 5 = 0 THEN 'pass' ELSE 'missing' END AS unit_conversion_factor, 'warning' AS life_cycle_modules, 'missing' AS worst, true AS mandatory_ok, "
    "'' AS errors, array_to_string(list_filter([CASE WHEN p_size % 4 = 0 AND 9.5 > 0.05 * (p_size + 10) THEN 'a1_a3_sum' END, CASE WHEN p_size + 2000 < 2026 THEN 'expired' END], lambda x: x IS NOT NULL), ',') AS warnings FROM part"
)
def assembled_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checklist and the validation of assembled records, as of a fixed day."""
    whole = _records(spark, d)
    records = assemble.apart(whole)
    derived = assemble.derive(records)
    found = rules.validate(records, derived.facts, derived.classified, F.lit("2026-01-01").cast("date"))
    warnings = F.array_join(F.filter("warnings", lambda w: w != "category_uncertain"), ",")
    told = found.select("epd_uid", F.array_join("errors", ",").alias("errors"), warnings.alias("warnings"))
    parameters = ("core_standard", "third_party_verification", "programme_operator", "reference_service_life", "unit_conversion_factor", "life_cycle_modules", "worst", "mandatory_ok")
    return _numbered(derived.step1.select("epd_uid", *parameters).join(told, "epd_uid"), whole)


@register(
    f"SELECT {_NUMBER} AS epd_uid, CASE WHEN p_size < 10 THEN 'Reviewed A/S' ELSE p_brand END AS manufacturer, CASE WHEN p_size < 10 THEN 40.0 WHEN p_size > 25 THEN p_size END::DOUBLE AS rsl_years, CASE WHEN p_size < 10 OR p_size > 25 THEN 'pass' ELSE 'warning' END AS reference_service_life, "
    "CASE WHEN p_size < 10 THEN 'manufacturer: ' || p_brand || '; reference_service_life_years: null' END AS log, p_size < 10 AS found FROM part"
)
def assembled_edits(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers' edits, their log, and what is derived anew from edited records: summary, checklist and search."""
    whole = _records(spark, d)
    records = assemble.apart(whole)
    some = records.join(t(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").cast("string").alias("epd_uid")), "epd_uid", "left_semi")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in (("manufacturer", "Reviewed A/S"), ("reference_service_life_years", "40"), ("standard", "EN 15804+A2"))])
    edited, log = assemble.edit_fields(records, some.select("epd_uid", F.inline(fields)))
    after = assemble.derive(kept(edited))
    entry = F.concat("field", F.lit(": "), F.coalesce("original", F.lit("null")))
    lines = log.groupBy("epd_uid").agg(F.array_join(F.array_sort(F.collect_list(entry)), "; ").alias("log"))
    rows = after.summary.select("epd_uid", "manufacturer", "rsl_years", F.contains("search_text", F.lit("reviewed a/s")).alias("found"))
    return _numbered(rows.join(after.step1.select("epd_uid", "reference_service_life"), "epd_uid").join(lines, "epd_uid", "left"), whole)


@register("SELECT p_partkey::VARCHAR AS doc_id, 2 AS page, 'The ' || p_name || ' begins in the first column and ends in the second one.' AS text FROM part WHERE p_size > 10")
def document_sections(spark: SparkSession, d: str) -> DataFrame:
    """A section that goes on in the next column up to a stop heading, and one that is too short."""
    long = F.col("p_size") > 10
    words = [
        _word(50, 20, "Technical data"), _word(50, 700, "Product description"), _word(50, 712, F.when(long, F.concat(F.lit("The "), "p_name", F.lit(" begins in the first"))).otherwise("Short.")),
        _word(50, 724, F.when(long, "column and ends")), _word(320, 20, F.when(long, "in the second one.").otherwise("Another matter, which is long enough.")), _word(320, 36, "Packaging"), _word(320, 48, "Never read, however long this may be."),
    ]
    page = _page(2, "", words, [])
    page = page.withField("words", F.filter(page["words"], lambda w: w["text"].isNotNull()))
    return sections.product_descriptions(_documents(t(spark, d, "part"), "p_partkey", [_page(1, "cover", [], []), page])).select("doc_id", "page", "text")


@register(
    "SELECT c_custkey::VARCHAR AS doc_id, f AS field, CASE f WHEN 'balance' THEN CASE WHEN c_nationkey < 20 THEN (c_nationkey + 0.5)::VARCHAR END WHEN 'segment' THEN c_mktsegment WHEN 'background_database' THEN 'GaBi; ecoinvent 3.' || c_nationkey ELSE 'Maker ' || c_nationkey END AS value, "
    "CASE f WHEN 'balance' THEN 'table' WHEN 'segment' THEN 'pattern' WHEN 'background_database' THEN 'database_names' ELSE 'field_regex' END AS method FROM customer, (VALUES ('balance'), ('segment'), ('background_database'), ('lca_software')) x(f) WHERE f <> 'balance' OR c_nationkey < 20"
)
def extended_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that a JSON dictionary alone adds, beside software and databases."""
    path = f"{shared_folder(spark)}/fields-{uuid.uuid4().hex}"
    dictionary = '{"fields": [{"id": "balance", "labels": ["Account balance"], "kind": "number"}, {"id": "segment", "labels": [], "pattern": "sold to ([A-Z]+)"}]}'
    spark.createDataFrame([(dictionary,)], "value string").write.text(path)
    nation = F.col("c_nationkey").cast("string")
    text = _text("It is sold to ", F.col("c_mktsegment"), ".\nThe software used was Maker ", nation, ".\nData of ecoinvent 3.", nation, " and GaBi are used.")
    value = F.when(F.col("c_nationkey") < 20, F.concat(nation, F.lit(",5"))).otherwise("no number")
    docs = _documents(t(spark, d, "customer"), "c_custkey", [_page(1, text, [], [_table([["Account balance", value]])])])
    return sections.extended(docs, sections.read_fields(spark, path)).select("doc_id", "field", "value", "method")


@register(
    "SELECT p_partkey::VARCHAR AS doc_id, CASE p_size % 4 WHEN 0 THEN p_size * 3.0 WHEN 1 THEN p_size * 0.003 WHEN 2 THEN p_size * 3000.0 ELSE NULL END::DOUBLE AS mass_per_declared_unit_kg, "
    "CASE p_size % 4 WHEN 0 THEN 'mass per declared unit reported in the EPD' WHEN 1 THEN 'm = grammage × 3 m2' WHEN 2 THEN 'm = density × 3 m3' END AS mass_formula FROM part"
)
def page_properties(spark: SparkSession, d: str) -> DataFrame:
    """Mass of a declared unit from what pages say, in the units that they say it in."""
    kind = F.col("p_size") % 4
    text = F.when(kind == 0, F.concat(F.lit("Mass of the declared unit: "), F.col("p_size") * 3, F.lit(" kg"))).when(kind == 1, F.concat(F.lit("Grammage "), F.col("p_size"), F.lit(" g/m2"))).when(kind == 2, F.concat(F.lit("Gross density: "), F.col("p_size"), F.lit(" g/cm3\nDensity 1 kg/m3"))).otherwise("Nothing")
    rows = t(spark, d, "part")
    docs = _documents(rows, "p_partkey", [_page(1, "cover", [], []), _page(2, text, [], [])])
    unit = F.when(kind == 2, "m3").otherwise("m2")
    declared = rows.select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(3.0).alias("quantity"), unit.alias("unit"), F.when(kind == 2, "volume").otherwise("area").alias("dimension"), F.lit(1.0).alias("factor"))
    return sections.physical_properties(docs, declared).select("doc_id", "mass_per_declared_unit_kg", "mass_formula")


@register(
    f"SELECT {_NUMBER} AS epd_uid, '2.0' AS schema_version, CASE WHEN p_size % 3 <> 1 THEN CASE p_size % 3 WHEN 0 THEN '1.1' ELSE '2.0' END END AS migrated_from_schema, CASE WHEN p_size % 2 = 0 THEN 'external' END AS verification, CASE WHEN p_size % 3 <> 1 AND p_size % 2 = 0 THEN true END AS iso14025, "
    "CASE WHEN p_size % 5 = 0 AND p_size % 3 <> 1 THEN round_even(2 / (p_size * 0.2), 8) WHEN p_size % 5 = 0 THEN NULL END::DOUBLE AS conversion_factor_to_1kg, CASE WHEN p_size % 3 <> 1 THEN 'split_plus_reported_total' END AS a1_a3_reporting_mode, "
    "CASE WHEN p_size % 3 <> 1 THEN 'missing' ELSE 'kept' END AS worst, CASE WHEN p_size % 3 = 0 THEN 'wall' WHEN p_size % 3 = 1 THEN 'kept' ELSE 'boards' END AS category, CASE WHEN p_size % 3 <> 1 THEN (p_size + 2000) || '-06-30' END AS valid_until_iso, CASE WHEN p_size % 3 <> 1 THEN 2.0 END::DOUBLE AS declared_quantity FROM part"
)
def migrated_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Assembled records as older versions left them: without ISO 14025, factor, category or checklist; current ones stay as they are."""
    whole = _records(spark, d)
    records = assemble.apart(whole)
    sizes = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("epd_uid"), (F.col("p_size") % 3).alias("_kind"))
    md = F.col("metadata")
    old = records.join(sizes, "epd_uid").withColumn("metadata", md.withField("iso14025", F.lit(None).cast("boolean")).withField("conversion_factor_to_1kg", F.lit(None).cast("double")).withField("product_name", F.when(F.col("_kind") == 0, "Partition wall").otherwise("Something")))
    old = old.withColumn("schema_version", F.when(F.col("_kind") == 0, "1.1").otherwise("2.0")).withColumn("category", F.when(F.col("_kind") == 1, "kept").when(F.col("_kind") == 2, "boards")).withColumn("worst", F.when(F.col("_kind") == 1, "kept"))
    done = assemble.migrate(old.drop("_kind"))
    own = ("verification", "iso14025", "conversion_factor_to_1kg")
    return _numbered(done, whole).select("epd_uid", "schema_version", "migrated_from_schema", *[F.col(f"metadata.{c}").alias(c) for c in own], "a1_a3_reporting_mode", "worst", "category", "valid_until_iso", "declared_quantity")
