"""Whole records from documents, and what is derived from them: joins from pages or XML to summary rows.

Parsed datasets, records and facts are written once in the session's shared folder, as everything
that follows reads them several times and parsing is what costs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import tables as D
from ..functions.dates import resolve_validity
from ..functions.domain import language_vote, standard_profile
from ..functions.text import record_uid
from ..functions.units import normalize_unit, parse_declared_unit
from ..schemas import FACT_RESULT, RECORD
from ..session import kept
from ..sources import documents, ilcd, sections
from . import results, rules
from .store import latest

#: The indicators of the checklist; others are dropped unless everything is asked for.
STEP1_CODES = sorted({c for _, new, old in D.INDICATOR_GROUPS for c in [*new, *old]})
_FIELDS = [f.split(":") for f in RECORD.split("metadata struct<")[1].split(">,")[0].split(",")]


def _fact_columns(rows: DataFrame, known: dict[str, Column], *own: str) -> DataFrame:
    kinds = dict(c.split() for c in FACT_RESULT.split(", "))
    return rows.select(*[known.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()], *own)


def _records(rows: DataFrame, known: dict[str, Column], facts: DataFrame, declared: DataFrame, key: str = "epd_uid") -> DataFrame:
    """Rows with epd_uid, source_format, file_sha256, full_text become records with their facts and modules, met by the key, nested."""
    metadata = F.struct(*[known.get(n, F.lit(None)).cast(k).alias(n) for n, k in _FIELDS])
    modules = declared.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("module", "declared"))).alias("declared"))
    out = rows.withColumn("metadata", metadata).join(results.nest(facts, key), key, "left").join(modules, key, "left")
    own = [c for c in ("source_file", "doc_id") if c in rows.columns]
    return out.select("epd_uid", "metadata", "results", "declared", "source_format", "file_sha256", "full_text", *own)


def from_documents(docs: DataFrame, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records and facts of documents laid out on pages (``schemas.RAW_DOCUMENT``; columns file_sha256, source_file and doc_id are kept).

    Documents under one number are versions of a declaration: each is a record of its own, with its own facts. See ``apart``.
    """
    if "file_sha256" not in docs.columns:
        docs = docs.withColumn("file_sha256", F.lit(None).cast("string"))
    # A dozen readers go over the pages; whatever lays them out runs once.
    docs = kept(docs)
    text = F.array_join(F.transform("pages", lambda p: F.coalesce(p["text"], F.lit(""))), "\f")
    base = docs.select("doc_id", "file_sha256", *[c for c in ("source_file",) if c in docs.columns], text.alias("full_text")).join(sections.metadata(docs), "doc_id", "left")
    base = base.withColumn("standard_profile", standard_profile(F.col("full_text")))
    base = kept(base.withColumn("epd_uid", record_uid(F.col("registration_number"), F.lit(None).cast("string"), F.col("file_sha256"), F.col("full_text"))))
    uids = base.select("doc_id", "epd_uid")
    raw = documents.extract_facts(docs, base.select("doc_id", F.col("standard_profile").alias("profile"))).join(uids, "doc_id")
    facts = _fact_columns(
        raw,
        {
            **{c: F.col(c) for c in ("epd_uid", "indicator", "module", "value", "status", "raw_value", "raw_unit", "confidence")}, "scenario": F.coalesce("scenario", F.lit("")), "unit": F.col("canonical_unit"),
            "source_page": F.col("page"), "extraction_method": F.col("method"), "provenance": F.lit("reported"), "human_edited": F.lit(False),
        },
        "doc_id",
    )
    if not everything:
        facts = results.retain(facts, STEP1_CODES)[0]
    facts = kept(facts)
    declared = documents.extract_declarations(docs).select("doc_id", "module", "declared").dropDuplicates(["doc_id", "module"])
    own = ("registration_number", "product_name", "manufacturer", "programme_operator", "declared_unit_raw", "standard_profile", "publication_date", "valid_until", "reference_service_life_years", "reference_service_life_status", "pcr", "geographical_scope", "verification", "verifier", "product_description", "mass_per_declared_unit_kg", "conversion_factor_to_1kg")
    # The language that a number ends in is surer than the text's words.
    suffix = F.create_map(*[F.lit(x) for p in D.NUMBER_LANGUAGES.items() for x in p])
    told = F.try_element_at(suffix, F.regexp_extract(F.coalesce("registration_number", F.lit("")), "-([A-Z]{2})$", 1))
    known = {c: F.col(c) for c in own} | {"language": F.coalesce(told, language_vote(F.col("full_text"))["language"]), "iso14025": F.col("full_text").rlike(r"(?i)ISO\s*14025"), "standard": _standard(F.col("standard_profile"))}
    rows = base.withColumn("source_format", F.lit("pdf"))
    return kept(_records(rows, known, facts, declared, "doc_id")), facts.drop("doc_id")


def apart(records: DataFrame) -> DataFrame:
    """Records of documents under their documents' ids, so that what is derived from versions of one declaration stays apart."""
    return records.withColumn("epd_uid", F.col("doc_id")).drop("doc_id")


def from_ilcd(members: DataFrame, indicators: DataFrame, systems: DataFrame | None = None, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records and facts of the processes among members (archive, member, xml); indicators: ind_uuid, indicator, unit."""
    process = kept(ilcd.processes(members))
    base = ilcd.with_flows(process, ilcd.flows(members)).join(ilcd.profiles(process, systems), ["archive", "uuid"], "left")
    none = F.lit(None).cast("string")
    base = kept(base.withColumn("epd_uid", record_uid(F.col("registration_number"), F.col("uuid"), none, F.col("xml"))))
    amounts, _ = ilcd.facts(ilcd.amounts(process), indicators)
    slots = kept(ilcd.module_slots(amounts, ilcd.scenarios(process)))
    uids = base.select("archive", "uuid", "epd_uid")
    facts = _fact_columns(
        slots.join(uids, ["archive", "uuid"]),
        {**{c: F.col(c) for c in ("epd_uid", "indicator", "module", "scenario", "value", "status", "unit", "raw_value")}, "confidence": F.lit(1.0), "extraction_method": F.lit("ilcd_xml"), "provenance": F.lit("reported"), "human_edited": F.lit(False)},
    )
    if not everything:
        facts = results.retain(facts, STEP1_CODES)[0]
    declared = ilcd.declarations(slots).join(uids, ["archive", "uuid"]).select("epd_uid", "module", "declared").dropDuplicates(["epd_uid", "module"])
    own = ("programme_operator", "product_description", "declared_unit_raw", "registration_number", "product_name", "manufacturer", "standard_profile", "publication_date", "valid_until", "reference_service_life_years", "mass_per_declared_unit_kg", "conversion_factor_to_1kg", "ilcd_classification", "ilcd_subtype", "geographical_scope", "verification", "uuid")
    known = {c: F.col(c) for c in own} | {"standard": _standard(F.col("standard_profile")), "iso14025": F.exists("compliance", lambda c: F.contains(c, F.lit("14025")))}
    rows = base.withColumn("source_format", F.lit("ilcd_xml")).withColumn("file_sha256", none).withColumn("full_text", F.concat_ws("\n", "product_name", "product_description"))
    return kept(_records(rows, known, facts, declared)), facts


def from_files(files: DataFrame, indicators: DataFrame, systems: DataFrame | None = None, everything: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records and facts of the datasets among files (``sources.files.read_files``), and the files of other formats."""
    records, facts = from_ilcd(kept(ilcd.members(files)), indicators, systems, everything)
    return records, facts, files.where("format NOT IN ('ilcd_zip', 'ilcd_xml')").select("path", "format")


def _standard(profile: Column) -> Column:
    return F.when(profile.startswith("EN15804_A2"), "EN 15804+A2").when(profile.startswith("EN15804_A1"), "EN 15804+A1")


@dataclass
class Derived:
    facts: DataFrame
    classified: DataFrame
    step1: DataFrame
    report: DataFrame
    summary: DataFrame


def derive(records: DataFrame, facts: DataFrame | None = None, overrides: DataFrame | None = None, categories: list[tuple] | None = None) -> Derived:
    """Everything that follows from records, one of each epd_uid (``apart`` gives every document one); run again for those that were edited. overrides: epd_uid, chosen."""
    long = results.flatten(records) if facts is None else facts
    # A dozen checks read the facts; units are made plain once.
    long = kept(long.withColumn("unit", normalize_unit(F.col("unit"))))
    classified = rules.classify(records, categories=categories)
    if overrides is not None:
        classified = rules.override_category(classified, overrides)
    # Whoever takes few of its columns joins the records' file alone, which Spark takes for smaller than its rows are.
    checked = rules.step1(records, long).hint("merge")
    return Derived(long, classified, checked, rules.step1_report(records, long, checked), rules.summarize(records, long, checked, classified))


def reporting_modes(facts: DataFrame) -> DataFrame:
    """epd_uid and how each declaration reports the product stage of its total warming potential, that of +A2 if it has both."""
    has = lambda module: F.coalesce(F.bool_or((F.col("module") == module) & F.col("value").isNotNull()), F.lit(False))
    per = facts.where("scenario = '' AND indicator IN ('GWP-total', 'GWP')").groupBy("epd_uid", "indicator").agg(has("A1-A3").alias("t"), *[has(m).cast("int").alias(m) for m in ("A1", "A2", "A3")])
    mode = results.a1_a3_mode(F.col("t"), F.col("A1") + F.col("A2") + F.col("A3"))
    return per.groupBy("epd_uid").agg(F.max_by(mode, "indicator").alias("a1_a3_reporting_mode"))


def migrate(records: DataFrame, version: str = "2.0") -> DataFrame:
    """Records of older schemas with all that the current one has; nothing that is there changes.

    records: those of RECORD, and schema_version, category and worst (the checklist's worst status), null where a record has none.
    One of the current version with a category and a checklist is left as it is. In others what older versions did not know is derived again:
    ISO 14025 from an external verification, the conversion factor from a mass, dates and declared quantities in plain form, the
    reporting mode and the checklist in any case, and the category if there is none.
    """
    old = F.coalesce("schema_version", F.lit("1.0"))
    ready = (old == version) & F.col("worst").isNotNull() & F.col("category").isNotNull()
    base = records.select("*", ready.alias("_ready"), old.alias("_old"))
    md, unit = F.col("metadata"), parse_declared_unit(F.col("metadata.declared_unit_raw"))
    external = F.when(F.contains(F.lower(md["verification"]), F.lit("external")), True)
    factor = F.bround(unit["quantity"] / F.nullif(md["mass_per_declared_unit_kg"], F.lit(0.0)), 8)
    filled = md.withField("iso14025", F.coalesce(md["iso14025"], external)).withField("conversion_factor_to_1kg", F.coalesce(md["conversion_factor_to_1kg"], factor))
    base = kept(base.withColumn("metadata", F.when(F.col("_ready"), md).otherwise(filled)))
    todo = base.where("NOT _ready")
    facts = results.flatten(todo)
    facts = kept(facts.withColumn("unit", normalize_unit(F.col("unit"))))
    checked = rules.step1(todo, facts).select("epd_uid", F.col("worst").alias("_worst"), "mandatory_ok", *[f"n_{k}" for k in ("pass", "warning", "fail", "missing")])
    classified = rules.classify(todo.where("category IS NULL")).select("epd_uid", F.col("category").alias("_category"))
    out = base.join(reporting_modes(facts), "epd_uid", "left").join(checked, "epd_uid", "left").join(classified, "epd_uid", "left")
    dates, new = resolve_validity(md["publication_date"], md["valid_until"]), ~F.col("_ready")
    return out.select(
        *[c for c in records.columns if c not in ("schema_version", "category", "worst")],
        F.coalesce("category", "_category").alias("category"),
        F.when(new, F.col("_worst")).otherwise(F.col("worst")).alias("worst"),
        "mandatory_ok", "n_pass", "n_warning", "n_fail", "n_missing",
        F.when(new, F.coalesce("a1_a3_reporting_mode", F.lit("none"))).alias("a1_a3_reporting_mode"),
        F.when(new, dates["published"].cast("string")).alias("publication_date_iso"),
        F.when(new, dates["valid"].cast("string")).alias("valid_until_iso"),
        F.when(new, unit["quantity"]).alias("declared_quantity"),
        F.when(new, unit["unit"]).alias("declared_unit"),
        F.when(new, F.col("_old")).alias("migrated_from_schema"),
        F.lit(version).alias("schema_version"),
    )


def edit_fields(records: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata as reviewers left it, and a log of what was there before.

    edits: epd_uid, field, value (text; null or empty takes a value away). The last edit of a field
    in the order of ``at`` counts, where edits have that column. What does not change is not logged.
    """
    order = [F.col("at").desc_nulls_last()] if "at" in edits.columns else [F.col("value").asc_nulls_last()]
    last = latest(edits.where(F.col("field").isin([n for n, _ in _FIELDS])), ["epd_uid", "field"], order)
    wanted = last.groupBy("epd_uid").agg(F.map_from_entries(F.collect_list(F.struct("field", F.coalesce("value", F.lit("")).alias("value")))).alias("_e"))
    both = records.join(wanted, "epd_uid", "left")

    def new(name: str, kind: str) -> Column:
        own, typed = F.col(f"metadata.{name}"), F.nullif(F.try_element_at("_e", F.lit(name)), F.lit(""))
        return F.when(F.map_contains_key("_e", F.lit(name)), typed.try_cast(kind)).otherwise(own).alias(name)

    after = both.withColumn("_new", F.struct(*[new(n, k) for n, k in _FIELDS]))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    changes = F.array(*[F.when(text(f"metadata.{n}") != text(f"_new.{n}"), F.struct(F.lit(n).alias("field"), F.col(f"metadata.{n}").cast("string").alias("original"))) for n, _ in _FIELDS])
    log = after.where("_e IS NOT NULL").select("epd_uid", F.inline(F.array_compact(changes))).select("epd_uid", "field", "original", F.lit("human_review").alias("extraction_method"), F.lit(1.0).alias("confidence"))
    return after.withColumn("metadata", F.col("_new")).select(records.columns), log
