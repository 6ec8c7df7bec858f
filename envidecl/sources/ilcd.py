"""ILCD+EPD process and flow datasets, from XML columns.

XPath on local names reads any namespace prefix, JVM-side, without a schema to keep in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.domain import module_of
from ..functions.numbers import number_text, parse_number
from ..functions.text import clean_cell, let, normalize_text
from ..session import small
from .files import unzip

# --- Fixed values: flow properties --------------------------------------------------------------
MASS = "93a60a56-a3c8-11da-a746-0800200b9a66"
AREA = "93a60a56-a3c8-19da-a746-0800200c9a66"
VOLUME = "93a60a56-a3c8-22da-a746-0800200c9a66"
PROPERTY_UNITS = {
    MASS: "kg", AREA: "m2", VOLUME: "m3", "838aaa23-0117-11db-92e3-0800200c9a66": "m", "01846770-4cfe-4a25-8ad9-919d8d378345": "piece",
    "93a60a56-a3c8-14da-a746-0800200c9a66": "MJ", "93a60a56-a3c8-11da-a746-0800200c9a66": "MJ",
}
#: Material properties that declarations use, and their columns.
MATERIAL_COLUMNS = {
    "grammage": "grammage_kg_m2", "gross density": "gross_density_kg_m3", "bulk density": "bulk_density_kg_m3", "layer thickness": "layer_thickness_m",
    "linear density": "linear_density_kg_m", "weight per piece": "weight_per_piece_kg",
}


def _step(name: str) -> str:
    return f"*[local-name()='{name}']"


def _path(*names: str) -> str:
    return "//" + "/".join(_step(n) if not n.startswith("@") else f"@*[local-name()='{n[1:]}']" for n in names)


def _if_named(xml: Column, names: tuple[str, ...], value: Column) -> Column:
    """value where the XML has all names somewhere, else null: each path parses the XML anew, and most paths lead nowhere."""
    held = F.lit(True)
    for n in names:
        held = held & F.contains(xml, F.lit(n.lstrip("@")))
    return F.when(held, value)


def xml_text(xml: Column, *names: str) -> Column:
    """The first match's text, cleaned; null if there is none."""
    found = F.get(F.xpath(xml, F.lit(_path(*names) + ("/text()" if not names[-1].startswith("@") else ""))), F.lit(0))
    return _if_named(xml, names, _told(found))


def _told(found: Column) -> Column:
    """The text cleaned, null if it is empty; worked out once, where nullif would parse the XML for the comparison and again for the value."""
    return let(clean_cell(found), lambda x: F.when(x != "", x))


def _may_say(xml: Column, value: str) -> Column:
    """Whether an attribute can have the value: it stands between quotes, unless references or a document type spell it otherwise."""
    quoted = F.contains(xml, F.lit(f'"{value}"')) | F.contains(xml, F.lit(f"'{value}'"))
    return quoted | F.contains(xml, F.lit("&")) | F.contains(xml, F.lit("<!"))


def preferred(xml: Column, *names: str, languages: tuple[str, ...] = ("en", "da", "de")) -> Column:
    """The text in the first of the languages that is there, else the first of all."""
    base = _path(*names)
    tries = [F.when(_may_say(xml, lang), F.get(F.xpath(xml, F.lit(f"{base}[@*[local-name()='lang']='{lang}']/text()")), F.lit(0))) for lang in languages]
    found = F.coalesce(*tries, F.get(F.xpath(xml, F.lit(base + "/text()")), F.lit(0)))
    return _if_named(xml, names, _told(found))


def flows(members: DataFrame) -> DataFrame:
    """archive, flow_uuid and the amounts of its mass, area and volume properties."""
    xml = F.col("xml")
    amount = lambda uuid: parse_number(
        F.get(F.xpath(xml, F.lit(f"//{_step('flowProperty')}[{_step('referenceToFlowPropertyDataSet')}[@refObjectId='{uuid}']]/{_step('meanValue')}/text()")), F.lit(0))
    )
    each = f"//{_step('flowProperties')}/{_step('flowProperty')}"
    of = lambda path: F.xpath(xml, F.lit(path))
    said = members.where(F.contains("xml", F.lit("flowDataSet"))).select(
        "archive",
        F.lower(xml_text(xml, "UUID")).alias("flow_uuid"),
        amount(MASS).alias("flow_mass"),
        amount(AREA).alias("flow_area"),
        amount(VOLUME).alias("flow_volume"),
        xml_text(xml, "referenceToReferenceFlowProperty").alias("_index"),
        F.arrays_zip(of(f"{each}/@dataSetInternalID").alias("id"), of(f"{each}/{_step('referenceToFlowPropertyDataSet')}/@refObjectId").alias("ref"), of(f"{each}/{_step('meanValue')}/text()").alias("value")).alias("_all"),
        F.arrays_zip(of(f"//{_step('PropertyDetails')}/@id").alias("id"), of(f"//{_step('PropertyDetails')}/{_step('Name')}/text()").alias("name")).alias("_names"),
        F.arrays_zip(of(f"//{_step('PropertyData')}/@property").alias("id"), of(f"//{_step('PropertyData')}/{_step('Data')}/text()").alias("value")).alias("_data"),
    )
    own = F.get(F.filter("_all", lambda p: p["id"] == F.col("_index")), F.lit(0))
    named = F.transform("_data", lambda v: F.struct(F.lower(F.trim(F.get(F.filter("_names", lambda n: n["id"] == v["id"]), F.lit(0))["name"])).alias("key"), F.trim(v["value"]).try_cast("double").alias("value")))
    known = F.array_distinct(F.filter(named, lambda p: p["key"].isNotNull() & p["value"].isNotNull()))
    # A property that is given twice has its last value.
    last = F.filter(known, lambda p, k: ~F.exists(F.slice(known, k + 2, F.size(known)), lambda q: q["key"] == p["key"]))
    return said.select(
        "archive", "flow_uuid", "flow_mass", "flow_area", "flow_volume", F.lower(own["ref"]).alias("flow_reference"), F.trim(own["value"]).try_cast("double").alias("flow_reference_value"),
        F.map_from_entries(last).alias("material_properties"),
    ).where("flow_uuid IS NOT NULL")


def members(files: DataFrame) -> DataFrame:
    """archive, member, xml of files (path, content, format): members of archives, and single datasets."""
    inside = unzip(files.where("format = 'ilcd_zip'"), suffix=".xml").select(F.col("path").alias("archive"), "member", "content")
    alone = files.where("format = 'ilcd_xml'").select(F.col("path").alias("archive"), F.col("path").alias("member"), "content")
    return inside.unionByName(alone).select("archive", "member", F.decode("content", "UTF-8").alias("xml"))


def _first(members: DataFrame, most: int) -> DataFrame:
    """The first ``most`` members of each archive, and those of the same name as the last of them.

    Only archives that hold more are sorted, by names alone, so that a few large archives make no few large tasks.
    """
    large = members.groupBy("archive").count().where(F.col("count") > most).select("archive")
    if large.isEmpty():
        return members
    w = Window.partitionBy("archive").orderBy("member")
    last = members.select("archive", "member").join(large, "archive", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") == most)
    return members.join(small(last.select("archive", F.col("member").alias("_last"))), "archive", "left").where("_last IS NULL OR member <= _last").drop("_last")


def processes(members: DataFrame, most: int | None = None) -> DataFrame:
    """Identity, dates, reference flow and quality of all processes; of the first ``most`` of each archive only where a caller asks for it."""
    xml = F.col("xml")
    chosen = members.where(F.contains("xml", F.lit("processDataSet")))
    if most is not None:
        chosen = _first(chosen, most)
    review = xml_text(xml, "validation", "review", "@type")
    label = lambda b: normalize_text(F.regexp_extract(b, r"(?s)<(?:\w+:)?shortDescription\b[^>]*>([^<]*)<", 1))
    # What the XML says first, each path once; what follows from it afterwards.
    said = chosen.select(
        "archive",
        "member",
        "xml",
        F.lower(xml_text(xml, "UUID")).alias("uuid"),
        preferred(xml, "baseName").alias("product_name"),
        F.array_join(F.xpath(xml, F.lit(_path("classification", "class") + "/text()")), " / ").alias("ilcd_classification"),
        xml_text(xml, "registrationNumber").alias("registration_number"),
        xml_text(xml, "referenceServiceLife", "@years").alias("_life"),
        xml_text(xml, "referenceYear").alias("reference_year"),
        F.coalesce(xml_text(xml, "expirationDateOfEPD"), xml_text(xml, "dataSetValidUntil")).alias("_expiry"),
        F.coalesce(preferred(xml, "referenceToPublisher", "shortDescription"), preferred(xml, "referenceToRegistrationAuthority", "shortDescription")).alias("programme_operator"),
        preferred(xml, "technology", "technologicalApplicability").alias("product_description"),
        F.left(xml_text(xml, "publicationDateOfEPD"), F.lit(10)).alias("publication_date"),
        xml_text(xml, "subType").alias("ilcd_subtype"),
        xml_text(xml, "locationOfOperationSupplyOrProduction", "@location").alias("geographical_scope"),
        review.alias("_review"),
        F.transform(F.xpath(xml, F.lit(_path("complianceDeclarations", "compliance", "referenceToComplianceSystem", "shortDescription") + "/text()")), normalize_text).alias("compliance"),
        F.transform(_blocks(xml, "referenceToComplianceSystem", "referenceToComplianceSystem"), lambda b: F.struct(F.lower(b["ref"]).alias("system_uuid"), label(b["b"]).alias("label"))).alias("systems"),
        preferred(xml, "publicationAndOwnership", "referenceToOwnershipOfDataSet", "shortDescription").alias("manufacturer"),
        xml_text(xml, "referenceToReferenceFlow").alias("reference_internal_id"),
        F.get(F.xpath(xml, F.lit(f"//{_step('exchange')}/{_step('meanAmount')}/text()")), F.lit(0)).alias("_amount"),
        F.xpath(xml, F.lit(f"//{_step('exchange')}/@dataSetInternalID")).alias("_ids"),
        F.xpath(xml, F.lit(f"//{_step('exchange')}/{_step('referenceToFlowDataSet')}/@refObjectId")).alias("_flows"),
    )
    expiry, kind = F.col("_expiry"), F.lower("_review")
    return said.withColumns(
        {
            "reference_service_life_years": parse_number(F.col("_life")),
            "valid_until": F.when(expiry.rlike(r"^\d{4}$"), F.concat(expiry, F.lit("-12-31"))).otherwise(F.left(expiry, F.lit(10))),
            "verification": F.when(kind.rlike("external|third"), "external").when(kind.isNotNull(), "internal"),
            "declared_quantity": parse_number(F.col("_amount")),
            "reference_flow": F.lower(F.get("_flows", F.array_position("_ids", F.col("reference_internal_id")).cast("int") - 1)),
        }
    ).drop("_life", "_expiry", "_review", "_amount", "_ids", "_flows")


def with_flows(process: DataFrame, flow: DataFrame) -> DataFrame:
    """Left join within an archive; the reference flow's mass for its own quantity, or its material properties, give the factor."""
    joined = process.join(flow.withColumnRenamed("flow_uuid", "reference_flow"), ["archive", "reference_flow"], "left")
    per = F.coalesce(F.nullif("flow_reference_value", F.lit(0.0)), F.lit(1.0))
    joined = joined.withColumn("mass_per_declared_unit_kg", F.when(F.col("declared_quantity") != 0, F.bround(F.col("declared_quantity") * F.col("flow_mass") / per, 6)))
    by_mass = F.when(F.col("mass_per_declared_unit_kg") > 0, F.bround(F.col("declared_quantity") / F.col("mass_per_declared_unit_kg"), 8))
    given = lambda name: F.try_element_at("material_properties", F.lit(name))
    units = F.create_map(*[F.lit(x) for p in PROPERTY_UNITS.items() for x in p])
    return joined.withColumns(
        {
            "conversion_factor_to_1kg": F.coalesce(by_mass, given("conversion factor to 1 kg")),
            "declared_unit_raw": F.concat(number_text(F.col("declared_quantity")), F.lit(" "), F.try_element_at(units, F.col("flow_reference"))),
            **{column: given(name) for name, column in MATERIAL_COLUMNS.items()},
        }
    )


def registry(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """uuid, code and unit of indicators; the mapping is a parameter, as registries change."""
    return spark.createDataFrame([(u.lower(), c, unit) for u, c, unit in rows], "ind_uuid string, indicator string, unit string")


def _blocks(xml: Column, holder: str, ref: str) -> Column:
    """Array of struct(ref, b): each element of that name with the id it refers to."""
    parts = F.split(xml, rf"(?=<(?:\w+:)?{holder}[\s>])")
    own = F.filter(parts, lambda b: b.rlike(rf"^<(?:\w+:)?{holder}[\s>]"))
    whole = F.transform(own, lambda b: F.regexp_extract(b, rf"(?s)^(.*?</(?:\w+:)?{holder}>)", 1))
    return F.transform(whole, lambda b: F.struct(F.regexp_extract(b, rf"(?s)<(?:\w+:)?{ref}\b[^>]*?refObjectId=\"([^\"]+)\"", 1).alias("ref"), b.alias("b")))


def amounts(process: DataFrame) -> DataFrame:
    """archive, uuid, ind_uuid, module, scenario, raw: every amount of results and inventory, in document order."""
    xml = F.col("xml")
    pieces = [_blocks(xml, "LCIAResult", "referenceToLCIAMethodDataSet"), _blocks(xml, "exchange", "referenceToFlowDataSet")]
    each = process.select("archive", "uuid", F.posexplode(F.concat(*pieces)).alias("block", "p")).select("archive", "uuid", "block", F.lower("p.ref").alias("ind_uuid"), F.col("p.b").alias("b"))
    found = each.select("archive", "uuid", "block", "ind_uuid", F.posexplode(F.regexp_extract_all("b", F.lit(r"(?s)(<(?:\w+:)?amount\b[^>]*>[^<]*)"), 1)).alias("pos", "a"))
    attr = lambda name: F.nullif(F.regexp_extract("a", rf"\b(?:\w+:)?{name}=\"([^\"]*)\"", 1), F.lit(""))
    return found.select(
        "archive", "uuid", "block", "pos", "ind_uuid", module_of(attr("module")).alias("module"), attr("scenario").alias("scenario"), F.trim(F.regexp_extract("a", r">([^<]*)$", 1)).alias("raw")
    ).where("module IS NOT NULL")


def facts(amount: DataFrame, indicators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of known indicators, and the unknown ids per process. A later plain value replaces an earlier one."""
    indicators = small(indicators)
    known = amount.join(indicators, "ind_uuid")
    unknown = amount.join(indicators, "ind_uuid", "left_anti").groupBy("archive", "uuid").agg(F.array_sort(F.collect_set("ind_uuid")).alias("unknown_indicators"))
    w = Window.partitionBy("archive", "uuid", "indicator", "module", F.coalesce("scenario", F.lit(""))).orderBy(F.desc("block"), F.desc("pos"))
    last = known.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    value = parse_number(F.col("raw"))
    out = last.select("archive", "uuid", "indicator", "module", F.coalesce("scenario", F.lit("")).alias("scenario"), value.alias("value"), F.when(value.isNotNull(), "declared").otherwise("not_declared").alias("status"), "unit", F.col("raw").alias("raw_value"), "block", "pos")
    return out, unknown


def scenarios(process: DataFrame) -> DataFrame:
    """archive, uuid, scenario, is_default of the scenarios that processes describe."""
    tags = F.regexp_extract_all("xml", F.lit(r"<(?:\w+:)?scenario\b([^>]*)>"), 1)
    rows = process.select("archive", "uuid", F.posexplode(tags).alias("n", "a"))
    attr = lambda name: F.nullif(F.regexp_extract("a", rf"\b(?:\w+:)?{name}=\"([^\"]*)\"", 1), F.lit(""))
    return rows.select("archive", "uuid", F.coalesce(attr("name"), F.concat(F.lit("scenario_"), F.col("n") + 1)).alias("scenario"), F.coalesce(attr("default") == "true", F.lit(False)).alias("is_default"))


def module_slots(fact: DataFrame, scenario: DataFrame) -> DataFrame:
    """Facts with every module's own slot filled: by the default scenario, else the plain value, else the first scenario."""
    defaults = scenario.where("is_default").select("archive", "uuid", "scenario", F.lit(True).alias("_d")).distinct()
    rows = fact.join(defaults, ["archive", "uuid", "scenario"], "left")
    rank = F.when(F.coalesce("_d", F.lit(False)), 0).when(F.col("scenario") == "", 1).otherwise(2)
    w = Window.partitionBy("archive", "uuid", "indicator", "module").orderBy(rank, "block", "pos")
    slot = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("scenario", F.lit("")).drop("_n", "_d")
    return slot.unionByName(fact.where("scenario <> ''"))


def profiles(process: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """archive, uuid, standard_profile: of the last known compliance system (system_uuid, system_profile), else of the first label with 15804.

    Known systems are broadcast while they are few.
    """
    each = process.select("archive", "uuid", F.posexplode("systems").alias("n", "s")).select("archive", "uuid", "n", "s.system_uuid", "s.label")
    known = systems if systems is not None else process.sparkSession.createDataFrame([], "system_uuid string, system_profile string")
    each = each.join(small(known.select(F.lower("system_uuid").alias("system_uuid"), "system_profile")), "system_uuid", "left")
    by_label = F.when(F.contains("label", F.lit("15804")), profile_of(F.array("label")))
    best = each.groupBy("archive", "uuid").agg(F.max_by("system_profile", F.when(F.col("system_profile").isNotNull(), F.col("n"))).alias("_s"), F.min_by(by_label, F.when(by_label.isNotNull(), F.col("n"))).alias("_l"))
    return best.select("archive", "uuid", F.coalesce("_s", "_l", F.lit("unresolved")).alias("standard_profile"))


def declarations(fact: DataFrame) -> DataFrame:
    """Every module with a result is declared."""
    return fact.select("archive", "uuid", "module").distinct().withColumn("declared", F.lit("X"))


def profile_of(compliance: Column) -> Column:
    """The last compliance system that names a standard decides."""
    named = F.transform(
        compliance,
        lambda c: F.when(F.contains(c, F.lit("ef 3.1")), "EN15804_A2_EF3.1").when(F.contains(c, F.lit("ef 3.0")), "EN15804_A2_EF3.0").when(c.rlike(r"\+\s*a2"), "EN15804_A2_UNKNOWN_EF").when(c.rlike(r"\+\s*a1|15804"), "EN15804_A1_CML"),
    )
    return F.element_at(F.concat(F.array(F.lit("unresolved")), F.array_compact(named)), -1)

