"""What documents say outside their tables of results: sections under headings, cover titles, physical properties, fields by dictionary.

One small Python pass puts a page's words in reading order; everything after that is column
functions and windows over its lines, the same for pages without words, whose text is split into lines.
Every value comes with its page, the text it was read from, the way it was found and a confidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import parse_date
from ..functions.numbers import parse_number
from ..functions.text import clean_cell, clean_lines, let, normalize_text
from ..functions.units import parse_declared_unit, unit_quantity
from . import layout as L
from .documents import FOUND, _boxes, each_row, extract_metadata, labeled_values, table_rows
from .registries import read_section

# --- Fixed values: headings, and names of properties and databases -----------------------------------
DESCRIPTION = ["product description", "product definition", "description of the product", "produktbeskrivelse"]
AFTER_DESCRIPTION = [
    "application", "technical data", "base materials", "base materials/ancillary materials", "manufacture", "production", "lca: calculation rules", "declared unit", "packaging",
    "placing on the market/application rules", "delivery status", "environment and health during use",
]
DATABASES = ["ecoinvent", "managed lca content", "gabi", "sphera mlc", "ökobaudat"]
#: Property, its unit, and what a label says: each word of the first list with each of the second.
PROPERTIES = [
    ("conversion_factor_to_1kg", None, ["conversion factor", "umrechnungsfaktor"], ["to 1 kg", "1 kg", "zu 1 kg"]),
    ("mass_per_declared_unit_kg", "kg", ["mass", "weight"], ["per declared unit", "of declared unit", "of the declared unit", "per functional unit", "of functional unit", "of the functional unit"]),
    ("mass_per_declared_unit_kg", "kg", ["conversion factor to mass", "mass reference", "weight per unit"], [""]),
    ("weight_per_piece_kg", "kg", ["mass", "weight"], ["per piece"]),
    ("grammage_kg_m2", "kg/m2", ["mass", "weight"], ["per m2"]),
    ("grammage_kg_m2", "kg/m2", ["grammage", "area weight", "flächengewicht"], [""]),
    ("gross_density_kg_m3", "kg/m3", ["gross density", "rohdichte"], [""]),
    ("bulk_density_kg_m3", "kg/m3", ["bulk density", "schüttdichte"], [""]),
    ("density_kg_m3", "kg/m3", ["density", "densitet", "dichte"], [""]),
    ("linear_density_kg_m", "kg/m", ["mass", "weight"], ["per metre", "per meter", "per running metre", "per running meter"]),
    ("linear_density_kg_m", "kg/m", ["linear density"], [""]),
]

#: Terms of labels, the longest first, as the longest that a label holds tells its property.
TERMS = sorted({(" ".join(f"{a} {b}".split()), p, u) for p, u, one, two in PROPERTIES for a, b in product(one, two)}, key=lambda x: (-len(x[0]), x[0]))
LINE = "doc_id string, page int, way int, at int, text string, gap double, turn boolean"
LAYOUT, TEXT = 0, 1
#: A gap of so many heights of a line ends a section.
SECTION_GAP = 2.5


def lines(docs: DataFrame, most_pages: int = 6) -> DataFrame:
    """Lines of the first pages in reading order: by layout where a page has words, and by its text; ``turn`` opens a column or page."""

    def of(doc_id: str, pages) -> Iterator[tuple]:
        for page in pages if pages is not None else ():
            for k, line in enumerate(L.reading_order(L.segments(_boxes(page["words"])), page["width"] or 0.0)):
                yield (doc_id, page["number"], LAYOUT, k, *line)

    laid = F.transform(F.slice("pages", 1, most_pages), lambda p: F.struct(p["page_number"].alias("number"), p["width"].alias("width"), p["words"].alias("words")))
    by_layout = each_row(docs.select("doc_id", laid.alias("pages")), of, LINE)
    pages = docs.select("doc_id", F.explode(F.slice("pages", 1, most_pages)).alias("p"))
    split = pages.select("doc_id", F.col("p.page_number").alias("page"), F.lit(TEXT).alias("way"), F.posexplode_outer(clean_lines(F.col("p.text"))).alias("at", "text")).where("text IS NOT NULL")
    return by_layout.unionByName(split.select("*", F.lit(None).cast("double").alias("gap"), (F.col("at") == 0).alias("turn")))


def sections(rows: DataFrame, headings: list[str], stops: list[str], least: int = 30, most: int = 1500) -> DataFrame:
    """doc_id, page, text and source of the first section under one of the headings.

    It runs to a stop heading, a wide gap, or a line beyond ``most`` characters, and goes on in the next
    column or page only where a sentence is unfinished. What the layout gives precedes the plain text of a page.
    """
    mark = lambda name: F.when(name.isin(*headings) | F.startswith(name, F.lit(headings[0])), True).when(name.isin(*stops), False)
    # One exchange, by document, serves every window and both groupings.
    rows = rows.repartition("doc_id")
    ordered = Window.partitionBy("doc_id", "way").orderBy("page", "at")
    marked = rows.withColumn("_mark", let(F.rtrim(normalize_text(F.col("text")), F.lit(":")), mark))
    marked = marked.withColumn("_section", F.count("_mark").over(ordered)).withColumn("_in", F.last("_mark", ignorenulls=True).over(ordered))
    before = F.lag("text").over(ordered)
    ends = F.coalesce(F.col("gap") > SECTION_GAP, F.lit(False)) | (F.col("turn") & before.rlike(r"[.!?:]\s*$"))
    # Inside a section the last heading is its own.
    heading = F.last(F.when(F.col("_mark"), F.col("page")), ignorenulls=True).over(ordered)
    marked = marked.withColumn("_ends", ends).withColumn("_page", heading).where("_in AND _mark IS NULL")
    so_far = Window.partitionBy("doc_id", "way", "_section").orderBy("page", "at")
    kept = marked.withColumn("_over", F.max("_ends").over(so_far)).withColumn("_chars", F.sum(F.length("text")).over(so_far) - F.length("text")).where(f"NOT _over AND _chars <= {most}")
    whole = kept.groupBy("doc_id", "way", "_section", "_page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "at", "text"))), lambda x: x["text"]), " ").alias("text"))
    found = whole.where(F.length(F.trim("text")) > least)
    first = found.groupBy("doc_id").agg(F.min_by(F.struct(F.col("_page").alias("page"), F.trim("text").alias("text")), F.struct("_page", "way", "_section")).alias("s"))
    return first.select("doc_id", "s.page", "s.text", F.left("s.text", F.lit(400)).alias("source"))


def product_descriptions(docs: DataFrame) -> DataFrame:
    """doc_id, page, text, source of the section that describes the product."""
    return sections(lines(docs), DESCRIPTION, AFTER_DESCRIPTION)


# --- Physical properties ------------------------------------------------------------------------------
def unit_factor(unit: Column, wanted: Column) -> Column:
    """What a number in ``unit`` is multiplied by to be in ``wanted`` (kg, or kg by m, m2, m3); 1 for units that are not known to be of that kind."""

    def side(u: Column) -> Column:
        """struct(quantity, factor) of a simple unit; a power of a length that has no name is that power of its factor."""
        base, power = F.regexp_extract(u, r"^([a-z]+?)([23])$", 1), F.regexp_extract(u, r"^([a-z]+?)([23])$", 2).try_cast("int")
        told = F.struct(unit_quantity(u).alias("known"), unit_quantity(F.nullif(base, F.lit(""))).alias("length"), power.alias("power"))

        def judged(x: Column) -> Column:
            known, length, power = x["known"], x["length"], x["power"]
            raised = F.when(length["quantity"] == "length", F.struct(F.concat(F.lit("length"), power.cast("string")).alias("quantity"), F.pow(length["factor"], power).alias("factor")))
            kind = F.when(known["quantity"] == "area", "length2").when(known["quantity"] == "volume", "length3").otherwise(known["quantity"])
            return F.coalesce(raised, F.when(known.isNotNull(), F.struct(kind.alias("quantity"), known["factor"].cast("double").alias("factor"))))

        return let(told, judged)

    def ratio(u: Column) -> Column:
        parts = F.split(F.translate(F.regexp_replace(F.lower(F.trim(u)), r"\s*(?:/|\bper\b)\s*", "/"), "²³[]() ", "23"), "/")

        def joined(x: Column) -> Column:
            one, two = F.get(x, F.lit(0)), F.get(x, F.lit(1))
            return F.struct(
                F.concat_ws("/", one["quantity"], F.when(F.size(x) > 1, F.coalesce(two["quantity"], F.lit("?")))).alias("kind"),
                (one["factor"] / F.when(F.size(x) > 1, two["factor"]).otherwise(1.0)).alias("factor"),
            )

        return let(F.transform(parts, side), joined)

    # Each step is worked out once, however often the next one uses it.
    return let(F.struct(ratio(unit).alias("a"), ratio(wanted).alias("b")), lambda s: F.coalesce(F.when(s["a"]["kind"] == s["b"]["kind"], s["a"]["factor"] / s["b"]["factor"]), F.lit(1.0)))


def property_values(docs: DataFrame) -> DataFrame:
    """doc_id, property, value (in the property's unit), page, source: the first of each; tables of a page precede its lines."""
    cells = F.filter("cells", lambda c: c != "")
    in_tables = table_rows(docs).withColumn("_c", cells).where(F.size("_c") >= 2).select(
        "doc_id", "page", F.lit(0).alias("way"), (F.col("tab") * 100_000 + F.col("row")).alias("at"), F.get("_c", F.lit(0)).alias("label"),
        F.array_join(F.slice("_c", 2, 2), " ").alias("told"), F.array_join("_c", " | ").alias("source"),
    )
    # As in tables of values, explode_outer keeps a step that the next one filters by from being worked out for both.
    pages = docs.select("doc_id", F.explode("pages").alias("p"))
    text = pages.select("doc_id", F.col("p.page_number").alias("page"), F.posexplode_outer(clean_lines(F.col("p.text"))).alias("at", "source"))
    shape = r"^(\D.{2,59}?)[\s:=]+(\d[\d.,]*(?:\s*[Ee][+-]?\d+)?(?:\s+\S{1,12})?)$"
    in_lines = text.where(F.col("source").rlike(shape)).select(
        "doc_id", "page", F.lit(1).alias("way"), "at", F.regexp_extract("source", shape, 1).alias("label"), F.regexp_extract("source", shape, 2).alias("told"), "source"
    )
    label = F.concat(F.lit(" "), F.regexp_replace(F.translate(normalize_text(F.col("label")), "²³", "23"), r"[^\p{L}\d]+", " "), F.lit(" "))
    terms = F.array(*[F.struct(F.lit(f" {t} ").alias("term"), F.lit(p).alias("property"), F.lit(u).cast("string").alias("unit")) for t, p, u in TERMS])
    # The label is made plain once, not for every term.
    held = let(label, lambda x: F.slice(F.filter(terms, lambda t: F.contains(x, t["term"])), 1, 1))
    rows = in_tables.unionByName(in_lines).where(F.length("label") <= 70)
    rows = rows.select("*", F.explode_outer(held).alias("_t")).where("_t IS NOT NULL")
    number, unit = F.split(F.trim("told"), r"\s+", 2)[0], F.get(F.split(F.trim("told"), r"\s+", 2), F.lit(1))
    factor = F.when(F.col("_t.unit").isNull(), 1.0).otherwise(unit_factor(unit, F.col("_t.unit")))
    value = F.bround(parse_number(number) * F.coalesce(factor, F.lit(1.0)), 9)
    rows = rows.select("doc_id", "page", "way", "at", "source", F.col("_t.property").alias("property"), F.explode_outer(F.array(value)).alias("value")).where("value > 0")
    first = rows.groupBy("doc_id", "property").agg(F.min_by(F.struct("value", "page", "source"), F.struct("page", "way", "at")).alias("f"))
    return first.select("doc_id", "property", "f.value", "f.page", "f.source")


def physical_properties(docs: DataFrame, declared: DataFrame) -> DataFrame:
    """Properties of each document, and kg of its declared unit with the rule that gave it; declared: doc_id, quantity, unit, dimension, factor."""
    names = list(dict.fromkeys(p for p, *_ in PROPERTIES))
    wide = property_values(docs).groupBy("doc_id").pivot("property", names).agg(F.first("value"))
    rows = docs.select("doc_id").join(declared, "doc_id", "left").join(wide, "doc_id", "left")
    q, size = F.col("quantity"), F.format_string("%s", F.regexp_replace(F.col("quantity").cast("string"), r"\.0$", ""))
    reported, ratio = F.col("mass_per_declared_unit_kg"), F.col("conversion_factor_to_1kg")
    density = F.coalesce("gross_density_kg_m3", "density_kg_m3", "bulk_density_kg_m3")
    by = lambda name, unit: F.concat(F.lit(f"m = {name} × "), size, F.lit(unit))
    rules = [
        (reported, F.lit("mass per declared unit reported in the EPD")),
        (q / ratio, F.lit("m = M / f (ILCD+EPD 'conversion factor to 1 kg')")),
        (F.when(F.col("dimension") == "mass", q * F.coalesce("factor", F.lit(1.0))), F.concat(F.lit("declared unit is a mass ("), size, F.lit(" "), "unit", F.lit(")"))),
        (F.when(F.col("dimension") == "area", q * F.col("grammage_kg_m2")), by("grammage", " m2")),
        (F.when(F.col("dimension") == "volume", q * density), by("density", " m3")),
        (F.when(F.col("dimension") == "length", q * F.col("linear_density_kg_m")), by("linear density", " m")),
        (F.when(F.col("dimension").isin("items", "pieces"), q * F.col("weight_per_piece_kg")), by("weight per piece", "")),
    ]
    found = F.coalesce(*[F.when(mass > 0, F.struct(mass.alias("mass"), text.alias("formula"))) for mass, text in rules])
    out = rows.withColumn("_m", found)
    own = [F.col(n) for n in names if n not in ("mass_per_declared_unit_kg", "conversion_factor_to_1kg")]
    return out.select(
        "doc_id", *own, F.bround("_m.mass", 6).alias("mass_per_declared_unit_kg"), F.coalesce(ratio, F.bround(q / F.col("_m.mass"), 8)).alias("conversion_factor_to_1kg"), F.col("_m.formula").alias("mass_formula")
    )


# --- Fields by dictionary -----------------------------------------------------------------------------
def read_fields(spark: SparkSession, path: str, section: str = "fields") -> list[dict]:
    """Fields of a JSON dictionary: id, labels, kind (text, number, date), pages (how many are looked at) and pattern (its first group is the value)."""
    rows = read_section(spark, path, section, "id:string,labels:array<string>,kind:string,pages:int,pattern:string").collect()
    return [{"id": r["id"], "labels": list(r["labels"] or []), "kind": r["kind"] or "text", "pages": r["pages"] or 3, "pattern": r["pattern"]} for r in rows if r["id"]]


def dictionary_fields(docs: DataFrame, fields: list[dict]) -> DataFrame:
    """doc_id, field, value, page, source, method, confidence of the fields of a dictionary; labels come before patterns.

    Numbers and dates are given in plain form (a point, year-month-day); a value that is none is left out.
    """
    found = None
    for pages in sorted({f["pages"] for f in fields}):
        labels = {f["id"]: [normalize(x) for x in f["labels"]] for f in fields if f["pages"] == pages and f["labels"]}
        if labels:
            rows = labeled_values(docs, labels, pages)
            found = rows if found is None else found.unionByName(rows)
    text = docs.select("doc_id", F.posexplode("pages").alias("_k", "p")).select("doc_id", "_k", F.col("p.page_number").alias("page"), F.coalesce("p.text", F.lit("")).alias("_t"))
    for f in fields:
        if f["pattern"]:
            group = min(1, re.compile(f["pattern"]).groups)
            hit = text.where(F.col("_k") < f["pages"]).select("doc_id", F.lit(f["id"]).alias("field"), F.regexp_extract("_t", f["pattern"], group).alias("value"), "page", F.regexp_extract("_t", f["pattern"], 0).alias("source"))
            rows = hit.where("value <> ''").select("*", F.lit("pattern").alias("method"), F.lit(0.7).alias("confidence"))
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    kinds = F.create_map(*[F.lit(x) for f in fields for x in (f["id"], f["kind"])])
    kind, number = kinds[F.col("field")], parse_number(F.col("value"))
    plain = F.when(kind == "number", number.cast("string")).when(kind == "date", parse_date(F.col("value"))["iso"].cast("string")).otherwise(F.trim("value"))
    typed = found.select(*[c for c in found.columns if c != "value"], F.explode_outer(F.array(plain)).alias("value")).where("value IS NOT NULL")
    best = typed.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "page", "source", "method", "confidence"), F.struct(-F.col("confidence"), "page", "source")).alias("b"))
    return best.select("doc_id", "field", "b.*")


def normalize(label: str) -> str:
    return L.plain(label).rstrip(":")


def compositions(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, page and components (component, value, unit) of the first table with so many shares in percent below its first row."""
    cells = F.filter("cells", lambda c: c != "")
    rows = table_rows(docs).where("row > 0").withColumn("_c", cells).where((F.size("_c") >= 2) & F.contains(F.array_join(F.slice("_c", 2, 2), " "), F.lit("%")))
    share = F.get("_c", F.lit(1))
    part = F.struct("row", F.get("_c", F.lit(0)).alias("component"), F.coalesce(parse_number(F.replace(share, F.lit("%"), F.lit(""))).cast("string"), share).alias("value"), F.lit("%").alias("unit"))
    tables = rows.groupBy("doc_id", "page", "tab").agg(F.array_sort(F.collect_list(part)).alias("parts")).where(F.size("parts") >= least)
    first = tables.groupBy("doc_id").agg(F.min_by(F.struct("page", "parts"), F.struct("page", "tab")).alias("t"))
    return first.select("doc_id", "t.page", F.transform("t.parts", lambda p: F.struct(p["component"].alias("component"), p["value"].alias("value"), p["unit"].alias("unit"))).alias("components"))


def extended(docs: DataFrame, fields: list[dict] | None = None) -> DataFrame:
    """doc_id, field, value, page, source, method, confidence beyond the usual metadata: composition, software, databases, and a dictionary's fields."""
    parts = compositions(docs).select(
        "doc_id", F.lit("product_composition").alias("field"), F.to_json("components").alias("value"), "page", F.concat(F.size("components").cast("string"), F.lit(" rows")).alias("source"), F.lit("structured_table").alias("method"), F.lit(0.9).alias("confidence")
    )
    text = docs.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.page_number").alias("page"), F.translate(F.coalesce("p.text", F.lit("")), "\xa0", " ").alias("_t"))
    # What follows the word in its sentence, without words that only link.
    said = F.regexp_extract("_t", r"(?i)\bsoftware\b([^.\n]{3,90})", 0)
    product_ = F.trim(F.regexp_replace(F.regexp_extract("_t", r"(?i)\bsoftware\b([^.\n]{3,90})", 1), r"(?i)^(?:[\s:=–-]+|(?:is|was|used|for|the|named)\b)+", ""))
    # explode_outer: what is filtered by is worked out once.
    software = text.select("doc_id", "page", F.explode_outer(F.array(F.struct(product_.alias("value"), said.alias("source")))).alias("_s")).select("doc_id", "page", "_s.*").where(F.length("value") > 2)
    software = software.groupBy("doc_id").agg(F.min_by(F.struct("value", "page", "source"), "page").alias("s"))
    software = software.select("doc_id", F.lit("lca_software").alias("field"), "s.value", "s.page", "s.source", F.lit("field_regex").alias("method"), F.lit(0.7).alias("confidence"))
    version = r"(?:\s*\(?\s*(?:v|version|sp)?\.?\s*\d[\d.]*(?:-i+)?\)?)?"
    named = F.regexp_extract_all("_t", F.lit(rf"(?i)\b(?:{'|'.join(DATABASES)})\b{version}"), F.lit(0))
    each = text.select("doc_id", "page", F.explode_outer(named).alias("name")).where("name IS NOT NULL").select("doc_id", "page", clean_cell(F.col("name")).alias("name"))
    bases = each.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("value"), F.min("page").alias("page"))
    bases = bases.select("doc_id", F.lit("background_database").alias("field"), "value", "page", F.col("value").alias("source"), F.lit("database_names").alias("method"), F.lit(0.8).alias("confidence"))
    out = parts.unionByName(software).unionByName(bases)
    return out if not fields else out.unionByName(dictionary_fields(docs, fields))


def metadata(docs: DataFrame) -> DataFrame:
    """One row per document: labelled fields, wordings, the product's description, its physical properties and mass."""
    base = extract_metadata(docs)
    unit = parse_declared_unit(F.col("declared_unit_raw"))
    declared = base.select("doc_id", unit["quantity"].alias("quantity"), unit["unit"].alias("unit"), unit["dimension"].alias("dimension"), unit["factor"].alias("factor"))
    described = product_descriptions(docs).select("doc_id", F.col("text").alias("product_description"), F.col("page").alias("product_description_page"))
    return base.join(described, "doc_id", "left").join(physical_properties(docs, declared), "doc_id", "left")
