"""Column functions over whole driver tables: every row gets one of some spellings, with the values that they must give.

The spellings and what they mean are written by hand; SQL joins them by number, Spark works them out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, domain, numbers, text, units
from ..sources import files, ilcd, registries
from .driver import ORACLE, QUERIES, t


def _sql(value, kind: str) -> str:
    if value is None:
        return f"NULL::{kind}"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + f"'::{kind}"
    return f"{value}::{kind}"


def cases(name: str, table: str, key: str, schema: str, rows: list[tuple], use: Callable[[Column], list[Column]]) -> None:
    """schema: the types of what is expected, as ``name TYPE`` of DuckDB; use: the functions of a spelling, in that order."""
    outs = [c.split() for c in schema.split(", ")]
    values = ", ".join(f"({k}, {_sql(r[0], 'VARCHAR')}, " + ", ".join(_sql(v, kind) for v, (_, kind) in zip(r[1:], outs, strict=True)) + ")" for k, r in enumerate(rows))
    names = [c for c, _ in outs]
    ORACLE[name] = f"WITH c(k, raw, {', '.join(names)}) AS (VALUES {values}) SELECT {key}, raw, {', '.join(names)} FROM {table} JOIN c ON {key} % {len(rows)} = c.k"

    def query(spark: SparkSession, d: str) -> DataFrame:
        raws = F.array(*[F.lit(r[0]).cast("string") for r in rows])
        picked = t(spark, d, table).select(key, F.get(raws, (F.col(key) % len(rows)).cast("int")).alias("raw"))
        return picked.select(key, "raw", *[c.alias(n) for c, n in zip(use(F.col("raw")), names, strict=True)])

    query.__name__ = name
    QUERIES[name] = query


cases(
    "number_spellings", "lineitem", "l_orderkey", "value DOUBLE",
    [("1,04E+02", 104.0), ("-3.96E+01", -39.6), ("MND", None), ("1 234,5", 1234.5), ("1.234,5", 1234.5), ("1,234.5", 1234.5), ("12*", 12.0), ("3.1E -2", 0.031), ("", None), (None, None), ("−5", -5.0), ("1,2,3", None), ("0,00E+00", 0.0)],
    lambda r: [numbers.parse_number(r)],
)
cases(
    "date_spellings", "orders", "o_orderkey", "iso VARCHAR, ambiguous BOOLEAN, prec VARCHAR",
    [
        ("11/07/2025", "2025-07-11", True, "day"), ("2025-02-30", None, None, None), ("25.12.2023", "2023-12-25", False, "day"), ("12/25/2023", "2023-12-25", False, "day"), ("5 March 2024", "2024-03-05", False, "day"),
        ("March 5, 2024", "2024-03-05", False, "day"), ("juni 2022", "2022-06-01", False, "month"), ("2021", "2021-01-01", False, "year"), ("07.07.21", "2021-07-07", False, "day"), ("soon", None, None, None), (None, None, None, None),
        ("1. oktober 2020", "2020-10-01", False, "day"),
    ],
    lambda r: [dates.parse_date(r)[k].cast("boolean" if k == "ambiguous" else "string") for k in ("iso", "ambiguous", "precision")],
)
cases(
    "unit_spellings", "part", "p_partkey", "unit_key VARCHAR, normal VARCHAR",
    [
        ("kg CO2 eq.", "kg_CO2_eq", "kg_CO2_eq"), ("kg CO2-eqv", "kg_CO2_eq", "kg_CO2_eq"), ("kgCO₂e", "kg_CO2_eq", "kg_CO2_eq"), ("kg CFC11 eq", "kg_CFC11_eq", "kg_CFC11_eq"), ("mol H⁺ eq.", "mol_H+_eq", "mol_H+_eq"),
        ("kg PO43- eq", "kg_PO4_eq", "kg_PO4_eq"), ("m³", "m3", "m3"), ("MJ", "MJ", "MJ"), ("m3 world eq deprived", "m3_world_eq_deprived", "m3_world_eq_deprived"), ("barrel", None, "barrel"), (" pcs ", "piece", "piece"),
        ("kBq U-235 eq.", "kBq_U235_eq", "kBq_U235_eq"), ("Disease incidence", "disease_incidence", "disease_incidence"), ("CTUh", "CTUh", "CTUh"), ("kg equivalent", None, "kg equivalent"), (None, None, None),
    ],
    lambda r: [units.unit_key(r), units.normalize_unit(r)],
)
cases(
    "label_units", "part", "p_partkey", "label VARCHAR, unit VARCHAR",
    [
        ("GWP-total [kg CO2 eq]", "GWP-total", "kg CO2 eq"), ("ODP (kg CFC-11 eq.)", "ODP", "kg CFC-11 eq."), ("Use of net fresh water m3", "Use of net fresh water", "m3"), ("Total use of energy MJ", "Total use of energy", "MJ"),
        ("Ionising radiation kBq U-235 eq", "Ionising radiation", "kBq U-235 eq"), ("Particulate matter [disease incidence]", "Particulate matter", "disease incidence"), ("Ecotoxicity - CTUe", "Ecotoxicity", "CTUe"),
        ("MJ", "MJ", None), ("Product", "Product", None), ("Land use", "Land use", None), ("", "", None), ("Acidification   potential – mol H+ eq", "Acidification potential", "mol H+ eq"),
    ],
    lambda r: [units.split_label_unit(r)[k] for k in ("label", "unit")],
)
cases(
    "pdf_units", "part", "p_partkey", "unit VARCHAR",
    [("kg CO eq 2", "kg CO2 eq"), ("kg CO eq. 2", "kg CO2 eq"), ("kg SO eq 2", "kg SO2 eq"), ("m 3", "m3"), ("kg  N  eq", "kg N eq"), ("", None), (None, None), ("kg CO 2 eq", "kg CO2 eq")],
    lambda r: [units.normalize_pdf_unit(r)],
)
cases(
    "declared_units", "part", "p_partkey", "quantity DOUBLE, unit VARCHAR, dimension VARCHAR, factor DOUBLE",
    [
        ("1 m² of board, 12 mm", 1.0, "m2", "area", 1.0), ("1 tonne of cement", 1.0, "t", "mass", 1000.0), ("1 m3", 1.0, "m3", "volume", 1.0), ("2,5 kg", 2.5, "kg", "mass", 1.0), ("1 piece", 1.0, "piece", "pieces", 1.0),
        ("one piece", None, None, None, None), ("1 square metre", 1.0, "m2", "area", 1.0), ("10 kWh", 10.0, "kwh", "energy", 3.6), (None, None, None, None, None), ("3 pcs", 3.0, "piece", "pieces", 1.0),
    ],
    lambda r: [units.parse_declared_unit(r)[k] for k in ("quantity", "unit", "dimension", "factor")],
)
cases(
    "standard_profiles", "orders", "o_orderkey", "profile VARCHAR, family VARCHAR",
    [
        ("EN 15804:2012+A2:2019, EF 3.1", "EN15804_A2_EF3.1", "EN15804_A2"), ("EN 15804+A2 with EF 3.0", "EN15804_A2_EF3.0", "EN15804_A2"), ("according to EN 15804+A2", "EN15804_A2_UNKNOWN_EF", "EN15804_A2"),
        ("EN 15804:2012+A1:2013", "EN15804_A1_CML", "EN15804_A1"), ("CML baseline", "EN15804_A1_CML", "EN15804_A1"), ("GWP-fossil 1.0", "EN15804_A2_UNKNOWN_EF", "EN15804_A2"), ("ISO 14025", "unresolved", None), (None, "unresolved", None),
    ],
    lambda r: [domain.standard_profile(r), domain.profile_family(domain.standard_profile(r))],
)
cases(
    "missing_values", "lineitem", "l_orderkey", "status VARCHAR",
    [("MND", "not_declared"), ("nd", "not_declared"), ("-", "not_declared"), ("–", "not_declared"), ("MNR", "not_relevant"), ("n/a", "not_applicable"), ("N.A.", "not_applicable"), ("INA", "not_declared"), ("0", None), ("", None), (None, None)],
    lambda r: [domain.missing_status(r)],
)
cases(
    "module_spellings", "lineitem", "l_orderkey", "module VARCHAR, scenario VARCHAR",
    [("Tot.A1-A3", "A1-A3", None), ("C3/2", "C3", "2"), ("C 4", "C4", None), ("A1 – A3", "A1-A3", None), ("D", "D", None), ("Module D", "D", None), ("B6 (scenario 1)", "B6", "1"), ("Raw material supply", "A1", None), ("E1", None, None), (None, None, None), ("c3-b", "C3", "B")],
    lambda r: [domain.module_header(r)[k] for k in ("module", "scenario")],
)
cases(
    "electricity_class", "orders", "o_orderkey", "kind VARCHAR, term VARCHAR",
    [
        ("Electricity by residual mix. A grid mix elsewhere.", "residual_mix", "residual mix"), ("The plant buys wind power with guarantees of origin.", "market_based_specific", "wind power"), ("The national grid mix is used for electricity.", "location_based_grid", "national grid mix"),
        ("A production mix of goods is sold.", None, None), ("", None, None), (None, None, None), ("Solar power, then hydropower, and a residual mix", "residual_mix", "residual mix"), ("power: consumption mix", "location_based_grid", "consumption mix"),
    ],
    lambda r: [domain.electricity_mix(r)[k] for k in ("type", "term")],
)
cases(
    "data_levels", "orders", "o_orderkey", "text_level VARCHAR, subtype_level VARCHAR, maker_level VARCHAR",
    [
        ("An industry-average EPD for a product family", "industry_average", "unknown", "industry_average"), ("generic EPD", "generic", "unknown", "generic"), ("the worst case of several products", "manufacturer_group", "unknown", "manufacturer_group"),
        ("from one production site", "product_specific", "unknown", "product_specific"), ("nothing of this kind", "unknown", "unknown", "product_specific"), ("average dataset", "unknown", "manufacturer_group", "product_specific"),
        ("specific dataset", "product_specific", "product_specific", "product_specific"),
    ],
    lambda r: [domain.data_specificity(r, F.lit(None).cast("string"), F.lit("")), domain.data_specificity(F.lit(""), r, F.lit("")), domain.data_specificity(r, F.lit(""), F.lit("Maker"))],
)
cases(
    "waste_places", "orders", "o_orderkey", "by_text VARCHAR, by_place VARCHAR",
    [
        ("Waste is sent to incineration in Denmark.", "danish", "danish"), ("The landfill is in Germany. Made in Denmark.", "other", "danish"), ("Made in Denmark.", None, "danish"), ("Disposal follows European averages.", "other", "other"), ("", None, None), (None, None, None), ("DK", None, "danish"),
        ("End of life: dansk affald.", "danish", "other"),
    ],
    lambda r: [domain.waste_context(r, F.lit("")), domain.waste_context(F.lit(""), F.when(F.contains(r, F.lit("Denmark")), "Denmark").otherwise(r))],
)
cases(
    "compliance_profiles", "orders", "o_orderkey", "profile VARCHAR",
    [("en 15804+a2 (ef 3.1)", "EN15804_A2_EF3.1"), ("en 15804+a2", "EN15804_A2_UNKNOWN_EF"), ("en 15804+a1", "EN15804_A1_CML"), ("iso 14025", "unresolved"), ("iso 14025|en 15804+a2, ef 3.0", "EN15804_A2_EF3.0"), ("en 15804+a2|en 15804", "EN15804_A1_CML")],
    lambda r: [ilcd.profile_of(F.split(r, r"\|"))],
)
cases(
    "format_signatures", "pages", "page_id", "by_head VARCHAR, by_name VARCHAR",
    [("%PDF-1.7", "pdf", "unknown"), ("PK..", "ilcd_zip", "unknown"), ("  <?xml", "ilcd_xml", "unknown"), ("file.PDF", "unknown", "pdf"), ("a/b.zip", "unknown", "ilcd_zip"), ("x.xml", "unknown", "ilcd_xml"), ("", "unknown", "unknown")],
    lambda r: [files.detect_format(r.cast("binary"), F.lit("none")), files.detect_format(F.lit("?").cast("binary"), r)],
)
cases(
    "code_names", "customer", "c_custkey", "code VARCHAR",
    [("Global warming potential (GWP-total)", "GWP-total"), ("Use of water (FW, net)", "FW"), ("No code", None), ("(A) then (B)", "B"), (" ends ( X ) ", "X"), ("empty ()", None), (None, None)],
    lambda r: [registries.code_of(r)],
)
cases(
    "cell_texts", "customer", "c_custkey", "cell VARCHAR, n_lines INTEGER, normal VARCHAR",
    [("  a \t b\n\nc ", "a b c", 2, "a b c"), ("", "", 0, ""), (None, "", 0, ""), ("GWP–total  CO₂", "GWP–total CO₂", 1, "gwp-total co2"), ("one\r\ntwo\n \nthree", "one two three", 3, "one two three"), ("“Quoted” text", "“Quoted” text", 1, '"quoted" text')],
    lambda r: [text.clean_cell(r), F.size(text.clean_lines(r)), text.normalize_text(r)],
)
cases(
    "sentences", "customer", "c_custkey", "sentence VARCHAR",
    [("First part. Here is wind power used. Last.", "Here is wind power used."), ("wind power only", "wind power only"), ("Head\n\nnext wind power line\n\nend", "next wind power line"), ("A wind power. B.", "A wind power.")],
    lambda r: [text.sentence_around(r, F.instr(r, F.lit("wind power")), F.lit(10))],
)
cases(
    "four_digits", "orders", "o_orderkey", "shown VARCHAR, same BOOLEAN, pages BIGINT",
    [("0.5", "0.5", False, 1), ("123456", "1.235e+05", False, 2470), ("100", "100", False, 2), ("1", "1", True, 1), ("1.0000000001", "1", True, 1), ("0", "0", False, 1)],
    lambda r: [numbers.number_text(r.cast("double")), numbers.same_number(r.cast("double"), F.lit(1.0)), numbers.page_count(F.floor(r.cast("double")), 50)],
)
cases(
    "validity_dates", "orders", "o_orderkey", "published VARCHAR, valid VARCHAR, valid_today BOOLEAN, days_remaining INTEGER",
    [
        ("2020-03-04|2025-03-04", "2020-03-04", "2025-03-04", True, 1889), ("04/03/2018|2017-12-31", "2018-03-04", "2017-12-31", False, -731), ("02/05/2016|05/02/2021", "2016-05-02", "2021-02-05", True, 401),
        ("05/02/2016|02/05/2021", "2016-02-05", "2021-05-02", True, 487), ("none|2019-12-31", None, "2019-12-31", False, -1), ("2019|2020-01-01", "2019-01-01", "2020-01-01", True, 0),
    ],
    lambda r: [
        *[dates.resolve_validity(F.split_part(r, F.lit("|"), F.lit(1)), F.split_part(r, F.lit("|"), F.lit(2)))[k].cast("string") for k in ("published", "valid")],
        *[dates.validity(dates.resolve_validity(F.split_part(r, F.lit("|"), F.lit(1)), F.split_part(r, F.lit("|"), F.lit(2)))["valid"], F.lit("2020-01-01").cast("date"))[k] for k in ("valid_today", "days_remaining")],
    ],
)
cases(
    "blob_names", "pages", "page_id", "blob VARCHAR, record VARCHAR",
    [("ab12", "sources/pdf/ab/ab12.pdf", "records/ab12/v0007.json.gz"), ("EPD 1/2", "sources/pdf/EP/EPD 1/2.pdf", "records/EPD-1-2/v0007.json.gz")],
    lambda r: [files.blob_key("sources", r, ".pdf"), files.record_key(r, F.lit(7))],
)
