"""Pages of our own making through the document readers."""

from pyspark.sql import functions as F

from envidecl.schemas import RAW_DOCUMENT
from envidecl.sources import documents
from envidecl.sources import layout as L


def w(text, x, y, width=None):
    return {"x0": float(x), "x1": float(x + (width or 5 * len(text))), "y0": float(y), "y1": float(y + 8), "text": text}


def docs(spark):
    cover = "EPD-IBU-20250344\nOwner of the declaration\nTest A/S\nDeclared unit: 1 m2 of panel\nReference service life (RSL) is 40 years.\nDeclaration number MD-12345-EN\nEN 15804+A2"
    words = [w("Owner", 10, 100), w("of", 40, 100), w("the", 55, 100), w("declaration", 75, 100), w("Test", 10, 112), w("A/S", 35, 112), w("internally", 10, 200), w("x", 90, 200), w("externally", 100, 200)]
    table = [["Indicator", "Unit", "A1", "A2", "A3", "C3/1", "D"], ["GWP-total", "kg CO2 eq", "1,5E+01", "2.0", "MND", "3", ""], [None, None, None, None, None, None, None], ["Ozone depletion", "kg CFC-11 eq", "1E-6", "", "", "", "-2E-7"]]
    marks = [["A1", "A2", "A3", "A4", "A5", "B1"], ["X", "X", "X", "MND", "ND", "?"]]
    page1 = {"page_number": 1, "width": 1.0, "height": 1.0, "text": cover, "words": words, "tables": [], "has_text": True}
    page2 = {"page_number": 2, "width": 1.0, "height": 1.0, "text": "", "words": [w("GWP-total", 0, 0)], "tables": [{"table_number": 1, "cells": table}, {"table_number": 2, "cells": marks}], "has_text": True}
    head = [w("A1", 100, 10), w("A2", 150, 10), w("A3", 200, 10)]
    body = [w("Net", 5, 30), w("use", 22, 30), w("of", 40, 30), w("fresh", 5, 42), w("water", 32, 42), w("m3", 60, 42), w("0.5", 100, 42), w("-", 148, 42, 3), w("1", 152, 42), w("ND", 200, 42)]
    page3 = {"page_number": 3, "width": 1.0, "height": 1.0, "text": "", "words": head + body, "tables": [], "has_text": True}
    title = [{"text": "Roof  panel", "size": 20.0, "y0": 1.0}, {"text": "small", "size": 9.0, "y0": 2.0}]
    return spark.createDataFrame([("d", [page1, page2, page3], title), ("empty", [], [])], RAW_DOCUMENT)


def test_facts_from_tables_and_words(spark):
    profiles = spark.createDataFrame([("d", "EN15804_A2_UNKNOWN_EF")], "doc_id string, profile string")
    got = {(r["indicator"], r["module"], r["scenario"]): (r["value"], r["status"], r["method"]) for r in documents.extract_facts(docs(spark), profiles).collect()}
    assert got[("GWP-total", "A1", None)] == (15.0, "declared", "pdf_table")
    assert got[("GWP-total", "A3", None)] == (None, "not_declared", "pdf_table")
    assert got[("GWP-total", "C3", "1")] == (3.0, "declared", "pdf_table") and ("GWP-total", "D", None) not in got
    assert got[("ODP", "D", None)] == (-2e-7, "declared", "pdf_table")
    assert got[("FW", "A1", None)] == (0.5, "declared", "pdf_words") and got[("FW", "A2", None)][0] == -1.0
    assert got[("FW", "A3", None)] == (None, "not_declared", "pdf_words")


def test_declarations_and_metadata(spark):
    d = docs(spark)
    marks = {r["module"]: r["declared"] for r in documents.extract_declarations(d).collect()}
    assert marks == {"A1": "X", "A2": "X", "A3": "X", "A4": "MND", "A5": "ND"}
    rows = {r["doc_id"]: r for r in documents.extract_metadata(d).collect()}
    got = rows["d"]
    assert (got["registration_number"], got["manufacturer"], got["product_name"]) == ("MD-12345-EN", "Test A/S", "Roof panel")
    assert (got["declared_unit_raw"], got["reference_service_life_years"], got["verification"]) == ("1 m2", 40.0, "external")
    assert rows["empty"]["registration_number"] is None


def test_records_of_documents(spark):
    """From pages to summary rows in one run."""
    from envidecl.operators import assemble, results, search

    records, facts = assemble.from_documents(docs(spark))
    rows = {r["epd_uid"]: r for r in records.collect()}
    assert len(rows) == 2
    row = rows["MD-12345-EN"]
    md = row["metadata"]
    assert (md["product_name"], md["standard_profile"], md["standard"], md["reference_service_life_years"], md["verification"], row["source_format"]) == ("Roof panel", "EN15804_A2_UNKNOWN_EF", "EN 15804+A2", 40.0, "external", "pdf")
    assert row["declared"] == {"A1": "X", "A2": "X", "A3": "X", "A4": "MND", "A5": "ND"}
    slots = {(r["indicator"], r["module"], r["scenario"]): r["value"] for r in facts.collect()}
    assert slots[("GWP-total", "A1", "")] == 15.0 and slots[("GWP-total", "C3", "1")] == 3.0
    assert {(r["indicator"], r["module"], r["scenario"]): r["value"] for r in results.flatten(records).collect()} == slots
    d = assemble.derive(records)
    step1 = {r["epd_uid"]: r for r in d.step1.collect()}["MD-12345-EN"]
    assert (step1["core_standard"], step1["third_party_verification"], step1["programme_operator"], step1["life_cycle_modules"]) == ("pass", "warning", "pass", "fail")
    hit = search.search(d.summary, text="roof panel").collect()
    assert [(r["epd_uid"], r["category"], r["declared_unit_code"], r["rsl_years"]) for r in hit] == [("MD-12345-EN", "roof", "m2", 40.0)]


def test_layout():
    words = [L.Box("a", 0, 5, 0, 8), L.Box("b", 40, 45, 1, 9), L.Box("c", 2, 6, 12, 20), L.Box("d", 7, 9, 12, 20)]
    assert [[x.text for x in line] for line in L.lines(words)] == [["a", "b"], ["c", "d"]]
    seg = L.segments(words)
    assert [s.text for s in seg] == ["a", "b", "c d"] and L.below(seg, seg[0]).text == "c d" and L.below(seg, seg[1]) is None
    heads = L.module_headings([L.Box("A1-", 0, 10, 0, 8), L.Box("A3", 11, 20, 0, 8), L.Box("C4", 60, 70, 0, 8)])
    assert [(m, s) for _, m, s in heads] == [("A1-A3", None), ("C4", None)]


def test_mass(spark):
    row = spark.createDataFrame([(2.0, "m2", 12.5)], "q double, u string, g double")
    none = F.lit(None).cast("double")
    assert row.select(documents.mass_per_unit(F.col("q"), F.col("u"), none, none, F.col("g"), none, none, none).alias("m")).first()["m"] == 25.0
