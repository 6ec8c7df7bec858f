"""Sections across columns and pages, cover titles, properties with units, and fields by dictionary."""

import json

import pytest
from pyspark.sql import functions as F

from envidecl.schemas import RAW_DOCUMENT
from envidecl.sources import documents as documents_
from envidecl.sources import sections


def word(x, y, text, size=8.0, width=None):
    return {"x0": float(x), "y0": float(y), "x1": float(x + (width or 5 * len(text))), "y1": float(y + size), "text": text}


def page(number, text="", words=(), tables=()):
    return {"page_number": number, "width": 600.0, "height": 800.0, "text": text, "words": list(words), "tables": [{"table_number": 1, "cells": t} for t in tables], "has_text": True}


def documents(spark, *pages_of):
    return spark.createDataFrame([(f"d{k}", list(pages), [{"text": "Title", "size": 20.0, "y0": 10.0}]) for k, pages in enumerate(pages_of)], RAW_DOCUMENT)


def told(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_description_across_columns_and_pages(spark):
    two_columns = [
        word(50, 10, "A heading over the whole page that is wide", width=500), word(50, 30, "Something"), word(50, 700, "Product description:"), word(50, 712, "The panel is made of wood"), word(50, 724, "that was grown and cut"),
        word(320, 30, "in the north of Europe."), word(320, 42, "It is glued."), word(320, 60, "Application"), word(320, 72, "Never read this."),
    ]
    finished = [word(50, 700, "Product definition"), word(50, 712, "A whole sentence ends at the foot of this column."), word(320, 30, "Another matter altogether.")]
    gap = [word(50, 100, "Product description"), word(50, 112, "One paragraph that is long enough to be"), word(50, 180, "far below and not of it")]
    over = [word(50, 700, "Product description"), word(50, 712, "This one goes over to the next page and")]
    docs = documents(
        spark, [page(1, "cover"), page(2, "", two_columns)], [page(1, "", finished)], [page(1, "", gap)], [page(1, "", over), page(2, "", [word(50, 30, "ends there."), word(50, 50, "Packaging")])],
        [page(1, "Produktbeskrivelse\n" + "lang tekst " * 10 + "\nPackaging\nno")], [page(1, "Product description\nshort\nApplication")], [page(1, "Product description\n" + "\n".join("x" * 400 for _ in range(9)))], [page(k, "a") for k in range(1, 7)] + [page(7, "Product description\n" + "too late " * 9)],
    )
    got = told(sections.product_descriptions(docs), "page", "text")
    assert got["d0"] == (2, "The panel is made of wood that was grown and cut in the north of Europe. It is glued.")
    assert got["d1"] == (1, "A whole sentence ends at the foot of this column.")
    assert got["d2"] == (1, "One paragraph that is long enough to be")
    assert got["d3"] == (1, "This one goes over to the next page and ends there.")
    assert got["d4"] == (1, ("lang tekst " * 10).strip())
    assert len(got["d6"][1]) == 4 * 400 + 3 and "d5" not in got and "d7" not in got


def test_cover_titles(spark):
    docs = documents(
        spark, [page(1, "Declaration holder\nValid to\n2030-01-01\nEPD\nRoof panel\nR 200\nMaker A/S\nmore")], [page(1, "Valid until 2030-01-01\nFacade brick\nwww.example.org\nno")], [page(1, "no date here")],
        [page(1, "Expiry date\n01.01.2030\nOne\nTwo\nPublisher\nThree\nFour")], [page(1, None)],
    )
    makers = spark.createDataFrame([("d0", "MAKER A/S")], "doc_id string, manufacturer string")
    assert told(documents_.cover_titles(docs, makers), "title") == {"d0": "Roof panel R 200", "d1": "Facade brick", "d3": "One Two Three"}


@pytest.mark.parametrize(("told_", "wanted", "factor"), [("g/m2", "kg/m2", 0.001), ("g/cm³", "kg/m3", 1000.0), ("kg per m3", "kg/m3", 1.0), ("t/m3", "kg/m3", 1000.0), ("kg/dm3", "kg/m3", 1000.0), ("g/cm2", "kg/m2", 10.0), ("kg/km", "kg/m", 0.001), ("lb", "kg", 0.45359237), ("g", "kg", 0.001), ("N/mm2", "kg/m2", 1.0), ("", "kg/m3", 1.0), ("kg/m2", "kg/m3", 1.0)])
def test_units_of_properties(spark, told_, wanted, factor):
    got = spark.range(1).select(sections.unit_factor(F.lit(told_), F.lit(wanted)).alias("f")).first()["f"]
    assert got == pytest.approx(factor, rel=1e-12)


def test_physical_properties(spark):
    docs = documents(
        spark,
        [page(1, "Gross density: 0.6 g/cm3\nDensity 700 kg/m3\nBulk density 5")],
        [page(1, "", tables=[[["Grammage", "1200", "g/m2"], ["Density", "-3", ""]]])],
        [page(1, "Mass of the declared unit 12,5 kg")],
        [page(1, "Conversion factor to 1 kg: 0.04")],
        [page(1, "nothing here")],
        [page(1, "Weight per piece 250 g\nthe density of 12 things was not measured at all in this long line of text, but 13")],
        [page(1, "Weight per running metre: 2,4 kg/m"), page(2, "Linear density 9 kg/m")],
    )
    units = [("d0", 2.0, "m3", "volume", 1.0), ("d1", 1.0, "m2", "area", 1.0), ("d2", 1.0, "m2", "area", 1.0), ("d3", 1.0, "piece", "pieces", 1.0), ("d4", 2.0, "t", "mass", 1000.0), ("d5", 4.0, "piece", "pieces", 1.0), ("d6", 10.0, "m", "length", 1.0)]
    declared = spark.createDataFrame(units, "doc_id string, quantity double, unit string, dimension string, factor double")
    got = told(sections.physical_properties(docs, declared), "mass_per_declared_unit_kg", "conversion_factor_to_1kg", "mass_formula")
    assert got["d0"] == (1200.0, round(2 / 1200, 8), "m = density × 2 m3")
    assert got["d1"] == (1.2, round(1 / 1.2, 8), "m = grammage × 1 m2")
    assert got["d2"] == (12.5, 0.08, "mass per declared unit reported in the EPD")
    assert got["d3"][:2] == (25.0, 0.04)
    assert got["d4"] == (2000.0, 0.001, "declared unit is a mass (2 t)")
    assert got["d5"] == (1.0, 4.0, "m = weight per piece × 4") and got["d6"][0] == 24.0
    values = {(r["doc_id"], r["property"]): (r["value"], r["page"], r["source"]) for r in sections.property_values(docs).collect()}
    assert values["d0", "density_kg_m3"] == (700.0, 1, "Density 700 kg/m3") and values["d0", "gross_density_kg_m3"][0] == 600.0
    assert ("d1", "density_kg_m3") not in values and values["d1", "grammage_kg_m2"] == (1.2, 1, "Grammage | 1200 | g/m2")


def test_fields_added_by_json_alone(spark, tmp_path):
    fields = {"fields": [
        {"id": "fire_class", "labels": ["Fire class", "Reaction to fire"]}, {"id": "thickness", "labels": ["Thickness"], "kind": "number"}, {"id": "tested", "labels": ["Tested on"], "kind": "date", "pages": 1},
        {"id": "plant", "labels": [], "pattern": "made in ([A-Z][a-z]+)"},
    ]}
    (tmp_path / "fields.json").write_text(json.dumps(fields))
    docs = documents(
        spark, [page(1, "Tested on: 3 May 2024\nIt was made in Aarhus."), page(2, "Reaction to fire: A2-s1,d0", tables=[[["Thickness", "12,5", "mm"]]])], [page(1, "made in Bergen"), page(2, "Tested on: 2024-01-01")], [page(1, None)]
    )
    got = {(r["doc_id"], r["field"]): (r["value"], r["page"], r["method"]) for r in sections.dictionary_fields(docs, sections.read_fields(spark, str(tmp_path / "fields.json"))).collect()}
    assert got["d0", "fire_class"] == ("A2-s1,d0", 2, "line") and got["d0", "tested"][:2] == ("2024-05-03", 1)
    assert got["d0", "plant"] == ("Aarhus", 1, "pattern") and got["d1", "plant"][0] == "Bergen" and ("d1", "tested") not in got
    assert sections.dictionary_fields(docs, []).collect() == []


def test_extended_metadata(spark):
    table = [["Material", "Share"], ["Wood", "80 %"], ["Glue", "15,5 %"], ["Water", "", "4.5%"], ["Rest", "n"]]
    docs = documents(spark, [page(1, "The LCA software used is LCA Maker 10, release 2.\nData: ecoinvent v3.8, GaBi and ecoinvent 3.8 again"), page(2, "", tables=[[["a", "1 %"], ["b", "2 %"]], table])], [page(1, "software")], [page(1, None)])
    got = {(r["doc_id"], r["field"]): (r["value"], r["page"]) for r in sections.extended(docs).collect()}
    assert got["d0", "lca_software"] == ("LCA Maker 10, release 2", 1)
    assert got["d0", "background_database"] == ("GaBi; ecoinvent 3.8; ecoinvent v3.8", 1)
    value, at = got["d0", "product_composition"]
    assert at == 2 and json.loads(value) == [{"component": "Wood", "value": "80.0", "unit": "%"}, {"component": "Glue", "value": "15.5", "unit": "%"}, {"component": "Water", "value": "4.5", "unit": "%"}]
    assert len(got) == 3
