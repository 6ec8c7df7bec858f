"""Scalar functions against tables of expectations."""

import datetime

import pytest
from pyspark.sql import functions as F

from envidecl.functions import dates, domain, numbers, text, units


def apply(spark, f, *values, type_="string"):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {type_}" for n in names))
    return df.select(f(*[F.col(n) for n in names]).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        ("1,04E+02", 104.0), ("-3.96E+01", -39.6), ("MND", None), ("1 850", 1850.0), ("1,234.5", 1234.5), ("1.234,5", 1234.5), ("4.3E-3*", 0.0043),
        ("2.88 E+00", 2.88), ("−1,30E+00", -1.3), ("1,234", 1.234), ("1.234.567", None), ("1,2,3", None), ("1d", None), ("NaN", None), ("", None), (None, None),
        ("7 2)", 7.0), (".5", 0.5),
    ],
)
def test_parse_number(spark, raw, value):
    assert apply(spark, numbers.parse_number, raw) == value


@pytest.mark.parametrize(
    ("raw", "iso", "ambiguous", "precision"),
    [
        ("11/07/2025", "2025-07-11", True, "day"), ("2024-02-30", None, None, None), ("31.12.24", "2024-12-31", False, "day"), ("12/31/2024", "2024-12-31", False, "day"),
        ("5. marts 2021", "2021-03-05", False, "day"), ("March 7, 2020", "2020-03-07", False, "day"), ("mai 2019", "2019-05-01", False, "month"), ("2022", "2022-01-01", False, "year"),
        ("soon", None, None, None), (None, None, None, None),
    ],
)
def test_parse_date(spark, raw, iso, ambiguous, precision):
    got = apply(spark, dates.parse_date, raw)
    if iso is None:
        assert got is None
    else:
        assert (got["iso"], got["ambiguous"], got["precision"]) == (datetime.date.fromisoformat(iso), ambiguous, precision)


def test_validity_prefers_five_years(spark):
    got = apply(spark, dates.resolve_validity, "03/04/2020", "04/03/2025")
    assert str(got["published"]) in ("2020-04-03", "2020-03-04")
    got = apply(spark, dates.resolve_validity, "01/02/2020", "01/02/2025")
    assert (str(got["published"]), str(got["valid"])) == ("2020-02-01", "2025-02-01")


@pytest.mark.parametrize(("raw", "module", "scenario"), [("Tot.A1-A3", "A1-A3", None), ("C3/2", "C3", "2"), ("C4 (S2)", "C4", "2"), ("D - scenario 1", "D", "1"), ("A1 - A3", "A1-A3", None), ("n/a", None, None), (None, None, None)])
def test_module_header(spark, raw, module, scenario):
    got = apply(spark, domain.module_header, raw)
    assert (got["module"], got["scenario"]) == (module, scenario)


def test_match_indicators(spark):
    rows = [("Water use", "EN15804_A2_UNKNOWN_EF", "m3 world eq deprived"), ("Use of net fresh water", "unresolved", "m3"), ("nothing", "unresolved", None), ("Water use", "EN15804_A2_EF3.0", "m3"), ("GWP-total [kg CO2 eq]", "unresolved", "kg CO2-eqv")]
    df = spark.createDataFrame(rows, "label string, profile string, unit string")
    got = {(r["label"], r["unit"]): r["code"] for r in domain.match_indicators(df).collect()}
    assert got[("Water use", "m3 world eq deprived")] == "WDP"
    assert got[("Use of net fresh water", "m3")] == "FW"
    assert got[("nothing", None)] is None
    assert got[("Water use", "m3")] == "FW"
    assert got[("GWP-total [kg CO2 eq]", "kg CO2-eqv")] == "GWP-total"


@pytest.mark.parametrize(("raw", "expected"), [("CO₂–eq  kg", "co2-eq kg"), (None, ""), ("  A B ", "a b"), ("“x”", '"x"')])
def test_normalize_text(spark, raw, expected):
    assert apply(spark, text.normalize_text, raw) == expected


@pytest.mark.parametrize(("raw", "key"), [("kg CO2-eq.", "kg_CO2_eq"), ("kg CO2e", "kg_CO2_eq"), ("kg CFC11 eqv", "kg_CFC11_eq"), ("furlong", None), (None, None)])
def test_unit_key(spark, raw, key):
    assert apply(spark, units.unit_key, raw) == key


def test_units_and_labels(spark):
    assert apply(spark, units.normalize_pdf_unit, "kg CO eq 2") == "kg CO2 eq"
    got = apply(spark, units.split_label_unit, "GWP-total [kg CO2 eq]")
    assert (got["label"], got["unit"]) == ("GWP-total", "kg CO2 eq")
    got = apply(spark, units.parse_declared_unit, "1 m² of board, 12 mm")
    assert (got["quantity"], got["unit"], got["dimension"]) == (1.0, "m2", "area")
    assert apply(spark, units.parse_declared_unit, "one piece") is None


@pytest.mark.parametrize(
    ("raw", "profile"),
    [("EN 15804:2012+A2 with EF 3.1", "EN15804_A2_EF3.1"), ("EN 15804+A2", "EN15804_A2_UNKNOWN_EF"), ("EN 15804+A1", "EN15804_A1_CML"), ("CML 2001", "EN15804_A1_CML"), ("mol H+ eq", "EN15804_A2_UNKNOWN_EF"), ("", "unresolved"), (None, "unresolved")],
)
def test_standard_profile(spark, raw, profile):
    assert apply(spark, domain.standard_profile, raw) == profile


def test_classifiers(spark):
    assert apply(spark, domain.electricity_mix, "We use green electricity and the residual mix.")["type"] == "residual_mix"
    assert apply(spark, domain.electricity_mix, "nothing here") is None
    assert apply(spark, domain.data_specificity, "worst case of an industry-wide study", None, None) == "industry_average"
    assert apply(spark, domain.data_specificity, "", None, "Maker") == "product_specific"
    assert apply(spark, domain.waste_context, "At the end of life, waste goes to Danish incineration.", None) == "danish"
    assert apply(spark, domain.waste_context, "", "DE") == "other"
    assert apply(spark, domain.language_vote, "the house and the garden of the man is for the dog")["language"] == "English"
    assert apply(spark, domain.missing_status, "MNR") == "not_relevant"


def test_identifiers(spark):
    assert apply(spark, text.slug, "Kübel & Söhne  GmbH--") == "K-bel-S-hne-GmbH"
    assert apply(spark, text.record_uid, "md-99999-en", None, None, "x") == "MD-99999-EN"
    assert apply(spark, text.record_uid, "none", "ABC", None, "x") == "ilcd-abc"
    assert apply(spark, text.record_uid, None, None, None, "x").startswith("rec-")
