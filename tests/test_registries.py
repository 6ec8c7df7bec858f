from pyspark.sql import functions as F

from envidecl.operators import views
from envidecl.sources import registries as R


def test_indicator_lists(spark, tmp_path):
    a, b = "a" * 8 + "-aaaa-aaaa-aaaa-" + "a" * 12, "b" * 8 + "-bbbb-bbbb-bbbb-" + "b" * 12
    (tmp_path / "one.csv").write_text(f"﻿UUID;Name;Unit\n{a};Global warming (GWP-total);kg CO2 eq\nnone;x;y\n{b.upper()};Use of net fresh water (FW, net);m3\n")
    one = R.indicators(spark, f"file://{tmp_path}/one.csv", "A2")
    got = {r["uuid"]: (r["code"], r["kind"]) for r in one.collect()}
    assert got == {a: ("GWP-total", "lcia"), b: ("FW", "flow")}
    both = R.registry([one, one.withColumn("profile", F.lit("A1")).where("kind = 'flow'")])
    assert {r["uuid"]: r["profiles"] for r in both.collect()} == {a: ["A2"], b: ["A2", "A1"]}
    earlier = spark.createDataFrame([(a, "GWP"), ("gone", "X")], "uuid string, code string")
    assert {(r["uuid"], r["problem"]) for r in R.registry_gaps(both, earlier).collect()} == {(a, "code differs"), ("gone", "missing")}


def test_xml_and_trees(spark):
    xml = "<g xmlns:c='c'><c:UUID>U1</c:UUID><referenceToReferenceUnit>1</referenceToReferenceUnit><units><unit dataSetInternalID='0'><name>g</name><meanValue>0.001</meanValue></unit><unit dataSetInternalID='1'><name>kg</name><meanValue>1</meanValue></unit></units></g>"
    got = {r["unit"]: (r["factor"], r["reference_unit"]) for r in R.conversions(R.unit_groups(spark.createDataFrame([(xml,)], "xml string"))).collect()}
    assert got == {"g": (0.001, "kg"), "kg": (1.0, "kg")}
    xsd = '<xs:schema><xs:simpleType name="T"><xs:enumeration value="a"/><xs:enumeration value="b"/></xs:simpleType></xs:schema>'
    assert [(r["type"], r["value"]) for r in R.enumerations(spark.createDataFrame([(xsd,)], "xml string")).orderBy("ord").collect()] == [("T", "a"), ("T", "b")]
    nodes = spark.createDataFrame([("1", None, "Minerals"), ("1.1", "1", "Cement"), ("1.1.1", "1.1", "White")], "id string, parent string, name string")
    assert {r["id"]: r["path"] for r in R.category_paths(nodes).collect()}["1.1.1"] == "Minerals / Cement / White"
    lines = spark.createDataFrame([("| **Name** | Id | Unit | C |",), ("|---|---|---|---|",), ("| density | gd | kg/m3 | a<br>b |",)], "value string")
    assert [tuple(r) for r in R.property_table(lines).collect()] == [("density", "gd", "kg/m3", "a b")]
    want = spark.createDataFrame([("a/b",), ("flowDataSet/x",), ("c",)], "path string")
    assert [r["path"] for r in R.missing_fields(want, spark.createDataFrame([("c",)], "path string")).collect()] == ["a/b"]


def test_migration_keeps_what_is_there(spark):
    rows = spark.createDataFrame([("1.1", "01/02/2020", "01/02/2025", "1 m2", "x.PDF", None), ("2.0", None, None, None, "y", "kg")], "schema_version string, publication_date string, valid_until string, declared_unit_raw string, source_file string, declared_unit string")
    a, b = views.migrate(rows).collect()
    assert (a["valid_until_iso"], a["declared_unit"], a["source_format"], a["migrated_from_schema"]) == ("2025-02-01", "m2", "pdf", "1.1")
    assert (b["declared_unit"], b["migrated_from_schema"], b["schema_version"]) == ("kg", None, "2.0")
    assert views.categories(spark).count() == 20 and views.operators(spark).count() > 5
