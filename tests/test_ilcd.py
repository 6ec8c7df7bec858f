"""Process and flow datasets of our own making, with two prefixes and two scenarios."""

from pyspark.sql import functions as F

from envidecl.sources import ilcd

PROCESS = """<processDataSet xmlns:common="c" xmlns:epd="e"><processInformation><dataSetInformation><common:UUID>AAAA-1</common:UUID>
<name><baseName xml:lang="de">Balken</baseName><baseName xml:lang="en">Timber beam</baseName></name>
<classificationInformation><common:classification><common:class level="0">Wood</common:class></common:classification></classificationInformation>
<common:other><epd:referenceServiceLife epd:years="100"/></common:other></dataSetInformation>
<quantitativeReference><referenceToReferenceFlow>0</referenceToReferenceFlow></quantitativeReference>
<time><common:referenceYear>2020</common:referenceYear><common:dataSetValidUntil>2026</common:dataSetValidUntil></time></processInformation>
<modellingAndValidation><validation><review type="Independent external review"/></validation><complianceDeclarations><compliance>
<common:referenceToComplianceSystem><common:shortDescription>EN 15804+A2 (EF 3.0)</common:shortDescription></common:referenceToComplianceSystem></compliance></complianceDeclarations></modellingAndValidation>
<exchanges><exchange dataSetInternalID="0"><referenceToFlowDataSet refObjectId="FLOW-1"/><meanAmount>2.0</meanAmount></exchange>
<exchange dataSetInternalID="1"><referenceToFlowDataSet refObjectId="I-2"/><common:other><epd:amount epd:module="A1-A3">7</epd:amount></common:other></exchange></exchanges>
<LCIAResults><LCIAResult><referenceToLCIAMethodDataSet refObjectId="I-1"/><common:other><epd:amount epd:module="A1-A3">-10.5</epd:amount>
<epd:amount epd:module="C3" epd:scenario="S1">1.5</epd:amount><epd:amount epd:module="C3" epd:scenario="S2">ND</epd:amount></common:other></LCIAResult>
<LCIAResult><referenceToLCIAMethodDataSet refObjectId="UNKNOWN"/><common:other><epd:amount epd:module="D">1</epd:amount></common:other></LCIAResult></LCIAResults></processDataSet>"""
FLOW = f"""<flowDataSet><flowInformation><UUID>flow-1</UUID><quantitativeReference><referenceToReferenceFlowProperty>1</referenceToReferenceFlowProperty></quantitativeReference>
<MatML_Doc><Material><BulkDetails><PropertyData property="pr1"><Data format="float">0.02</Data></PropertyData><PropertyData property="pr2"><Data>450</Data></PropertyData><PropertyData property="pr3"><Data>none</Data></PropertyData></BulkDetails></Material>
<Metadata><PropertyDetails id="pr1"><Name>layer thickness</Name></PropertyDetails><PropertyDetails id="pr2"><Name>Gross Density</Name></PropertyDetails><PropertyDetails id="pr3"><Name>grammage</Name></PropertyDetails></Metadata></MatML_Doc></flowInformation><flowProperties><flowProperty dataSetInternalID="0">
<referenceToFlowPropertyDataSet refObjectId="{ilcd.MASS}"/><meanValue>450</meanValue></flowProperty>
<flowProperty dataSetInternalID="1"><referenceToFlowPropertyDataSet refObjectId="{ilcd.VOLUME}"/><meanValue>1.0</meanValue></flowProperty></flowProperties></flowDataSet>"""


def test_process_with_flow(spark):
    members = spark.createDataFrame([("z", "p.xml", PROCESS), ("z", "f.xml", FLOW)], "archive string, member string, xml string")
    p = ilcd.processes(members)
    row = ilcd.with_flows(p, ilcd.flows(members)).withColumn("profile", ilcd.profile_of(F.col("compliance"))).first()
    assert (row["uuid"], row["product_name"], row["reference_service_life_years"], row["valid_until"]) == ("aaaa-1", "Timber beam", 100.0, "2026-12-31")
    assert (row["reference_flow"], row["mass_per_declared_unit_kg"], row["verification"], row["profile"]) == ("flow-1", 900.0, "external", "EN15804_A2_EF3.0")
    assert (row["declared_unit_raw"], row["layer_thickness_m"], row["gross_density_kg_m3"], row["grammage_kg_m2"]) == ("2 m3", 0.02, 450.0, None)
    facts, unknown = ilcd.facts(ilcd.amounts(p), ilcd.registry(spark, [("I-1", "GWP-total", "kg CO2 eq"), ("i-2", "PERT", "MJ")]))
    got = {(r["indicator"], r["module"], r["scenario"]): (r["value"], r["status"]) for r in facts.collect()}
    assert got == {
        ("GWP-total", "A1-A3", ""): (-10.5, "declared"), ("GWP-total", "C3", "S1"): (1.5, "declared"), ("GWP-total", "C3", "S2"): (None, "not_declared"), ("PERT", "A1-A3", ""): (7.0, "declared"),
    }
    assert unknown.first()["unknown_indicators"] == ["unknown"]
    assert {r["module"] for r in ilcd.declarations(facts).collect()} == {"A1-A3", "C3"}


def test_records_of_processes(spark):
    """Default scenarios fill slots, compliance systems decide by id, and the whole becomes records."""
    from envidecl.operators import assemble, results

    xml = PROCESS.replace("<common:other><epd:referenceServiceLife", '<common:other><epd:scenario epd:name="S1"/><epd:scenario epd:name="S2" epd:default="true"/><epd:referenceServiceLife')
    xml = xml.replace('epd:scenario="S2">ND<', 'epd:scenario="S2">4.5<').replace("<common:referenceToComplianceSystem>", '<common:referenceToComplianceSystem refObjectId="SYS-1">')
    members = spark.createDataFrame([("z", "p.xml", xml), ("z", "f.xml", FLOW)], "archive string, member string, xml string")
    p = ilcd.processes(members)
    assert [(r["scenario"], r["is_default"]) for r in ilcd.scenarios(p).collect()] == [("S1", False), ("S2", True)]
    assert ilcd.profiles(p).first()["standard_profile"] == "EN15804_A2_EF3.0"
    systems = spark.createDataFrame([("sys-1", "EN15804_A2_EF3.1")], "system_uuid string, system_profile string")
    assert ilcd.profiles(p, systems).first()["standard_profile"] == "EN15804_A2_EF3.1"
    registry = ilcd.registry(spark, [("I-1", "GWP-total", "kg CO2 eq"), ("i-2", "PERT", "MJ")])
    records, facts = assemble.from_ilcd(members, registry, systems)
    row = records.first()
    assert (row["epd_uid"], row["metadata"]["standard_profile"], row["metadata"]["standard"], row["metadata"]["reference_service_life_years"]) == ("ilcd-aaaa-1", "EN15804_A2_EF3.1", "EN 15804+A2", 100.0)
    slots = {(r["indicator"], r["module"], r["scenario"]): r["value"] for r in facts.collect()}
    assert slots == {("GWP-total", "A1-A3", ""): -10.5, ("GWP-total", "C3", ""): 4.5, ("GWP-total", "C3", "S1"): 1.5, ("GWP-total", "C3", "S2"): 4.5, ("PERT", "A1-A3", ""): 7.0}
    assert {(r["indicator"], r["module"], r["scenario"]): r["value"] for r in results.flatten(records).collect()} == slots
    d = assemble.derive(records)
    summary, step1 = d.summary.first(), d.step1.first()
    assert (summary["category"], summary["gwp_a1_a3"], summary["source_format"], step1["third_party_verification"], step1["life_cycle_modules"]) == ("timber", -10.5, "ilcd_xml", "pass", "warning")


def test_records_of_files(spark, tmp_path):
    """Archives, single datasets and files of other formats from a folder, and facts as CSV."""
    import zipfile

    from envidecl.operators import assemble
    from envidecl.sources import files

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("processes/p.xml", PROCESS), z.writestr("flows/f.xml", FLOW), z.writestr("note.txt", "no")
    (tmp_path / "b.xml").write_text(PROCESS.replace("AAAA-1", "BBBB-2"))
    (tmp_path / "c.bin").write_bytes(b"?")
    registry = ilcd.registry(spark, [("I-1", "GWP-total", "kg CO2 eq"), ("i-2", "PERT", "MJ")])
    records, facts, other = assemble.from_files(files.read_files(spark, f"file://{tmp_path}"), registry)
    rows = {r["epd_uid"]: r["metadata"]["mass_per_declared_unit_kg"] for r in records.collect()}
    assert rows == {"ilcd-aaaa-1": 900.0, "ilcd-bbbb-2": None}
    assert [r["path"].rsplit("/", 1)[1] for r in other.collect()] == ["c.bin"]
    files.write_results_csv(facts, f"file://{tmp_path}/out")
    text = next((tmp_path / "out").glob("part-*.csv")).read_text(encoding="utf-8-sig").splitlines()
    assert text[0].split(",")[:3] == ["epd_uid", "indicator", "module"] and len(text[0].split(",")) == 15


def test_all_processes_of_an_archive_are_read(spark, monkeypatch):
    from envidecl.plans import datasets

    from .conftest import SF

    n = 505
    members = spark.range(n).select(F.lit("z").alias("archive"), F.format_string("%04d", "id").alias("member"), F.concat(F.lit("<processDataSet><UUID>P"), F.col("id").cast("string"), F.lit("</UUID></processDataSet>")).alias("xml"))
    assert ilcd.processes(members).select("uuid").distinct().count() == n

    def cut(*_):
        raise AssertionError("members are left out")

    monkeypatch.setattr(ilcd, "_first", cut)
    for query in (datasets.ilcd_processes, datasets.ilcd_compliance):
        query(spark, SF)
