"""One declaration from record to search, and the facts' rules on small tables."""

import datetime
import json

from pyspark.sql import functions as F

from envidecl.operators import results, rules, search
from envidecl.operators.store import Store
from envidecl.schemas import FACT_RESULT, RECORD


def value(v, status="declared", **kw):
    base = dict.fromkeys(("provenance", "raw_value", "raw_unit", "raw_indicator_label", "raw_module_header", "source_page", "source_table", "confidence", "extraction_method", "scenario", "note", "human_edited"))
    return {"value": v, "status": status, **base, **kw}


def record(spark):
    fields = "registration_number product_name manufacturer programme_operator declared_unit_raw standard_profile standard publication_date valid_until reference_service_life_years mass_per_declared_unit_kg conversion_factor_to_1kg pcr product_category product_description ilcd_classification ilcd_subtype geographical_scope verification language uuid".split()
    md = dict.fromkeys(fields) | {
        "registration_number": "MD-99999-EN", "product_name": "Test concrete C30/37", "manufacturer": "Test A/S", "declared_unit_raw": "1 m3",
        "standard_profile": "EN15804_A2_UNKNOWN_EF", "standard": "EN 15804+A2",
    }
    gwp = {"method_profile": None, "canonical_unit": "kg CO2 eq", "modules": {"A1-A3": value(250.0), "D": value(-5.0)}, "scenario_modules": {"C4": {"1": value(3.0)}, "D": {"": value(9.0)}}}
    row = {"epd_uid": "MD-99999-EN", "metadata": md, "results": {"GWP-total": gwp}, "declared": {"A1-A3": "X"}, "source_format": "pdf", "file_sha256": "f" * 64, "full_text": "ready-mixed concrete C30/37 EPD Danmark"}
    return spark.createDataFrame([row], RECORD)


def facts(spark, rows):
    names = [c.split()[0] for c in FACT_RESULT.split(", ")]
    full = [dict.fromkeys(names) | {"epd_uid": "e", "indicator": "GWP-total", "scenario": "", "unit": "kg CO2 eq", "human_edited": False} | r for r in rows]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], FACT_RESULT)


def test_record_to_search_and_store(spark, tmp_path):
    records = record(spark)
    long = results.flatten(records)
    slots = {(r["module"], r["scenario"]): r["value"] for r in long.collect()}
    assert slots == {("A1-A3", ""): 250.0, ("D", ""): -5.0, ("C4", "1"): 3.0}
    classified = rules.classify(records)
    assert classified.first()["category"] == "concrete"
    checked = rules.step1(records, long)
    got = checked.first()
    assert (got["core_standard"], got["life_cycle_modules"], got["programme_operator"]) == ("pass", "warning", "pass")
    assert got["mandatory_ok"] is False and got["worst"] == "missing"
    summary = rules.summarize(records, long, checked, classified)
    hit = search.search(summary, text="concrete").collect()
    assert len(hit) == 1 and (hit[0]["gwp_a1_a3"], hit[0]["gwp_d"], hit[0]["category_id"]) == (250.0, -5.0, "concrete")
    assert search.search(summary, text="timber").count() == 0
    report = rules.validate(records, long, classified, F.lit("2026-01-01").cast("date")).first()
    assert report["errors"] == [] and "a1_a3_sum" not in report["warnings"]

    store = Store(spark, str(tmp_path / "store"))
    batch = records.select("epd_uid", F.sha2(F.to_json("metadata"), 256).alias("content_hash"), F.to_json(F.struct("epd_uid", "file_sha256")).alias("record"))
    assert [r["status"] for r in store.save(batch).collect()] == ["created"]
    assert [r["status"] for r in store.save(batch).collect()] == ["unchanged"]
    changed = batch.withColumn("content_hash", F.lit("other"))
    assert [(r["status"], r["version"]) for r in store.save(changed).collect()] == [("updated", 2)]
    several = spark.createDataFrame([("n", "h2", "b", 2), ("n", "h1", "a", 1), ("n", "h1", "a", 3), ("n", "h1", "a", 4)], "epd_uid string, content_hash string, record string, ord int")
    assert sorted((r["version"], r["status"]) for r in store.save(several).collect()) == [(1, "created"), (2, "updated"), (3, "unchanged"), (3, "updated")]
    assert [r["content_hash"] for r in store.versions().where("epd_uid = 'n'").orderBy("version").collect()] == ["h1", "h2", "h1"]
    store.archive(batch)
    assert store.current(include_archived=False).where("epd_uid <> 'n'").count() == 0
    assert store.versions().where("epd_uid <> 'n'").count() == 2 and store.rebuild().where("epd_uid <> 'n'").first()["version"] == 2
    assert store.find_by_sha("f" * 64).count() == 1
    store.set_meta("k", "1"), store.set_meta("k", "2")
    assert store.get_meta("k") == "2" and store.get_meta("none") is None
    blob = spark.createDataFrame([("a", "s1", 1, "t", "n", datetime.datetime(2024, 1, 1))], "key string, sha256 string, size long, content_type string, original_name string, created_at timestamp")
    store.register_blobs(blob), store.register_blobs(blob.withColumn("sha256", F.lit("s2")))
    assert [r["sha256"] for r in store.blobs().collect()] == ["s1"]


def test_product_stage_and_modes(spark):
    rows = spark.createDataFrame([(10.0, 1.0, 1.0, 1.0), (None, 1.0, 2.0, 3.0), (None, 1.0, None, 3.0)], "t double, a double, b double, c double")
    got = [tuple(r["s"]) for r in rows.select(results.product_stage(*map(F.col, "tabc")).alias("s")).collect()]
    assert got == [(10.0, "reported"), (6.0, "calculated_from_split"), (None, None)]


def test_reporting_helper(spark):
    row = spark.createDataFrame([(10.0, None, None, 1.0, None, 30.0)], "t double, a4 double, a5 double, c3 double, c4 double, life double")
    got = row.select(results.reporting_helper(*map(F.col, ("t", "a4", "a5", "c3", "c4", "life"))).alias("h")).first()["h"]
    assert (got["replacements"], got["b4"], got["total"], got["per_year"], got["missing"]) == (1, 11.0, 22.0, 0.44, ["A4", "A5", "C4"])


def test_merge_edits_and_checks(spark):
    a = facts(spark, [{"module": "A1", "value": None, "status": "not_declared"}, {"module": "A2", "value": 2.0, "status": "declared"}])
    b = facts(spark, [{"module": "A1", "value": 9.0, "status": "declared"}, {"module": "A3", "value": 3.0, "status": "declared"}])
    merged = {r["module"]: r["value"] for r in results.merge(a, b).collect()}
    assert merged == {"A1": None, "A2": 2.0, "A3": 3.0}
    edits = spark.createDataFrame([("e", "GWP-total", "A2", "", 5.0), ("e", "GWP-total", "B1", "", 1.0)], "epd_uid string, indicator string, module string, scenario string, value double")
    got = {r["module"]: r for r in results.apply_edits(a, edits).collect()}
    assert (got["A2"]["value"], got["A2"]["raw_value"], got["A2"]["provenance"]) == (5.0, "2.0", "human_edited")
    assert (got["B1"]["value"], got["B1"]["provenance"], got["B1"]["human_edited"]) == (1.0, "human_entered", True)
    assert got["A1"]["human_edited"] is False
    off = facts(spark, [{"module": m, "value": v} for m, v in (("A1", 1.0), ("A2", 1.0), ("A3", 1.0), ("A1-A3", 4.0))])
    assert rules.sum_check(off).count() == 1
    parts = facts(spark, [{"module": "A4", "indicator": i, "value": v} for i, v in (("GWP-total", 10.0), ("GWP-fossil", 5.0), ("GWP-biogenic", 1.0), ("GWP-luluc", 1.0))])
    assert [r["module"] for r in rules.component_check(parts).collect()] == ["A4"]
    unit = facts(spark, [{"module": "A4", "value": 1.0, "raw_unit": "MJ"}, {"module": "D", "value": 1.0, "raw_unit": "kg CO2-eqv."}, {"module": "C1", "value": 1.0, "raw_unit": "??"}])
    assert [r["raw_unit"] for r in rules.unit_check(unit).collect()] == ["MJ"]
    kept, dropped = results.retain(parts, ["GWP-total"])
    assert kept.count() == 1 and dropped.first()["dropped_indicators"] == ["GWP-biogenic", "GWP-fossil", "GWP-luluc"]
    spine = results.module_frame(spark.createDataFrame([("e", "A4", "X")], "epd_uid string, module string, declared string"), parts)
    assert spine.count() == 18 and spine.where("module = 'A1'").first()["scope"] == "mandatory"


def test_pages_cover_the_result_once(spark):
    rows = spark.createDataFrame([(str(k), None if k % 3 == 0 else float(k % 5)) for k in range(23)], "epd_uid string, gwp_a1_a3 double")
    seen = [r["epd_uid"] for k in range(0, 30, 7) for r in search.page(rows, "gwp_a1_a3", 7, k, descending=True).collect()]
    assert sorted(seen, key=int) == [str(k) for k in range(23)]
    assert seen[-1] == "9" or rows.where("gwp_a1_a3 IS NULL").count() == 8
    assert search.facts_of(facts(spark, [{"module": "A1"}]), []).count() == 0


def test_bundle_and_formats(spark, tmp_path):
    from envidecl.sources import files

    rows = spark.createDataFrame([("u1", json.dumps({"epd_uid": "u1"}))], "epd_uid string, record string")
    files.write_bundle(rows, f"file://{tmp_path}/b")
    read = files.read_files(spark, f"file://{tmp_path}/b", "part-*")
    assert read.first()["format"] == "ilcd_zip"
    assert [json.loads(r["record"])["epd_uid"] for r in files.bundle_records(read).collect()] == ["u1"]
    kinds = spark.createDataFrame([(bytearray(b"%PDF-1.7"), "a.xml"), (bytearray(b"  <?xml"), "x"), (bytearray(b"PK.."), "y"), (bytearray(b"?"), "z")], "c binary, n string")
    assert [r["f"] for r in kinds.select(files.detect_format(F.col("c"), F.col("n")).alias("f")).collect()] == ["pdf", "ilcd_xml", "ilcd_zip", "unknown"]


def test_stream_reconciles_once(spark, tmp_path):
    from envidecl.streaming.reconcile import reconcile

    src = tmp_path / "docs"
    src.mkdir()
    doc = lambda v: json.dumps({"epd_uid": "u", "version": v, "saved_at": "2024-01-01T00:00:00Z", "content_hash": f"h{v}", "note": "", "record": "{}"})
    (src / "1.json").write_text(doc(1) + "\n" + doc(3) + "\n")
    store = Store(spark, str(tmp_path / "s"))
    reconcile(store, str(src), str(tmp_path / "cp")).awaitTermination(60)
    (src / "2.json").write_text(doc(2) + "\n")
    reconcile(store, str(src), str(tmp_path / "cp")).awaitTermination(60)
    assert [r["version"] for r in store.versions().collect()] == [3]


def test_edits_and_derived_blocks(spark):
    from envidecl.operators import assemble

    records = record(spark)
    edits = spark.createDataFrame([("MD-99999-EN", "manufacturer", "Other A/S"), ("MD-99999-EN", "standard", "EN 15804+A2"), ("MD-99999-EN", "valid_until", ""), ("MD-99999-EN", "reference_service_life_years", "60"), ("x", "manufacturer", "no")], "epd_uid string, field string, value string")
    edited, log = assemble.edit_fields(records, edits)
    row = edited.first()
    assert (row["metadata"]["manufacturer"], row["metadata"]["reference_service_life_years"], row["metadata"]["product_name"]) == ("Other A/S", 60.0, "Test concrete C30/37")
    assert {(r["field"], r["original"]) for r in log.collect()} == {("manufacturer", "Test A/S"), ("reference_service_life_years", None)}
    before, after = assemble.derive(records), assemble.derive(edited)
    assert (before.step1.first()["reference_service_life"], after.step1.first()["reference_service_life"]) == ("missing", "pass")
    assert search.search(after.summary, text="other").count() == 1 and search.search(before.summary, text="other").count() == 0
    told = {r["parameter"]: r for r in after.report.collect()}
    assert len(told) == 13 and json.loads(told["reference_service_life"]["value"]) == {"years": 60.0} and told["life_cycle_modules"]["message"]
    assert json.loads(told["life_cycle_modules"]["value"]) == {"available": ["A1-A3", "D"]}
    chosen = assemble.derive(edited, overrides=spark.createDataFrame([("MD-99999-EN", "wall")], "epd_uid string, chosen string"))
    assert chosen.summary.first()["category"] == "wall"
    summary = after.summary.first()
    assert (summary["declared_quantity"], summary["declared_unit_code"], summary["gwp_indicator"], summary["gwp_a1_a3"], summary["gwp_a1_a3_provenance"], summary["rsl_years"]) == (1.0, "m3", "GWP-total", 250.0, "reported", 60.0)
    assert len(set(after.summary.columns)) == len(after.summary.columns) == 41
