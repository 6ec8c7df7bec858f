"""Work that must not grow faster than its input: steps once, rows over all cores, no task with a group of any size."""

import pytest
from pyspark.sql import functions as F

from envidecl import session
from envidecl.functions import domain, numbers, units
from envidecl.plans import driver
from envidecl.operators import assemble, rules
from envidecl.schemas import RECORD
from envidecl.sources import ilcd, sections

from .conftest import SF


@pytest.mark.parametrize(("column", "step", "most"), [
    (lambda: numbers.parse_number(F.col("x")), "translate(", 1),
    (lambda: units.split_label_unit(F.col("x")), "regexp_substr(", 1),
    (lambda: sections.unit_factor(F.col("x"), F.col("y")), "translate(", 2),
])
def test_steps_are_worked_out_once(spark, column, step, most):
    assert column()._jc.toString().count(step) <= most


def test_rows_go_to_all_cores(spark):
    assert driver.spread(driver.t(spark, SF, "part")).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_processes_of_large_archives_are_not_sorted(spark):
    rows = [(a, f"{k:03}", f'<processDataSet><UUID>{a}{k}</UUID></processDataSet>') for a, n in (("a", 40), ("b", 5)) for k in range(n)]
    members = spark.createDataFrame(rows, "archive string, member string, xml string")
    assert "Window" not in ilcd.processes(members, most=40)._jdf.queryExecution().optimizedPlan().toString()
    got = ilcd.processes(members, most=7).groupBy("archive").agg(F.count("*").alias("n"), F.max("member").alias("m")).collect()
    assert sorted(map(tuple, got)) == [("a", 7, "006"), ("b", 5, "004")]


def test_documents_of_one_number_stay_apart(spark):
    from envidecl.plans import datasets as x

    rows = spark.createDataFrame([("1", "10"), ("2", "20")], "k string, v string")
    labels = x._table([["Declaration number", "MD-10000-EN"], ["Product name", F.concat(F.lit("Name "), "v")]])
    results = x._table([["Indicator", "Unit", "A1", "A2", "A3"], ["GWP-total", "kg CO2 eq", F.col("v"), "1", "2"]])
    docs = x._documents(rows, "k", [x._page(1, "EN 15804+A2", [], [labels]), x._page(2, "Results", [], [results])])
    records = assemble.from_documents(docs)[0]
    got = records.select("epd_uid", "metadata.product_name", F.col("results")["GWP-total"]["modules"]["A1"]["value"]).collect()
    assert sorted(map(tuple, got)) == [("MD-10000-EN", "Name 10", 10.0), ("MD-10000-EN", "Name 20", 20.0)]
    assert sorted(r["epd_uid"] for r in assemble.apart(records).collect()) == ["1", "2"]


def test_texts_of_xml_are_parsed_once_a_path(spark):
    plan = lambda column: spark.createDataFrame([("<a/>",)], "x string").select(column)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(ilcd.xml_text(F.col("x"), "name")).count("xpath(") == 1
    assert plan(ilcd.preferred(F.col("x"), "b")).count("xpath(") == 4
    rows = [("""<a><b xml:lang='da'>one</b><b xml:lang="fr">two</b></a>""",), ("""<a><b xml:lang="fr">two</b><b xml:lang="&#101;n">three</b></a>""",), ("""<a><b xml:lang="fr"> en </b></a>""",), ("""<a><b xml:lang="en"> </b></a>""",)]
    got = spark.createDataFrame(rows, "x string").select(ilcd.preferred(F.col("x"), "b")).collect()
    assert [r[0] for r in got] == ["one", "three", "en", None]


def test_headings_of_pages_are_told_once(spark):
    from envidecl.sources import layout

    line = [layout.Box(x, k * 100.0, k * 100.0 + 10, 0.0, 8.0) for k, x in enumerate(("A1", "12,5", "C3/1", "ModuleD", "\u00a0B4"))]
    first = [(b.text, m, s) for b, m, s in layout.module_headings(line)]
    seen = layout.module_header.cache_info().misses
    assert [(b.text, m, s) for b, m, s in layout.module_headings(line)] == first == [("A1", "A1", None), ("C3/1", "C3", "1"), ("ModuleD", "D", None), ("\u00a0B4", "B4", None)]
    assert layout.module_header.cache_info().misses == seen


def test_a_bucket_of_a_large_batch_is_no_single_task(spark, tmp_path):
    from envidecl.operators.batches import Batches, bucket

    rows = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.col("id").alias("v")).where(bucket(F.col("k")) == 3)
    table = Batches(spark, f"file://{tmp_path}/t", "k string, v long", "k")
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, "20k")
    try:
        table.append(lambda: rows)
    finally:
        spark.conf.unset(name)
    assert table.read().count() == rows.count()
    assert len(list((tmp_path / "t" / "batch=1" / "bucket=3").glob("*.parquet"))) > 1


def test_sections_are_found_after_one_exchange(spark):
    rows = spark.createDataFrame([], sections.LINE)
    plan = sections.sections(rows, sections.DESCRIPTION, sections.AFTER_DESCRIPTION)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("RepartitionByExpression") + plan.count("Exchange") <= 1
    executed = sections.sections(rows, sections.DESCRIPTION, sections.AFTER_DESCRIPTION)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1


def test_names_of_databases_are_searched_once(spark):
    docs = spark.createDataFrame([], "doc_id string, pages array<struct<page_number:int,text:string,tables:array<struct<cells:array<array<string>>>>>>")
    assert sections.extended(docs)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_labels_of_properties_are_made_plain_once(spark):
    from envidecl.schemas import RAW_DOCUMENT

    docs = spark.createDataFrame([], RAW_DOCUMENT).repartition(2)
    assert sections.property_values(docs)._jdf.queryExecution().optimizedPlan().toString().count("²³, 23") == 1


def _broadcast_files(df) -> list[str]:
    """Scans of files below a broadcast of a table by itself, in the plan before it runs; what joins give is no smaller than Spark takes it for."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    found = []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((n for n in range(k + 1, len(lines)) if depth[n] <= depth[k]), len(lines))
            below = lines[k + 1 : end]
            if not any("Join" in x for x in below):
                found += [x.strip() for x in below if "FileScan" in x]
    return found


def test_kept_rows_are_not_broadcast_by_the_size_of_their_files(spark):
    """assembled_records: a row of every document takes a few bytes in a file, and hundreds in the driver's memory."""
    docs = lambda n: session.kept(spark.range(n).select(F.col("id").cast("string").alias("doc_id"), F.lit("EPD Danmark " * 20).alias("text")))
    many, few = docs(20_000), docs(10)
    for how in ("inner", "left", "left_semi"):
        joined = many.select("doc_id").join(docs(20_000).groupBy("doc_id").agg(F.first("text")), "doc_id", how)
        assert not _broadcast_files(joined) and joined.count() == 20_000
    assert _broadcast_files(spark.range(20_000).join(few, F.col("id") == F.col("doc_id"))), "what is small may be broadcast"


def _checks(records):
    derived = assemble.derive(records)
    found = rules.validate(records, derived.facts, derived.classified, F.lit("2026-01-01").cast("date"))
    return derived.step1.join(found, "epd_uid")


def _edits(records):
    edits = records.select("epd_uid", F.lit("manufacturer").alias("field"), F.lit("Reviewed A/S").alias("value"))
    edited, log = assemble.edit_fields(records, edits)
    derived = assemble.derive(session.kept(edited))
    return derived.summary.join(derived.step1.select("epd_uid", "reference_service_life"), "epd_uid").join(log.groupBy("epd_uid").count(), "epd_uid", "left")


def _migrated(records):
    return assemble.migrate(records.withColumns({"schema_version": F.lit("1.0"), "category": F.lit(None).cast("string"), "worst": F.lit(None).cast("string")}))


@pytest.mark.parametrize("derived", [_checks, _edits, _migrated])
def test_records_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch, derived):
    """assembled_checks, assembled_edits, migrated_declarations: what is derived of many records meets them without the driver."""
    monkeypatch.setattr(session, "FEW", -1, raising=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # the files are small, as they hold no rows
    try:
        assert not _broadcast_files(derived(session.kept(spark.createDataFrame([], RECORD))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_operators_are_told_from_texts_made_plain_once(spark):
    rows = spark.createDataFrame([("EPD  Danmark", "", ""), (None, "x", "by IBU")], "operator string, registration string, head string")
    found = domain.match_operators(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 2
    assert found.columns == ["operator", "registration", "head", "operator_id", "operator_name", "operator_confidence"]
