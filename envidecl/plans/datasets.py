"""Readers of datasets and documents over whole driver tables: XML and pages are written from a table's columns and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, store, transfer, views
from ..session import kept, shared_folder
from ..sources import documents, files, ilcd
from .driver import register, spread, t

_KG = ilcd.MASS


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def members(spark: SparkSession, d: str) -> DataFrame:
    """A process for every part, with a flow for those of size 26 and more; brands are archives."""
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    process = _text(
        '<processDataSet xmlns:common="c" xmlns:epd="e"><processInformation><dataSetInformation><common:UUID>P-', k, '</common:UUID><name><baseName xml:lang="de">de ', name, '</baseName><baseName xml:lang="en"> ', name,
        '</baseName></name><common:other><epd:scenario epd:name="S1"/><epd:scenario epd:name="S2" epd:default="', F.when(size % 2 == 0, "true").otherwise("false"), '"/><epd:referenceServiceLife epd:years="', size,
        '"/></common:other></dataSetInformation><quantitativeReference><referenceToReferenceFlow>0</referenceToReferenceFlow></quantitativeReference><time><common:dataSetValidUntil>', size + 2000,
        '</common:dataSetValidUntil></time></processInformation><modellingAndValidation><validation><review type="', F.when(size > 40, "Internal review").otherwise("Independent external review"),
        '"/></validation><complianceDeclarations><compliance><common:referenceToComplianceSystem refObjectId="SYS-', size % 3, '"><common:shortDescription>EN 15804+A2</common:shortDescription></common:referenceToComplianceSystem></compliance></complianceDeclarations></modellingAndValidation>',
        '<exchanges><exchange dataSetInternalID="0"><referenceToFlowDataSet refObjectId="F-', k, '"/><meanAmount>2.0</meanAmount></exchange></exchanges><LCIAResults><LCIAResult><referenceToLCIAMethodDataSet refObjectId="I-1"/><common:other><epd:amount epd:module="A1-A3">', size,
        '</epd:amount><epd:amount epd:module="C3" epd:scenario="S1">', size + 0.5, '</epd:amount><epd:amount epd:module="C3" epd:scenario="S2">ND</epd:amount></common:other></LCIAResult><LCIAResult><referenceToLCIAMethodDataSet refObjectId="U-', size % 5,
        '"/><common:other><epd:amount epd:module="D">1</epd:amount></common:other></LCIAResult></LCIAResults></processDataSet>',
    )
    flow = _text('<flowDataSet><flowInformation><UUID>f-', k, f'</UUID></flowInformation><flowProperties><flowProperty dataSetInternalID="0"><referenceToFlowPropertyDataSet refObjectId="{_KG}"/><meanValue>', size * 10, "</meanValue></flowProperty></flowProperties></flowDataSet>")
    part = spread(t(spark, d, "part"))
    one = lambda rows, kind, xml: rows.select(F.col("p_brand").alias("archive"), _text(kind, k).alias("member"), xml.alias("xml"))
    return one(part, "p", process).unionByName(one(part.where("p_size > 25"), "f", flow))


@register(
    "SELECT p_brand AS archive, 'p-' || p_partkey AS uuid, p_name AS product_name, p_size::DOUBLE AS reference_service_life_years, (p_size + 2000) || '-12-31' AS valid_until, CASE WHEN p_size > 40 THEN 'internal' ELSE 'external' END AS verification, "
    "CASE WHEN p_size > 25 THEN p_size * 20.0 END::DOUBLE AS mass_per_declared_unit_kg, CASE WHEN p_size > 25 THEN round_even(2.0 / (p_size * 20.0), 8) END::DOUBLE AS conversion_factor_to_1kg FROM part"
)
def ilcd_processes(spark: SparkSession, d: str) -> DataFrame:
    all_ = members(spark, d)
    rows = ilcd.with_flows(ilcd.processes(all_), ilcd.flows(all_))
    return rows.select("archive", "uuid", "product_name", "reference_service_life_years", "valid_until", "verification", "mass_per_declared_unit_kg", "conversion_factor_to_1kg")


@register(
    "SELECT 'p-' || p_partkey AS uuid, 'A1-A3' AS module, '' AS scenario, p_size::DOUBLE AS value, 'declared' AS status FROM part UNION ALL "
    "SELECT 'p-' || p_partkey, 'C3', '', CASE WHEN p_size % 2 = 1 THEN p_size + 0.5 END, CASE WHEN p_size % 2 = 1 THEN 'declared' ELSE 'not_declared' END FROM part UNION ALL "
    "SELECT 'p-' || p_partkey, 'C3', 'S1', p_size + 0.5, 'declared' FROM part UNION ALL SELECT 'p-' || p_partkey, 'C3', 'S2', NULL, 'not_declared' FROM part"
)
def ilcd_slots(spark: SparkSession, d: str) -> DataFrame:
    process = kept(ilcd.processes(members(spark, d)))
    fact, _ = ilcd.facts(ilcd.amounts(process), ilcd.registry(spark, [("I-1", "GWP-total", "kg CO2 eq")]))
    return ilcd.module_slots(fact, ilcd.scenarios(process)).select("uuid", "module", "scenario", "value", "status")


@register("SELECT 'p-' || p_partkey AS uuid, 'u-' || (p_size % 5) AS unknown FROM part")
def ilcd_unknown(spark: SparkSession, d: str) -> DataFrame:
    process = kept(ilcd.processes(members(spark, d)))
    return ilcd.facts(ilcd.amounts(process), ilcd.registry(spark, [("I-1", "GWP-total", "kg CO2 eq")]))[1].select("uuid", F.array_join("unknown_indicators", ",").alias("unknown"))


@register("SELECT 'p-' || p_partkey AS uuid, CASE p_size % 3 WHEN 0 THEN 'EN15804_A1_CML' WHEN 1 THEN 'EN15804_A2_EF3.1' ELSE 'EN15804_A2_UNKNOWN_EF' END AS standard_profile FROM part")
def ilcd_compliance(spark: SparkSession, d: str) -> DataFrame:
    systems = spark.createDataFrame([("sys-0", "EN15804_A1_CML"), ("SYS-1", "EN15804_A2_EF3.1")], "system_uuid string, system_profile string")
    return ilcd.profiles(ilcd.processes(members(spark, d)), systems).select("uuid", "standard_profile")


@register("SELECT c_custkey, c_name AS plain, CASE WHEN c_nationkey < 10 THEN 'da ' || c_name ELSE 'fr ' || c_name END AS chosen FROM customer")
def xml_texts(spark: SparkSession, d: str) -> DataFrame:
    lang = F.when(F.col("c_nationkey") < 10, "da").otherwise("it")
    xml = _text('<a xmlns:x="u"><x:name>  ', F.col("c_name"), ' </x:name><b xml:lang="fr">fr ', F.col("c_name"), '</b><b xml:lang="', lang, '">', lang, " ", F.col("c_name"), "</b></a>")
    return spread(t(spark, d, "customer")).select("c_custkey", ilcd.xml_text(xml, "name").alias("plain"), ilcd.preferred(xml, "b").alias("chosen"))


# --- Documents on pages --------------------------------------------------------------------------
def _word(x0, y: float, text) -> Column:
    x0 = F.lit(x0) if isinstance(x0, (int, float)) else x0
    return F.struct(x0.cast("double").alias("x0"), F.lit(float(y)).alias("y0"), (x0 + 10).cast("double").alias("x1"), F.lit(float(y + 8)).alias("y1"), (F.lit(text) if isinstance(text, str) else text).cast("string").alias("text"))


def _table(rows: list[list]) -> Column:
    cell = lambda c: (F.lit(c) if isinstance(c, str) else c).cast("string")
    return F.struct(F.lit(1).alias("table_number"), F.array(*[F.array(*map(cell, r)) for r in rows]).alias("cells"))


def _page(number: int, text: Column | str, words: list[Column], tables: list[Column]) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")
    no_tables = F.array().cast("array<struct<table_number:int,cells:array<array<string>>>>")
    return F.struct(
        F.lit(number).alias("page_number"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), text.alias("text"), (F.array(*words) if words else none).alias("words"), (F.array(*tables) if tables else no_tables).alias("tables"), F.lit(True).alias("has_text")
    )


def _documents(rows: DataFrame, key: str, pages: list[Column], title: Column | None = None) -> DataFrame:
    big, small = (F.struct(x.alias("text"), F.lit(size).alias("size"), F.lit(10.0).alias("y0")) for x, size in ((title if title is not None else F.lit("Title"), 20.0), (F.lit("small print"), 9.0)))
    return spread(rows).select(F.col(key).cast("string").alias("doc_id"), F.array(*pages).alias("pages"), F.array(big, small).alias("title_lines"))


@register(
    "SELECT o_orderkey::VARCHAR AS doc_id, i AS indicator, m AS module, CASE i WHEN 'GWP-total' THEN CASE m WHEN 'A1-A3' THEN o_custkey + 0.5 WHEN 'C3' THEN NULL ELSE -1.25 END ELSE CASE m WHEN 'A1-A3' THEN 7.0 WHEN 'C3' THEN o_orderkey % 100 ELSE NULL END END::DOUBLE AS value, "
    "CASE WHEN i = 'GWP-total' AND m = 'C3' OR i = 'PERT' AND m = 'D' THEN 'not_declared' ELSE 'declared' END AS status FROM orders, (VALUES ('GWP-total'), ('PERT')) x(i), (VALUES ('A1-A3'), ('C3'), ('D')) y(m)"
)
def table_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders")
    # The second label holds its unit, and its page has a heading above the table's header row.
    table = _table([["Results", "", "", "", ""], ["Indicator", "Unit", "A1-A3", "C3", "D"], ["GWP-total", "kg CO2 eq", F.translate((F.col("o_custkey") + 0.5).cast("string"), ".", ","), "MND", "-1.25E+00"], ["PERT [MJ]", "MJ", "7", F.col("o_orderkey") % 100, "ND"]])
    docs = _documents(rows, "o_orderkey", [_page(1, "text", [], [table])])
    found = documents.extract_facts(docs, docs.select("doc_id", F.lit("EN15804_A2_EF3.1").alias("profile")))
    return found.select("doc_id", "indicator", "module", "value", "status")


@register("SELECT c_custkey::VARCHAR AS doc_id, m AS module, CASE m WHEN 'A1' THEN 'X' WHEN 'A2' THEN 'X' WHEN 'A3' THEN 'X' WHEN 'A4' THEN CASE WHEN c_nationkey < 10 THEN 'X' ELSE 'MND' END WHEN 'A5' THEN 'ND' ELSE 'NR' END AS declared FROM customer, (VALUES ('A1'), ('A2'), ('A3'), ('A4'), ('A5'), ('B1')) x(m)")
def module_marks(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("c_nationkey") < 10, "☒").otherwise("MND")
    table = _table([["A1", "A2", "A3", "A4", "A5", "B1"], ["x", "X", "✓", mark, "-", "NR"]])
    return documents.extract_declarations(_documents(t(spark, d, "customer"), "c_custkey", [_page(1, "cover", [], []), _page(2, "modules", [], [table])]))


@register("SELECT (l_orderkey * 10000 + l_partkey * 8 + l_linenumber)::VARCHAR || '-' || l_quantity || '-' || l_extendedprice AS doc_id, CASE WHEN l_quantity < 25 THEN 'A4' ELSE 'C3' END AS module, l_extendedprice::DOUBLE AS value FROM lineitem WHERE l_quantity <> 25")
def nearest_header(spark: SparkSession, d: str) -> DataFrame:
    """Each value goes to the nearest of the headings C4, A4 and C3, at 0, 100 and 200 points; the value stands at 50 to 250."""
    rows = t(spark, d, "lineitem").where("l_quantity <> 25")
    rows = rows.withColumn("_id", _text(F.col("l_orderkey") * 10000 + F.col("l_partkey") * 8 + F.col("l_linenumber"), "-", F.col("l_quantity"), "-", F.col("l_extendedprice")))
    x = 100 + F.col("l_quantity") * 2
    words = [_word(0, 10, "C4"), _word(100, 10, "A4"), _word(200, 10, "C3"), _word(-80, 30, "GWP-total"), _word(x, 30, F.col("l_extendedprice"))]
    found = documents.word_values(_documents(rows, "_id", [_page(1, "text", words, [])]))
    return found.select("doc_id", "module", F.col("raw_value").cast("double").alias("value"))


@register(
    "SELECT p_partkey::VARCHAR AS doc_id, 'MD-' || lpad(p_partkey::VARCHAR, 5, '0') || '-EN' AS registration_number, 'Title ' || p_name AS product_name, p_brand AS manufacturer, CASE WHEN p_size > 25 THEN p_size::DOUBLE END AS reference_service_life_years, "
    "CASE WHEN p_size > 25 THEN 'declared' ELSE 'not_defined' END AS reference_service_life_status, '1 m2' AS declared_unit_raw, CASE WHEN p_size % 2 = 0 THEN 'external' END AS verification FROM part"
)
def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows, size = t(spark, d, "part"), F.col("p_size")
    number = F.concat(F.lit("MD-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("-EN"))
    life = F.when(size > 25, F.concat(F.lit("Reference service life: "), size.cast("string"), F.lit(" years"))).otherwise("Reference service life is not declared")
    text = F.concat(life, F.lit(".\nThe declared unit is 1 m2 of product.\n"), F.when(size % 2 == 0, "Independent external verifier").otherwise("nobody"))
    docs = _documents(rows, "p_partkey", [_page(1, text, [], [_table([["Declaration number", number], ["Manufacturer", F.col("p_brand")]])])], F.concat(F.lit("Title "), "p_name"))
    return documents.extract_metadata(docs).select("doc_id", "registration_number", "product_name", "manufacturer", "reference_service_life_years", "reference_service_life_status", "declared_unit_raw", "verification")


@register("SELECT c_custkey::VARCHAR AS doc_id, CASE WHEN c_nationkey < 12 THEN 'external' ELSE 'internal' END AS verification FROM customer")
def verification_boxes(spark: SparkSession, d: str) -> DataFrame:
    mark = lambda yes: F.when(yes, "☒").otherwise("☐")
    first = F.col("c_nationkey") < 12
    words = [_word(20, 10, mark(~first)), _word(40, 10, "internally"), _word(200, 10, mark(first)), _word(220, 10, "externally")]
    return documents.verification_marks(_documents(t(spark, d, "customer"), "c_custkey", [_page(1, "text", words, [])]))


# --- Rules, views, store -------------------------------------------------------------------------


@register("SELECT o_orderkey AS epd_uid, p AS parameter, CASE p WHEN 'core_standard' THEN o_orderstatus WHEN 'electricity_mix' THEN o_orderpriority ELSE 'info' END AS status FROM orders, (VALUES ('core_standard'), ('electricity_mix'), ('co2_reporting_unit')) x(p)")
def checklist_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..dims import tables as D

    given = {"core_standard": F.col("o_orderstatus"), "electricity_mix": F.col("o_orderpriority")}
    step1 = t(spark, d, "orders").select(F.col("o_orderkey").alias("epd_uid"), *[given.get(p, F.lit("info")).alias(p) for p, _ in D.PARAMETERS])
    return views.checklist(step1).where(F.col("parameter").isin("core_standard", "electricity_mix", "co2_reporting_unit")).select("epd_uid", "parameter", "status")


@register("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '1.0' END AS migrated_from_schema, '2.0' AS schema_version, strftime(o_orderdate, '%Y-%m-%d') AS publication_date_iso, 2.5::DOUBLE AS declared_quantity, CASE WHEN o_orderstatus = 'O' THEN 'kept' ELSE 'kg' END AS declared_unit, 'pdf' AS source_format FROM orders")
def migrated_records(spark: SparkSession, d: str) -> DataFrame:
    status, day = F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd")
    old = t(spark, d, "orders").select(
        "o_orderkey", F.when(status != "F", "2.0").alias("schema_version"), day.alias("publication_date"), F.lit(None).cast("string").alias("valid_until"), F.lit("2,5 kg").alias("declared_unit_raw"), F.when(status == "O", "kept").alias("declared_unit"), F.lit("a.PDF").alias("source_file")
    )
    return views.migrate(old).select("o_orderkey", "migrated_from_schema", "schema_version", "publication_date_iso", "declared_quantity", "declared_unit", "source_format")


@register(
    "SELECT 'C' || c_custkey AS epd_uid, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS version, CASE WHEN c_acctbal < 0 THEN 'changed' ELSE c_mktsegment END AS content_hash, (c_nationkey < 3)::INT AS archived FROM customer"
)
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, an archive log, and what is current then."""
    rows = t(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("epd_uid"), F.col("c_mktsegment").alias("content_hash"), F.lit("{}").alias("record"), "c_acctbal", "c_nationkey")
    s = _store(spark)
    s.save(rows.select("epd_uid", "content_hash", "record"))
    s.save(rows.select("epd_uid", F.when(F.col("c_acctbal") < 0, "changed").otherwise(F.col("content_hash")).alias("content_hash"), "record"))
    s.archive(rows.where("c_nationkey < 3"))
    return s.current().select("epd_uid", "version", "content_hash", "archived")


@register("SELECT key, sha256 FROM (SELECT 'k' || (c_custkey % 50) AS key, sha256(c_name) AS sha256, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY sha256(c_name)) AS r FROM customer) WHERE r = 1")
def store_blobs(spark: SparkSession, d: str) -> DataFrame:
    """The first writer of a key wins, in one batch and in the next."""
    s = _store(spark)
    rows = t(spark, d, "customer").select(
        F.concat(F.lit("k"), F.col("c_custkey") % 50).alias("key"), F.sha2("c_name", 256).alias("sha256"), F.lit(1).cast("long").alias("size"), F.lit("t").alias("content_type"), F.col("c_name").alias("original_name"), F.lit("2024-01-01").cast("timestamp").alias("created_at")
    )
    s.register_blobs(rows)
    s.register_blobs(rows.withColumn("sha256", F.lit("0 comes late")))
    return s.blobs().select("key", "sha256")


def _store(spark: SparkSession) -> store.Store:
    return store.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


_CUSTOMERS = "SELECT 'C' || c_custkey AS epd_uid, 1 AS version, c_mktsegment AS content_hash, (c_nationkey < 3)::INT AS archived FROM customer"


@register(f"SELECT c.*, s AS seen FROM ({_CUSTOMERS}) c, (VALUES ('after restore'), ('in backup'), ('in snapshot')) x(s)")
def store_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot, a backup taken later of the snapshot's state restored, and the store after the restore, while a writer has gone on."""
    rows = t(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("epd_uid"), F.col("c_mktsegment").alias("content_hash"), F.lit("{}").alias("record"), "c_nationkey")
    s = _store(spark)
    s.save(rows)
    s.archive(rows.where("c_nationkey < 3"))
    s.snapshot("base")
    s.save(rows.where("c_nationkey > 10").withColumn("content_hash", F.lit("changed")))
    s.archive(rows.where("c_nationkey = 20"))
    seen = s.at("base")
    s.save(rows.withColumn("epd_uid", F.concat("epd_uid", F.lit("-more"))))
    s.restore("base")
    copy = _store(spark)
    s.backup(copy.root)
    named = lambda x, name: x.current().select("epd_uid", "version", "content_hash", "archived", F.lit(name).alias("seen"))
    return named(seen, "in snapshot").unionByName(named(s, "after restore")).unionByName(named(copy, "in backup"))


@register("SELECT 'files/' || (c_custkey % 50) AS key, min(c_name) AS text, count(*) AS others, octet_length(encode(min(c_name))) AS size FROM customer GROUP BY 1")
def blob_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of fifty keys by many writers, of which the smallest name's come first; a later batch puts none of its own."""
    key = F.concat(F.lit("files/"), F.col("c_custkey") % 50)
    rows = t(spark, d, "customer").select(key.alias("key"), F.col("c_name").cast("binary").alias("content"), F.lit("t").alias("content_type"), F.col("c_name").alias("original_name"))
    s = _store(spark)
    s.put_blobs(rows.groupBy("key").agg(F.min("content").alias("content")).withColumns({"content_type": F.lit("t"), "original_name": F.lit("n")}))
    s.put_blobs(rows.withColumn("content", F.lit(b"late")).unionByName(rows.withColumn("key", F.concat(F.lit("text/"), "key"))))
    listed = s.list_blobs("files/")
    return s.get_blobs(listed).join(listed, "key").join(rows.groupBy("key").agg(F.count("*").alias("others")), "key").select("key", F.decode("content", "UTF-8").alias("text"), "others", "size")


@register(
    "SELECT 'O' || o_orderkey AS epd_uid, 1 AS version, sha256('{\"epd_uid\":\"O' || o_orderkey || '\",\"storage\":{\"source_blob_key\":\"files/' || o_orderpriority || '\"},\"customer\":' || o_custkey || '}') AS digest, "
    "sha256(o_orderpriority || ' bytes') AS file_digest, 'unchanged' AS again FROM orders"
)
def bundle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records out of a store as bundles, with source files that a fifth of them share, and into another store, twice."""
    key = F.concat(F.lit("files/"), "o_orderpriority")
    uid = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    record = F.to_json(F.struct(uid.alias("epd_uid"), F.struct(key.alias("source_blob_key")).alias("storage"), F.col("o_custkey").alias("customer")))
    orders = t(spark, d, "orders")
    one, two, path = _store(spark), _store(spark), f"{shared_folder(spark)}/bundles-{uuid.uuid4().hex}"
    one.save(orders.select(uid.alias("epd_uid"), F.sha2(record, 256).alias("content_hash"), record.alias("record")))
    content = F.concat("o_orderpriority", F.lit(" bytes")).cast("binary")
    one.put_blobs(orders.select("o_orderpriority").distinct().select(key.alias("key"), content.alias("content"), F.lit("t").alias("content_type"), F.lit("n").alias("original_name")))
    transfer.export(one, path, bundle_bytes=1 << 20)
    bundles = files.read_files(spark, path, "part-*")
    transfer.bring_in(two, bundles)
    again = transfer.bring_in(two, bundles).select("epd_uid", F.col("status").alias("again"))
    found = two.current().select("epd_uid", "version", F.sha2("record", 256).alias("digest"), transfer.source_key(F.col("record")).alias("key"))
    return found.join(two.blobs().select("key", F.col("sha256").alias("file_digest")), "key").join(again, "epd_uid").drop("key")


@register(
    "SELECT 'C' || c_custkey AS epd_uid, n AS import, CASE WHEN n = 2 AND c_nationkey = 5 THEN 2 ELSE 1 END AS version, CASE n WHEN 1 THEN 'created' ELSE 'unchanged' END AS status FROM customer, (VALUES (1), (2)) x(n)"
)
def legacy_imports(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of a hundred older records each, imported, reviewed in part, and imported again."""
    uid = F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("epd_uid")
    rows = t(spark, d, "customer").select(uid, F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.floor(F.col("c_custkey") / 100).alias("file"))
    path, s = f"{shared_folder(spark)}/legacy-{uuid.uuid4().hex}", _store(spark)
    rows.groupBy("file").agg(F.to_json(F.collect_list(F.struct("epd_uid", "name", "nation"))).alias("value")).select("value").write.text(path)
    first = s.import_once(files.legacy_records(spark, path, lines=True), path)
    s.save(rows.where("nation = 5").select("epd_uid", F.lit("reviewed").alias("content_hash"), F.lit("{}").alias("record")))
    second = s.import_once(files.legacy_records(spark, path, lines=True), path)
    return first.withColumn("import", F.lit(1)).unionByName(second.withColumn("import", F.lit(2)))


@register(
    "SELECT (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS active, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate >= DATE '1998-06-30') AS valid, "
    "(SELECT count(*) FROM lineitem) AS result_rows, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS blobs, (SELECT sum(octet_length(encode(m)))::BIGINT FROM (SELECT DISTINCT c_mktsegment AS m FROM customer)) AS blob_bytes"
)
def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counters of records, facts and blobs; orders, items and segments stand for them."""
    s = _store(spark)
    segments = t(spark, d, "customer").select("c_mktsegment").distinct()
    s.put_blobs(segments.select(F.col("c_mktsegment").alias("key"), F.col("c_mktsegment").cast("binary").alias("content"), F.lit("t").alias("content_type"), F.lit("n").alias("original_name")))
    summary = t(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("archived"), F.col("o_orderdate").cast("string").alias("valid_until"), F.lit(0).alias("dgnb_ready"), F.lit(0).alias("eco_platform"))
    return s.stats(summary, t(spark, d, "lineitem"), F.lit("1998-06-30").cast("date")).select("total", "active", "valid", "result_rows", "blobs", "blob_bytes")


@register("SELECT ord, operator_id, country, count(c_custkey) AS n FROM (VALUES (0, 'epd_italy', 'Italy'), (1, 'epd_global_norway', 'Norway'), (2, 'ibu', 'Germany'), (3, 'epd_danmark', 'Denmark'), (4, 'epd_international', 'Sweden'), (5, 'bre', 'United Kingdom'), (6, 'inies', 'France'), (7, 'kiwa', 'Germany'), (8, 'rts', 'Finland'), (9, 'itb', 'Poland')) x(ord, operator_id, country) LEFT JOIN customer ON c_custkey % 11 = ord GROUP BY ALL")
def operator_list(spark: SparkSession, d: str) -> DataFrame:
    """The list of programmes, with how many declarations name each; customers stand for those."""
    named = t(spark, d, "customer").groupBy((F.col("c_custkey") % 11).cast("int").alias("ord")).agg(F.count("*").alias("n"))
    return views.operators(spark).join(named, "ord", "left").select("ord", "operator_id", "country", F.coalesce("n", F.lit(0)).alias("n"))


@register("SELECT p_partkey AS epd_uid, CASE split_part(p_name, ' ', 2) WHEN 'bolt' THEN 'steel' WHEN 'ring' THEN 'glass' WHEN 'rod' THEN 'skylight' ELSE 'other' END AS category FROM part")
def classified_parts(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts stand for product names: some are made products of a category, a roof window being a skylight."""
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.when(noun == "bolt", "Structural steel beam S355").when(noun == "ring", "Insulating glass unit, float glass").when(noun == "rod", "Roof window of wood").otherwise("Something")
    fields = "product_name pcr product_category product_description ilcd_classification".split()
    metadata = F.struct(*[(name if f == "product_name" else F.lit(None).cast("string")).alias(f) for f in fields])
    records = t(spark, d, "part").select(F.col("p_partkey").alias("epd_uid"), metadata.alias("metadata"), F.lit("").alias("full_text"))
    return rules.classify(records).select("epd_uid", "category")


@register("SELECT page_id, page_id % 3 AS kind, 'm' || page_id || '.xml' AS member, url AS content FROM pages WHERE page_id IS NOT NULL")
def zip_members(spark: SparkSession, d: str) -> DataFrame:
    """Archives of one member each, as bytes, opened again; members of another suffix are left out."""
    import io
    import zipfile

    import pandas as pd

    def pack(frames):
        for f in frames:
            out = []
            for k, u in zip(f["page_id"], f["url"], strict=True):
                b = io.BytesIO()
                with zipfile.ZipFile(b, "w") as z:
                    z.writestr(f"m{k}.xml", u or "")
                    z.writestr("note.txt", "no")
                out.append(b.getvalue())
            yield pd.DataFrame({"path": f["page_id"].astype(str), "content": out})

    zipped = t(spark, d, "pages").where("page_id IS NOT NULL").select("page_id", "url").mapInPandas(pack, "path string, content binary")
    found = files.unzip(zipped, suffix=".xml")
    return found.select(F.col("path").cast("long").alias("page_id"), (F.col("path").cast("long") % 3).alias("kind"), "member", F.decode("content", "UTF-8").alias("content"))
