"""The store under two writers, snapshots and restores, blobs of bytes, bundles and imports."""

import csv
import io
import json
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from envidecl.operators import transfer
from envidecl.operators.store import Store
from envidecl.sources import files

BATCH = "epd_uid string, content_hash string, record string"
BYTES = "key string, content binary, content_type string, original_name string"


def rows(spark, *items):
    return spark.createDataFrame([(u, h, json.dumps({"epd_uid": u, "h": h})) for u, h in items], BATCH)


def state(store):
    return sorted((r["epd_uid"], r["version"], r["content_hash"], r["archived"]) for r in store.current().collect())


def test_two_writers_count_versions_one_after_the_other(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.save(rows(spark, ("a", "0"), ("b", "0")))
    told, gate = [], threading.Barrier(3)

    def write(h):
        mine = Store(spark, f"file://{tmp_path}/s")
        gate.wait()
        told.extend((r["epd_uid"], r["version"], r["status"]) for r in mine.save(rows(spark, ("a", h), ("b", "0"))).collect())

    threads = [threading.Thread(target=write, args=(h,)) for h in ("1", "2", "3")]
    [x.start() for x in threads], [x.join() for x in threads]
    assert sorted(told) == [("a", 2, "updated"), ("a", 3, "updated"), ("a", 4, "updated")] + [("b", 1, "unchanged")] * 3
    assert [r["version"] for r in store.versions().where("epd_uid = 'a'").orderBy("version").collect()] == [1, 2, 3, 4]
    assert store._table("versions").numbers() == [1, 2, 3, 4]
    assert not [p for p in (tmp_path / "s" / "versions").iterdir() if p.name.startswith("_pending")]


def test_a_batch_that_loses_its_number_is_worked_out_again(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    table, asked = store._table("meta"), []

    def make():
        asked.append(table.last())
        if len(asked) == 1:
            store.set_meta("k", "first")
        return spark.createDataFrame([("k", "second", None)], "key string, value string, at timestamp")

    table.append(make)
    assert asked == [0, 1] and store.get_meta("k") == "second" and table.numbers() == [1, 2]


def test_snapshot_restore_and_backup(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        store.at("never")
    store.save(rows(spark, ("a", "0"), ("b", "0")))
    store.archive(rows(spark, ("b", "0")))
    store.set_meta("k", "1")
    before = state(store)
    store.snapshot("one")
    store.save(rows(spark, ("a", "1"), ("c", "0")))
    store.archive(rows(spark, ("b", "0")), archived=False)
    store.set_meta("k", "2")
    after = state(store)
    assert state(store.at("one")) == before != after and store.at("one").get_meta("k") == "1"
    with pytest.raises(ValueError):
        store.at("one").set_meta("k", "3")
    assert not store.backup(f"file://{tmp_path}/small", most_bytes=1)
    assert store.backup(f"file://{tmp_path}/copy", most_bytes=1, force=True)
    store.snapshot("two")
    store.restore("one")
    assert state(store) == before and store.get_meta("k") == "1"
    assert [(r["version"], r["status"]) for r in store.save(rows(spark, ("a", "2"))).collect()] == [(2, "updated")]
    # What was put out of sight is not gone: a restore can be undone.
    store.restore("two")
    assert state(store) == after
    assert [r["name"] for r in store.snapshots().collect()] == ["one", "two"]
    copy = Store(spark, f"file://{tmp_path}/copy")
    assert state(copy) == after and copy.get_meta("k") == "2"
    assert not store.restore_backup(f"file://{tmp_path}/copy")
    other = Store(spark, f"file://{tmp_path}/other")
    assert other.restore_backup(f"file://{tmp_path}/copy") and state(other) == after


def test_a_snapshot_holds_while_a_writer_appends(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.save(rows(spark, *[(f"u{k}", "0") for k in range(50)]))
    store.snapshot("base")
    before = state(store)

    def write():
        for k in range(3):
            Store(spark, f"file://{tmp_path}/s").save(rows(spark, *[(f"u{n}", str(k + 1)) for n in range(25)]))

    writer = threading.Thread(target=write)
    writer.start()
    seen = [state(store.at("base")) for _ in range(3)]
    writer.join()
    assert all(s == before for s in seen)
    store.restore("base")
    assert state(store) == before


def test_blobs_of_bytes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    first = spark.createDataFrame([("files/a", bytearray(b"one"), "t", "n"), ("files/b", bytearray(b""), "t", None), ("text/a", bytearray(b"\0\xff"), "t", "n")], BYTES)
    threads = [threading.Thread(target=lambda: Store(spark, f"file://{tmp_path}/s").put_blobs(first)) for _ in range(2)]
    [x.start() for x in threads], [x.join() for x in threads]
    store.put_blobs(spark.createDataFrame([("files/a", bytearray(b"late"), "t", "n")], BYTES))
    assert sorted((r["key"], r["size"]) for r in store.blobs().collect()) == [("files/a", 3), ("files/b", 0), ("text/a", 2)]
    got = {r["key"]: bytes(r["content"]) for r in store.get_blobs(spark.createDataFrame([("files/a",), ("files/b",), ("none",), ("files/a",)], "key string")).collect()}
    assert got == {"files/a": b"one", "files/b": b""}
    listed = store.list_blobs("files/")
    assert [r["key"] for r in listed.collect()] == ["files/a", "files/b"]
    assert store.list_blobs("", listed.first()["modified"]).count() == 0 and store.list_blobs("", "2000-01-01").count() == 3
    for key in ("../a", "/a", "a/../../b", "", None):
        with pytest.raises(Exception, match="not a blob key"):
            store.put_blobs(spark.createDataFrame([(key, bytearray(b"x"), "t", "n")], BYTES))
    broken = store.get_blobs(spark.createDataFrame([("files/c",)], "key string"))
    store.register_blobs(spark.createDataFrame([("files/c", "0" * 64, 1, "t", "n", bytearray(b"x"))], "key string, sha256 string, size long, content_type string, original_name string, content binary").withColumn("created_at", F.current_timestamp()))
    broken = store.get_blobs(spark.createDataFrame([("files/c",)], "key string"))
    with pytest.raises(Exception, match="digest"):
        broken.collect()


def facts(spark, n):
    from envidecl.schemas import FACT_RESULT

    kinds = [c.split() for c in FACT_RESULT.split(", ")]
    known = {"epd_uid": F.format_string("U %05d", "id"), "indicator": F.lit("GWP-total"), "module": F.lit("A1"), "scenario": F.lit(""), "value": F.col("id") / 2, "raw_value": F.lit('a "b", c'), "human_edited": F.col("id") % 2 == 0}
    return spark.range(n).select(*[known.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds])


def test_fifty_thousand_records_go_round(spark, tmp_path):
    """Records, files that thousands of them share, and facts; nothing is collected, no bound is met."""
    n = 50_000
    uid = F.format_string("U %05d", "id")
    key = F.when(F.col("id") % 3 == 0, "files/hot").when(F.col("id") % 1000 == 1, F.concat(F.lit("files/"), F.col("id")))
    record = F.to_json(F.struct(uid.alias("epd_uid"), F.struct(key.alias("source_blob_key")).alias("storage"), F.lit("ä\n\"").alias("t")))
    records = spark.range(n).select(uid.alias("epd_uid"), record.alias("record"), F.sha2(record, 256).alias("content_hash"))
    store = Store(spark, f"file://{tmp_path}/s")
    store.save(records)
    keys = records.select(transfer.source_key(F.col("record")).alias("key")).where("key IS NOT NULL").distinct()
    store.put_blobs(keys.select("key", F.repeat(F.col("key"), 2000).cast("binary").alias("content"), F.lit("t").alias("content_type"), F.lit("n").alias("original_name")))
    transfer.export(store, f"file://{tmp_path}/b", facts=facts(spark, n), bundle_bytes=300_000)
    found = files.read_files(spark, f"file://{tmp_path}/b", "part-*")
    assert found.count() > 4 and {r["format"] for r in found.select("format").distinct().collect()} == {"ilcd_zip"}
    one = zipfile.ZipFile(io.BytesIO(bytes(found.where("content IS NOT NULL").first()["content"])))
    lines = list(csv.DictReader(io.StringIO(one.read("results_long.csv").decode("utf-8-sig"))))
    manifest = json.loads(one.read("manifest.json"))
    assert one.testzip() is None and len(lines) == len(manifest["records"]) and lines[0]["raw_value"] == 'a "b", c' and lines[0]["human_edited"] in ("True", "False")
    other = Store(spark, f"file://{tmp_path}/t")
    counts = lambda saved: {r["status"]: r["count"] for r in saved.groupBy("status").count().collect()}
    assert counts(transfer.bring_in(other, found)) == {"created": n}
    assert other.current().select("epd_uid", "record").exceptAll(store.current().select("epd_uid", "record")).isEmpty()
    assert sorted((r["key"], r["sha256"]) for r in other.blobs().collect()) == sorted((r["key"], r["sha256"]) for r in store.blobs().collect())
    assert counts(transfer.bring_in(other, found)) == {"unchanged": n}


def test_bundles_of_others_and_problems(spark, tmp_path):
    def zipped(manifest, **members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("manifest.json", json.dumps(manifest))
            for name, text in members.items():
                z.writestr(name.replace("__", "/"), text)
        return bytearray(out.getvalue())

    ours = {"format": "declaration-bundle", "records": [{"epd_uid": "u", "path": "r.json", "version": 3}], "files": ["files/a", "files/b", "files/none"]}
    frame = lambda *c: spark.createDataFrame([(str(k), x) for k, x in enumerate(c)], "path string, content binary")
    good = zipped(ours, **{"r.json": '{"epd_uid": "u"}', "blobs__files__a": "x", "blobs__files__b": "y" * 100, "blobs__files__unlisted": "z"})
    got = sorted((r["kind"], r["key"], r["version"]) for r in files.read_bundles(frame(good), largest=50).collect())
    assert got == [("file", "files/a", None), ("problem", "blobs/files/b", None), ("problem", "blobs/files/none", None), ("record", "u", 3)]
    theirs = zipped({"format": "another", "records": ["r.json"]}, **{"r.json": '{"epd_uid": "v"}'})
    assert [r["key"] for r in files.read_bundles(frame(theirs), formats=("another",)).collect()] == ["v"]
    with pytest.raises(Exception, match="not a declaration bundle"):
        files.read_bundles(frame(theirs)).collect()


def test_members_left_out_are_told(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.xml", "x"), z.writestr("big.XML", "y" * 100), z.writestr("note.txt", "no")
    frame = spark.createDataFrame([("one", bytearray(out.getvalue())), ("two", bytearray(b"not a zip"))], "path string, content binary")
    told = sorted((r["path"], r["member"] or "", r["reason"]) for r in files.zip_problems(frame, largest=50, suffix=".xml").collect())
    assert told == [("one", "big.XML", "too large"), ("one", "note.txt", "suffix"), ("two", "", "no archive")]
    assert [r["member"] for r in files.unzip(frame.where("path = 'one'"), largest=50, suffix=".xml").collect()] == ["a.xml"]


def test_older_files_are_imported_once(spark, tmp_path):
    old = [{"metadata": {"registration_number": "md-1 en"}}, {"epd_uid": "own", "x": [1, {"y": None}]}, 7, {"document": {"sha256": "ab" * 32}}]
    (tmp_path / "epds.json").write_text("﻿" + json.dumps(old), encoding="utf-8")
    store, path = Store(spark, f"file://{tmp_path}/s"), f"file://{tmp_path}/epds.json"
    told = lambda saved: sorted((r["epd_uid"], r["version"], r["status"]) for r in saved.collect())
    ids = ["MD-1-EN", "own", "sha-" + "ab" * 10]
    assert told(transfer.bring_in_legacy(store, path)) == [(u, 1, "created") for u in ids]
    store.save(rows(spark, ("own", "reviewed")))
    assert told(transfer.bring_in_legacy(store, path)) == [("MD-1-EN", 1, "unchanged"), ("own", 2, "unchanged"), (ids[2], 1, "unchanged")]
    assert store.current().where("epd_uid = 'own'").first()["content_hash"] == "reviewed"
    assert told(transfer.bring_in_legacy(store, f"file://{tmp_path}/absent.json")) == []


def test_statistics(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.put_blobs(spark.createDataFrame([("a", bytearray(b"123"), "t", "n"), ("b", bytearray(b"4567"), "t", "n")], BYTES))
    summary = spark.createDataFrame([("u", 0, None, 1, 0), ("v", 1, "2000-01-01", 0, 1)], "epd_uid string, archived int, valid_until string, dgnb_ready int, eco_platform int")
    got = store.stats(summary, facts(spark, 5)).first().asDict()
    assert got.pop("index_bytes") > 0
    assert got == {"total": 2, "active": 1, "valid": 1, "dgnb": 1, "eco": 0, "result_rows": 5, "blobs": 2, "blob_bytes": 7}
