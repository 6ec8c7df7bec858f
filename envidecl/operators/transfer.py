"""Bundles out of a store and into one: active records with their source files and facts, and what became of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept
from ..sources import files
from .store import Store


def source_key(record: Column) -> Column:
    """The key of the source file that a record names."""
    return F.get_json_object(record, "$.storage.source_blob_key")


def export(store: Store, path: str, uids: DataFrame | None = None, facts: DataFrame | None = None, with_files: bool = True, **more) -> None:
    """Write bundles of the ids given, or of all active records if none are; facts make ``results_long.csv``."""
    rows = store.current(include_archived=uids is not None and not uids.isEmpty())
    if uids is not None and not uids.isEmpty():
        rows = rows.join(uids.select("epd_uid").distinct(), "epd_uid", "left_semi")
    rows = rows.select("epd_uid", "record", "version", source_key(F.col("record")).alias("source_blob_key"))
    content = store.get_blobs(rows.select(F.col("source_blob_key").alias("key"))) if with_files else None
    if facts is not None:
        facts = facts.join(rows.select("epd_uid"), "epd_uid", "left_semi")
    files.write_bundle(rows, path, content, facts, **more)


def bring_in(store: Store, bundles: DataFrame, formats: tuple[str, ...] = (files.FORMAT,), prepare=None, note: str = "imported bundle") -> DataFrame:
    """Save the records of bundles (rows of ``files.read_files``) and keep their files; returns epd_uid, version and status.

    ``prepare`` turns a record's JSON Column into what is saved, as a migration does. An id that several bundles hold with
    different content becomes versions one after the other.
    """
    found = kept(files.read_bundles(bundles, formats))
    content = found.where("kind = 'file'").select("key", "content", F.lit("application/octet-stream").alias("content_type"), F.lit(None).cast("string").alias("original_name"))
    store.put_blobs(content)
    text = F.col("text") if prepare is None else prepare(F.col("text"))
    rows = found.where("kind = 'record'").select(F.col("key").alias("epd_uid"), text.alias("record")).distinct()
    return store.save(rows.withColumn("content_hash", F.sha2("record", 256)), note)


def bring_in_legacy(store: Store, path: str) -> DataFrame:
    """Records of older JSON array files, each content once; returns epd_uid, version and status, unchanged for what came before."""
    return store.import_once(files.legacy_records(store.spark, path), path, f"migrated from {path.rsplit('/', 1)[-1]}")
