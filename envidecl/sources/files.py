"""File sources and sinks: formats, archives, bundles, legacy JSON, blobs and exports."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import record_uid, slug
from ..schemas import RESULT_COLUMNS

MAX_XML = 50 << 20
MAX_BUNDLE_MEMBER = 400 << 20
#: The manifest's name for what this package writes; others' bundles are read by naming their format.
FORMAT = "declaration-bundle"
#: Bytes at which a bundle is closed and the next one begun.
BUNDLE_BYTES = 64 << 20
#: Records of one source file that a task takes.
RECORDS_DEALT = 10_000


def detect_format(content: Column, name: Column) -> Column:
    """pdf, ilcd_zip, ilcd_xml or unknown, by the first bytes or else the name; pdf first."""
    head = F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    low = F.lower(name)
    return (
        F.when(F.startswith(head, F.lit("%PDF")) | F.endswith(low, F.lit(".pdf")), "pdf")
        .when(F.startswith(head, F.lit("PK")) | F.endswith(low, F.lit(".zip")), "ilcd_zip")
        .when(F.startswith(head, F.lit("<")) | F.endswith(low, F.lit(".xml")), "ilcd_xml")
        .otherwise("unknown")
    )


def read_files(spark: SparkSession, path: str, pattern: str | None = None, modified_after: str | None = None) -> DataFrame:
    """path, content, sha256, size and format of files; Spark's own file source lists and filters."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.load(path).select(
        "path", "content", "modificationTime", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), detect_format(F.col("content"), F.col("path")).alias("format")
    )


def unzip(files: DataFrame, largest: int = MAX_XML, suffix: str = "") -> DataFrame:
    """path, member, content of the members of zip files; larger ones and other suffixes are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir() and info.file_size <= largest and info.filename.lower().endswith(suffix):
                            yield pd.DataFrame({"path": [path], "member": [info.filename], "content": [z.read(info)]})

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary")


def zip_problems(files: DataFrame, largest: int = MAX_XML, suffix: str = "") -> DataFrame:
    """path, member, size and reason of what ``unzip`` leaves out: members that are too large, those of another suffix, and files that are no archive."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"], strict=True):
                if not zipfile.is_zipfile(io.BytesIO(content)):
                    out.append((path, None, len(content), "no archive"))
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir() and not info.filename.lower().endswith(suffix):
                            out.append((path, info.filename, info.file_size, "suffix"))
                        elif info.file_size > largest:
                            out.append((path, info.filename, info.file_size, "too large"))
            yield pd.DataFrame(out, columns=["path", "member", "size", "reason"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, size long, reason string")


BUNDLE = "path string, kind string, key string, version int, text string, content binary"


def read_bundles(files: DataFrame, formats: tuple[str, ...] = (FORMAT,), largest: int = MAX_BUNDLE_MEMBER) -> DataFrame:
    """What transfer bundles hold, by ``kind``: record (key: id, text: JSON), file (key, content) and problem (key: a member, text: why it is left out).

    An archive without a manifest of one of the formats raises. A member that the manifest does not list is none of the bundle's.
    """

    def members(path: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            manifest = json.loads(z.read("manifest.json")) if "manifest.json" in z.namelist() else {}
            if manifest.get("format") not in formats:
                raise ValueError(f"{path}: not a declaration bundle")
            for item in manifest.get("records", []):
                item = item if isinstance(item, dict) else {"path": item}
                text = z.read(item["path"]).decode("utf-8-sig")
                yield path, "record", item.get("epd_uid") or json.loads(text).get("epd_uid"), item.get("version"), text, None
            for key in manifest.get("files", []):
                name = f"blobs/{key}"
                if name not in z.namelist():
                    yield path, "problem", name, None, "missing", None
                elif z.getinfo(name).file_size > largest:
                    yield path, "problem", name, None, "too large", None
                else:
                    yield path, "file", key, None, None, z.read(name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BUNDLE.split(", ")]
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                rows, size = [], 0
                for row in members(path, content):
                    rows.append(row)
                    size += len(row[4] or "") + len(row[5] or b"")
                    if size > 4 << 20:
                        yield _frame(rows, names)
                        rows, size = [], 0
                yield _frame(rows, names)

    return files.select("path", "content").mapInPandas(run, BUNDLE)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"version": "Int32"})


def bundle_records(files: DataFrame) -> DataFrame:
    """path and record (JSON) of transfer bundles; archives of another format are rejected."""
    return read_bundles(files).where("kind = 'record'").select("path", F.col("text").alias("record"))


def _csv_lines(facts: DataFrame) -> DataFrame:
    """epd_uid and its facts as lines of CSV in total order; a declaration's facts are bounded by its indicators and modules."""
    line = F.to_csv(F.struct(*[F.initcap(F.col(c).cast("string")).alias(c) if c == "human_edited" else F.col(c) for c in RESULT_COLUMNS]), {"emptyValue": "", "nullValue": "", "escape": '"'})
    lines = F.array_sort(F.collect_list(F.struct("indicator", "module", "scenario", line.alias("line"))))
    return facts.groupBy("epd_uid").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\r\n").alias("lines"))


def write_bundle(
    records: DataFrame, path: str, files: DataFrame | None = None, facts: DataFrame | None = None, dictionary_version: str | None = None, bundle_bytes: int = BUNDLE_BYTES
) -> None:
    """Transfer bundles in a folder: zip files of a manifest, records, their source files and ``results_long.csv``.

    records: epd_uid, record (JSON), and optionally version and source_blob_key. files: key and content; those that
    records name are taken along. Each bundle is whole by itself, has about ``bundle_bytes`` before it is closed, and is written by
    the task that packs it, so an export has no bound and no record passes the driver. Records of one source file go
    together, so its bytes move once; those of a file with very many records are dealt over several tasks.
    """
    cols = records.columns
    rows = records.select(
        "epd_uid", "record", (F.col("version") if "version" in cols else F.lit(None)).cast("int").alias("version"), (F.col("source_blob_key") if "source_blob_key" in cols else F.lit(None)).cast("string").alias("key")
    )
    if facts is not None:
        rows = rows.join(_csv_lines(facts), "epd_uid", "left")
    else:
        rows = rows.withColumn("lines", F.lit(None).cast("string"))
    deals = rows.groupBy(F.coalesce("key", F.lit("")).alias("_key")).agg(F.ceil(F.count("*") / F.lit(RECORDS_DEALT)).cast("long").alias("_n"))
    rows = rows.withColumn("_key", F.coalesce("key", F.lit(""))).join(deals, "_key")
    own = rows.select("_key", F.pmod(F.xxhash64("epd_uid"), F.col("_n")).cast("long").alias("_deal"), F.lit(1).alias("_kind"), "epd_uid", "record", "version", "lines", F.lit(None).cast("binary").alias("content"))
    if files is not None:
        wanted = files.select(F.col("key").alias("_key"), "content").join(deals, "_key")
        none = F.lit(None).cast("string")
        own = own.unionByName(
            wanted.select("_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_deal"), F.lit(0).alias("_kind"), none.alias("epd_uid"), none.alias("record"), F.lit(None).cast("int").alias("version"), none.alias("lines"), "content")
        )
    dealt = own.repartition("_key", "_deal").sortWithinPartitions("_key", "_deal", "_kind", "epd_uid")
    packed = dealt.mapInPandas(_packer(dictionary_version, bundle_bytes), "content binary")
    # The text writer ends a row with a line feed, which the archives' own comment foresees.
    packed.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _packer(dictionary_version: str | None, bundle_bytes: int):
    header = "\ufeff" + ",".join(RESULT_COLUMNS) + "\r\n"

    class Bundle:
        def __init__(self):
            self.out = io.BytesIO()
            self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
            self.records, self.files, self.lines = [], set(), []

        def add(self, uid: str, record: str, version, lines: str | None) -> None:
            name = f"records/{quote(uid, safe=' ')}.json"
            self.zip.writestr(name, record)
            self.records.append({"epd_uid": uid, "path": name, "version": None if pd.isna(version) else int(version)})
            if lines:
                self.lines.append(lines + "\r\n")

        def add_file(self, key: str, content: bytes) -> None:
            if key not in self.files:
                self.zip.writestr(f"blobs/{key}", content)
                self.files.add(key)

        def close(self) -> bytes:
            made = datetime.now(UTC).isoformat(timespec="seconds")
            manifest = {"format": FORMAT, "schema_version": "2.0", "created_at": made, "dictionary_version": dictionary_version, "records": self.records, "files": sorted(self.files)}
            self.zip.writestr("manifest.json", json.dumps(manifest))
            self.zip.writestr("results_long.csv", header + "".join(self.lines))
            self.zip.comment = b"\n"
            self.zip.close()
            return self.out.getvalue()[:-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, held = None, (None, None)
        for f in frames:
            for key, kind, uid, record, version, lines, content in zip(*(f[c] for c in ("_key", "_kind", "epd_uid", "record", "version", "lines", "content")), strict=True):
                if kind == 0:
                    held = (key, content)
                    continue
                bundle = bundle or Bundle()
                bundle.add(uid, record, version, lines)
                if held[0] == key:
                    bundle.add_file(*held)
                if bundle.out.tell() >= bundle_bytes:
                    yield pd.DataFrame({"content": [bundle.close()]})
                    bundle = None
        if bundle:
            yield pd.DataFrame({"content": [bundle.close()]})

    return run


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array file, byte-order mark or not."""
    return spark.read.option("multiLine", "true").json(path)


def legacy_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """epd_uid, content_hash and record (JSON, as it stands) of the elements of JSON arrays, one a file or a line; an absent file has none.

    An element that is no object is left out. Ids are given as to new records: number, dataset, file or content.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "epd_uid string, content_hash string, record string")
    text = F.ltrim(F.col("value"), F.lit("\ufeff"))
    items = spark.read.option("wholetext", str(not lines).lower()).text(path).select(F.explode(F.from_json(text, "array<string>")).alias("record")).where(F.startswith("record", F.lit("{")))
    of = lambda name: F.get_json_object("record", f"$.{name}")
    uid = F.coalesce(F.nullif(of("epd_uid"), F.lit("")), record_uid(of("metadata.registration_number"), of("metadata.uuid"), of("document.sha256"), F.col("record")))
    return items.select(uid.alias("epd_uid"), F.sha2("record", 256).alias("content_hash"), "record")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Record documents, gzip or plain, from any depth."""
    return spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path).select(F.col("value").alias("record"), F.input_file_name().alias("path"))


def blob_key(kind: str, sha: Column, extension: str) -> Column:
    return F.concat(F.lit(f"{kind}/{extension.lstrip('.')}/"), F.left(sha, F.lit(2)), F.lit("/"), sha, F.lit(extension))


def record_key(uid: Column, version: Column) -> Column:
    return F.concat(F.lit("records/"), slug(uid), F.format_string("/v%04d.json.gz", version))


def write_results_csv(facts: DataFrame, path: str) -> None:
    """The fifteen columns of facts in total order; every file begins with a byte-order mark, as spreadsheets want it."""
    first, *rest = RESULT_COLUMNS
    rows = facts.select(RESULT_COLUMNS).orderBy("epd_uid", "indicator", "module", "scenario")
    rows.select(F.col(first).alias("\ufeff" + first), *rest).write.option("header", "true").option("escape", '"').csv(path)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    summary.drop("search_text").write.option("header", "true").option("escape", '"').csv(path)


def write_jsonl(records: DataFrame, path: str) -> None:
    """Names that begin with an underscore are transient and stay out."""
    records.select(*[c for c in records.columns if not c.startswith("_")]).write.option("ignoreNullFields", "false").json(path)
