"""A versioned store of records as append-only Parquet tables; what is current is a view.

``save`` joins a batch with the current versions, tells created, updated and unchanged apart by
a content hash, and appends what changed. Archiving is a log of its own, so saving again does
not undo it. Nothing is rewritten in place, so readers never meet a half-written table. Batches
are published one after the other (``batches``), so two writers of one id get two versions,
and a snapshot is the number of the last batch of each table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import kept
from . import search
from .batches import Batches

VERSION = "epd_uid string, version int, saved_at timestamp, content_hash string, note string, record string"
FLAG = "epd_uid string, archived int, at timestamp"
BLOB = "key string, sha256 string, size long, content_type string, original_name string, created_at timestamp"
META = "key string, value string, at timestamp"
#: Schema of each table, and the column that its rows are spread by.
TABLES = {
    "versions": (f"{VERSION}, status string", "epd_uid"),
    "flags": (FLAG, "epd_uid"),
    "imports": ("epd_uid string, content_hash string, source string, at timestamp", "epd_uid"),
    "blobs": (f"{BLOB}, content binary", "key"),
    "meta": (META, "key"),
    "snapshots": ("name string, pinned string, last int, at timestamp", "name"),
    "restores": ("name string, hidden array<struct<after:int,until:int>>, at timestamp", "name"),
}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert_status(current_hash: Column, new_hash: Column) -> Column:
    return F.when(current_hash.isNull(), "created").when(current_hash == new_hash, "unchanged").otherwise("updated")


def history(versions: DataFrame) -> DataFrame:
    """Versions, newest first, each with the one before."""
    w = Window.partitionBy("epd_uid").orderBy("version")
    return versions.withColumn("previous_version", F.lag("version").over(w)).orderBy("epd_uid", F.desc("version"))


@dataclass
class Store:
    """Records, flags, blobs, notes and imports under one folder. ``upto`` pins tables to batches, as a snapshot does."""

    spark: SparkSession
    root: str
    upto: dict[str, int] | None = None

    # --- Tables ---------------------------------------------------------------------------------
    def _table(self, name: str) -> Batches:
        """A table as this store sees it: without what restores put out of sight, and not beyond its pins."""
        schema, key = TABLES[name]
        return Batches(self.spark, f"{self.root}/{name}", schema, key, self._hidden(name), None if self.upto is None else self.upto.get(name, 0))

    def _hidden(self, name: str) -> list[tuple[int, int]]:
        """What is out of sight of a table: its newest restore tells all of it."""
        if name == "restores" or not (log := self._table("restores")).last():
            return []
        told = log.read(log.touched(self.spark.createDataFrame([(name,)], "name string"))).where(F.col("name") == name)
        row = latest(told, ["name"], [F.desc("batch")]).first()
        return [(h["after"], h["until"]) for h in row["hidden"]] if row else []

    def _writes(self, name: str) -> Batches:
        if self.upto is not None:
            raise ValueError("a snapshot is read, not written")
        return self._table(name)

    def versions(self) -> DataFrame:
        return self._table("versions").read().where("status <> 'unchanged'").select(*_names(VERSION))

    def blobs(self) -> DataFrame:
        return self._table("blobs").read().select(*_names(BLOB))

    def current(self, include_archived: bool = True) -> DataFrame:
        now = latest(self.versions(), ["epd_uid"], [F.desc("version"), F.desc("saved_at")])
        flags = latest(self._table("flags").read(), ["epd_uid"], [F.desc("batch"), F.desc("at")]).select("epd_uid", "archived")
        out = now.join(flags, "epd_uid", "left").withColumn("archived", F.coalesce("archived", F.lit(0)))
        return out if include_archived else out.where("archived = 0")

    # --- Records --------------------------------------------------------------------------------
    def save(self, batch: DataFrame, note: str = "") -> DataFrame:
        """batch: epd_uid, content_hash, record. Returns epd_uid, version and status of each row.

        Several rows of one id become versions one after the other, in the order of ``ord`` if the
        batch has that column, else of their hashes; a row equal to the one before it is unchanged.
        If another writer's batch is published meanwhile, versions are counted on from that.
        """
        table = self._writes("versions")
        new = kept(batch.select("epd_uid", "content_hash", "record", F.col("ord") if "ord" in batch.columns else F.col("content_hash").alias("ord")))
        buckets = table.touched(new)

        def decide() -> DataFrame:
            have = table.read(buckets).where("status <> 'unchanged'").groupBy("epd_uid").agg(F.max(F.struct("version", "saved_at", "content_hash")).alias("_now"))
            have = have.select("epd_uid", F.col("_now.version").alias("_v"), F.col("_now.content_hash").alias("_h"))
            w = Window.partitionBy("epd_uid").orderBy("ord", "content_hash", "record")
            before = F.when(F.row_number().over(w) == 1, F.col("_h")).otherwise(F.lag("content_hash").over(w))
            both = new.join(have, "epd_uid", "left").withColumn("_before", before).withColumn("status", upsert_status(F.col("_before"), F.col("content_hash")))
            changes = F.sum((F.col("status") != "unchanged").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
            both = both.withColumn("version", (F.coalesce("_v", F.lit(0)) + changes).cast("int"))
            # What is unchanged is noted without its record, as the outcome of this save.
            return both.select(
                "epd_uid", "version", F.date_trunc("second", F.current_timestamp()).alias("saved_at"), "content_hash", F.lit(note).alias("note"), F.when(F.col("status") != "unchanged", F.col("record")).alias("record"), "status"
            )

        return table.append(decide).select("epd_uid", "version", "status")

    def append_versions(self, rows: Callable[[DataFrame], DataFrame]) -> None:
        """Rows of VERSION as ``rows`` gives them for what is current; asked again if another batch comes first."""
        self._writes("versions").append(lambda: rows(self.current()).withColumn("status", F.lit("created")))

    def archive(self, uids: DataFrame, archived: bool = True) -> None:
        rows = uids.select("epd_uid", F.lit(int(archived)).alias("archived"), F.current_timestamp().alias("at"))
        self._writes("flags").append(lambda: rows)

    def record(self, uid: str, version: int | None = None) -> DataFrame:
        if version is None:
            return self.current().where(F.col("epd_uid") == uid)
        return self.versions().where((F.col("epd_uid") == uid) & (F.col("version") == version))

    def find_by_sha(self, sha: str) -> DataFrame:
        return self.current().where(F.get_json_object("record", "$.file_sha256") == sha).select("epd_uid")

    def rebuild(self) -> DataFrame:
        """The newest version of every declaration, computed from all versions."""
        return latest(self.versions(), ["epd_uid"], [F.desc("version"), F.desc("saved_at")])

    # --- Blobs ----------------------------------------------------------------------------------
    def register_blobs(self, blobs: DataFrame) -> None:
        """Rows of BLOB, and ``content`` if it is stored here; the first writer of a key wins, whoever writes meanwhile."""
        table = self._writes("blobs")
        rows = blobs if "content" in blobs.columns else blobs.withColumn("content", F.lit(None).cast("binary"))
        new = kept(latest(rows, ["key"], [F.asc("created_at"), F.asc("sha256")]).select(*_names(BLOB), "content"))
        buckets = table.touched(new)
        table.append(lambda: new.join(table.read(buckets).select("key"), "key", "left_anti"))

    def put_blobs(self, blobs: DataFrame) -> None:
        """key, content, content_type, original_name: bytes under their key, unless the key has some.

        A key stays below the store's folder. A blob is a value of a row, so it has less than two gigabytes.
        """
        outside = F.col("key").isNull() | (F.col("key") == "") | F.startswith("key", F.lit("/")) | F.arrays_overlap(F.split("key", "[/\\\\]"), F.array(F.lit(".."), F.lit(".")))
        key = F.when(outside, F.raise_error(F.concat(F.lit("not a blob key: "), F.coalesce("key", F.lit("null")))).cast("string")).otherwise(F.col("key"))
        self.register_blobs(
            blobs.select(
                key.alias("key"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), "content_type", "original_name", F.current_timestamp().alias("created_at"), "content"
            )
        )

    def list_blobs(self, prefix: str = "", modified_after=None) -> DataFrame:
        """key, size and time of blobs whose key begins so, in the order of keys; those of that very time are left out. No bytes are read."""
        rows = self.blobs().where(F.startswith("key", F.lit(prefix)))
        rows = rows if modified_after is None else rows.where(F.col("created_at") > F.lit(modified_after).cast("timestamp"))
        return rows.select("key", "size", F.col("created_at").alias("modified")).orderBy("key")

    def get_blobs(self, keys: DataFrame) -> DataFrame:
        """key and content of the keys that have bytes here; bytes that do not have their digest raise."""
        ok = F.sha2("content", 256) == F.col("sha256")
        wrong = F.raise_error(F.concat(F.lit("a blob does not have its digest: "), "key")).cast("binary")
        held = self._table("blobs").read().where("content IS NOT NULL")
        return held.join(keys.select("key").distinct(), "key", "left_semi").select("key", F.when(ok, F.col("content")).otherwise(wrong).alias("content"))

    # --- Notes and imports ----------------------------------------------------------------------
    def set_meta(self, key: str, value: str) -> None:
        row = self.spark.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), F.current_timestamp().alias("at"))
        self._writes("meta").append(lambda: row)

    def get_meta(self, key: str) -> str | None:
        row = latest(self._table("meta").read().where(F.col("key") == key), ["key"], [F.desc("batch"), F.desc("at")]).first()
        return row["value"] if row else None

    def import_once(self, records: DataFrame, source: str, note: str = "") -> DataFrame:
        """Save records (epd_uid, content_hash, record) that were not imported before; returns epd_uid, version and status of all.

        The ledger is keyed by a record's id and content as they came, not by the file's name: a second import of the same is
        unchanged even if a reviewer has saved a newer version since, which an ordinary save would put the old content over.
        """
        new = kept(records.select("epd_uid", "content_hash", "record"))
        ledger = self._writes("imports")
        had = ledger.read(ledger.touched(new)).select("epd_uid", "content_hash").distinct()
        saved = self.save(new.join(had, ["epd_uid", "content_hash"], "left_anti"), note)
        entries = new.select("epd_uid", "content_hash", F.lit(source).alias("source"), F.current_timestamp().alias("at")).distinct()
        ledger.append(lambda: entries.join(ledger.read().select("epd_uid", "content_hash").distinct(), ["epd_uid", "content_hash"], "left_anti"))
        again = new.join(had, ["epd_uid", "content_hash"], "left_semi").join(self.current().select("epd_uid", "version"), "epd_uid", "left")
        return saved.unionByName(again.select("epd_uid", "version", F.lit("unchanged").alias("status")))

    # --- Snapshots ------------------------------------------------------------------------------
    def snapshot(self, name: str) -> None:
        """Remember the store as it is: the last batch of each table. Nothing is copied, and writers go on.

        Records are pinned before blobs, so whatever a pinned record refers to is in the snapshot.
        """
        pins = [(name, table, self._table(table).last()) for table in ("restores", *TABLES) if table != "snapshots"]
        rows = self.spark.createDataFrame(pins, "name string, pinned string, last int").withColumn("at", F.current_timestamp())
        self._writes("snapshots").append(lambda: rows)

    def snapshots(self) -> DataFrame:
        return self._table("snapshots").read().groupBy("name").agg(F.max("at").alias("at")).orderBy("at", "name")

    def _pins(self, name: str) -> dict[str, int]:
        rows = latest(self._table("snapshots").read().where(F.col("name") == name), ["pinned"], [F.desc("batch")]).collect()
        if not rows:
            raise ValueError(f"there is no snapshot {name!r}")
        return {r["pinned"]: r["last"] for r in rows}

    def at(self, name: str) -> Store:
        """The store as it was at a snapshot, to read."""
        return Store(self.spark, self.root, self._pins(name))

    def restore(self, name: str) -> None:
        """Make the store what it was at a snapshot: later batches are put out of sight, none is deleted.

        An empty batch follows in each table, so that a writer that had read the later ones starts again.
        """
        then, here = self.at(name), [table for table in TABLES if table not in ("snapshots", "restores")]
        hidden = []
        for table in here:
            was, last = then._table(table), self._table(table).last()
            hidden.append((table, [*was.hidden, (was.upto, last)]))
        rows = self.spark.createDataFrame(hidden, "name string, hidden array<struct<after:int,until:int>>").withColumn("at", F.current_timestamp())
        self._writes("restores").append(lambda: rows)
        for table in here:
            self._table(table).step()

    def backup(self, target: str, most_bytes: int | None = None, force: bool = False) -> bool:
        """A copy of what is seen now in another, empty folder; False if it is larger than ``most_bytes`` and not forced."""
        pinned = Store(self.spark, self.root, {table: self._table(table).last() for table in TABLES})
        if most_bytes is not None and not force and self._bytes() > most_bytes:
            return False
        copy = Store(self.spark, target)
        for table in TABLES:
            if table not in ("snapshots", "restores") and pinned.upto[table]:
                rows = pinned._table(table).read()
                copy._copied(table, rows)
        return True

    def _copied(self, table: str, rows: DataFrame) -> None:
        target = self._writes(table)
        if target.last():
            raise ValueError(f"{self.root} is not empty")
        if table in ("flags", "meta"):  # the order of batches tells what is latest, and the copy has one batch
            rows = latest(rows, [target.key], [F.desc("batch"), F.desc("at")])
        target.append(lambda: rows)

    def restore_backup(self, source: str) -> bool:
        """Take over a backup if this store has nothing yet."""
        if any(self._table(table).last() for table in TABLES):
            return False
        return Store(self.spark, source).backup(self.root)

    def _bytes(self) -> int:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def stats(self, summary: DataFrame, facts: DataFrame, as_of: Column | None = None) -> DataFrame:
        """The counters of a summary (``search.stats``), rows of facts, blobs and their bytes, and bytes of the store's own files."""
        held = self.blobs().agg(F.count("*").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("blob_bytes"))
        one = search.stats(summary, as_of).withColumn("_k", F.lit(1))
        for more in (facts.agg(F.count("*").alias("result_rows")), held):
            one = one.join(more.withColumn("_k", F.lit(1)), "_k")
        return one.drop("_k").withColumn("index_bytes", F.lit(self._bytes()))


def newer(documents: DataFrame, current: DataFrame) -> DataFrame:
    """Documents (epd_uid, version) that are unknown or newer than what is current."""
    top = latest(documents, ["epd_uid"], [F.desc("version")])
    have = current.select("epd_uid", F.col("version").alias("_have"))
    return top.join(have, "epd_uid", "left").where("_have IS NULL OR version > _have").drop("_have")


def import_summary(saved: DataFrame) -> DataFrame:
    return saved.groupBy("status").agg(F.count("*").alias("n"))
