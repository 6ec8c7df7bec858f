"""What the training-text operators share: scratch tables, labelled splits and small column helpers.

Scratch tables live in the folder that ``spark.checkpoint.dir`` names, which driver and
executors share, so a later read survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes in an Arrow batch (a single longer row is a batch); this bounds what a Python worker holds.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one of our own only in local mode, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.envidecl.scratch", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="envidecl-")
        spark.conf.set("spark.envidecl.scratch", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended, and its folder with it
        pass


class Scratch:
    """Tables written on the way to one result.

    ``keep`` writes a frame as Parquet and reads it back, which cuts the lineage. ``drop``
    removes a table that nothing needs any more; the rest goes when the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        atexit.register(_delete, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                _delete(self.spark, path)


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get so many bytes at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_state: dict = {}


def worker_state(key, make: Callable):
    """What ``make`` gives, kept by a Python worker until it works with another key: models and caches of one operator at a time."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` is the same and faster where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
