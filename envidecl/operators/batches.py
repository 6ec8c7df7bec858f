"""An append-only table whose batches appear whole, in an order that concurrent writers agree on.

A batch is written as Parquet beside the table and published by renaming its folder to the next
number. Where another writer took that number first, what to append is worked out again from
the table as it is then. What a reader or a snapshot needs is a number: the last batch it sees.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are kept apart by a hash of their key, so that a small batch reads a part of the table only.
BUCKETS = 16
ATTEMPTS = 20
_here = threading.RLock()


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


@dataclass
class Batches:
    spark: SparkSession
    path: str
    schema: str
    key: str
    #: Batches that are not seen: pairs (after, up to) that restores have put out of sight, and all after ``upto``.
    hidden: list[tuple[int, int]] = field(default_factory=list)
    upto: int | None = None

    def _fs(self):
        where = self._path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        """The numbers of all batches published, seen or not."""
        fs, root = self._fs(), self._path(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def last(self) -> int:
        """The number of the newest batch; 0 for none."""
        return max(self.numbers(), default=0)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all batches that are seen, with the column ``batch``."""
        seen = [n for n in self.numbers() if (self.upto is None or n <= self.upto) and not any(lo < n <= hi for lo, hi in self.hidden)]
        if not seen:
            return self.spark.createDataFrame([], f"{self.schema}, batch int")
        rows = self.spark.read.schema(f"{self.schema}, batch int, bucket int").option("basePath", self.path).parquet(*[f"{self.path}/batch={n}" for n in seen])
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that the keys fall into; there are no more than BUCKETS."""
        return [r["b"] for r in keys.select(bucket(F.col(self.key)).alias("b")).distinct().collect()]

    def append(self, make: Callable[[], DataFrame]) -> DataFrame:
        """Publish what ``make`` gives, reading the table as it is; it is asked again if another batch came first. Returns the batch."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        for _ in range(ATTEMPTS):
            after = self.last()
            pending = f"{self.path}/_pending-{uuid.uuid4().hex}"
            rows = make().select(*names, bucket(F.col(self.key)).alias("bucket"))
            try:
                # Rows of a bucket go to one task as long as they are few; of a large batch, buckets are split by size.
                rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(pending)
                if self._publish(pending, after + 1):
                    path = f"{self.path}/batch={after + 1}"
                    return self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).drop("bucket")
            finally:
                self._fs().delete(self._path(pending), True)
        raise RuntimeError(f"{self.path}: {ATTEMPTS} batches of other writers came first")

    def step(self) -> None:
        """Publish a batch of nothing: who has read the table before starts again."""
        for _ in range(ATTEMPTS):
            pending = f"{self.path}/_pending-{uuid.uuid4().hex}"
            self._fs().mkdirs(self._path(pending))
            try:
                if self._publish(pending, self.last() + 1):
                    return
            finally:
                self._fs().delete(self._path(pending), True)
        raise RuntimeError(f"{self.path}: {ATTEMPTS} batches of other writers came first")

    def _publish(self, pending: str, number: int) -> bool:
        """Rename to the number, unless it is taken. File systems with atomic renames decide; threads of one program take turns."""
        fs, target = self._fs(), self._path(f"{self.path}/batch={number}")
        with _here:
            if fs.exists(target):
                return False
            sc = self.spark.sparkContext
            options = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
            try:
                context.rename(self._path(pending), target, options)
            except Exception as taken:
                if "FileAlreadyExists" in str(taken) or fs.exists(target):
                    return False
                raise
        return True
