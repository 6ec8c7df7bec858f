"""Session defaults: UTC, adaptive execution, and nothing sized by hand that Spark sizes at run time."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "envidecl", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is; nothing happens where the session has ended and its folder with it."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        pass


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session's below that which spark.checkpoint.dir names, deleted when the program ends.

    In local mode, where that is unset, one temporary folder takes its place.
    """
    if mine := spark.conf.get("spark.envidecl.shared", None):
        return mine
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    mine = f"{found.rstrip('/')}/envidecl-{uuid.uuid4().hex}" if found else "file://" + tempfile.mkdtemp(prefix="envidecl-")
    spark.conf.set("spark.envidecl.shared", mine)
    atexit.register(delete, spark, mine)
    return mine


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for a broadcast if it has so many rows at most; beyond that a shuffle join meets it."""
    return broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of a kept table up to which Spark may broadcast it of its own accord.
FEW = 10_000


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: what made it runs once, and its lineage ends here.

    Spark takes a table for as large as its files, and rows that are much alike take a hundredth of their memory there.
    So that they are not broadcast through the driver, joins of larger tables are told to sort and merge.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    return rows if rows.limit(FEW + 1).count() <= FEW else rows.hint("merge")
