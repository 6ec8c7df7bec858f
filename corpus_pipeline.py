"""The corpus pipeline: documents in, packed training sequences out, stage by stage.

Every stage is written as Parquet and read again before the next one, so a lost executor
costs a part of one stage at most. Columns that documents have beside id and text pass through all stages but the last,
whatever their names; an empty table gives an empty result, and very long texts are whole in each.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envidecl.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from envidecl.llm.common import Scratch, table
from envidecl.llm.queries import BYTE_BPE


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """docs with every column but id and text under a plain number's name, those names, and what gives docs' own names and order back."""
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), names, lambda df: df.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; a null or empty text scores 0 and stays, as does every repeated row."""
    rows, _, back = _aside(docs)
    net = toxicity.fit(rows, table(spark, sf_dir, "labels"))
    return back(toxicity.score(rows, net).where(F.col("_score") < toxicity.THRESHOLD))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others keep; texts change, and lengths where docs has ``n_chars``.

    No document goes: one that loses all lines has an empty text, and a null text becomes one. Rows without an id keep their lines.
    """
    rows, names, back = _aside(docs)
    out = line_dedup.dedup_lines(rows).withColumn("text", F.col("_kept"))
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.char_length("_kept").cast(docs.schema["n_chars"].dataType))
    return back(out)


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with a ``_key`` of every row's own, in the order of ids; rows without an id come last.

    Ids are the keys unless one is missing or repeated. Of rows equal in id and text one is left.
    """
    odd = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if odd.isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), *[F.col(c) for c in docs.columns if c != "doc_id"]]
    keyed = Scratch(spark, "keyed").keep(docs.orderBy(*order).withColumn("_key", F.monotonically_increasing_id()))
    named = keyed.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "text").agg(F.min("_key").alias("_key"))
    own = named.select("_key").unionByName(keyed.where(F.col("doc_id").isNull()).select("_key"))
    return keyed.join(own, "_key", "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id. Empty texts are similar to none and stay."""
    rows, _, back = _aside(docs)
    keyed = _keyed(spark, rows)
    classes = jaccard_join.similar_classes(keyed.select(F.col("_key").alias("doc_id"), "text"))
    first = classes.where("component_id = doc_id").select(F.col("doc_id").alias("_key"))
    return back(keyed.join(first, "_key", "left_semi"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and empty texts hold none."""
    rows, _, back = _aside(docs)
    keyed = _keyed(spark, rows)
    leaks = decontaminate.find_leaks(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(leaks.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").transform(back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and places; other columns end here."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The first stage learns a classifier and the last one tokenises; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir)) if name != STAGES[-1][0] else stage(spark, docs, sf_dir)
        # Shuffle files of a stage go once its frames are collected, not with the last stage.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return docs
