"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, jaccard_join, language, licenses, line_dedup, minhash_dedup, nearest, packing, perspectives, spelling_variants, toxicity, warc_store
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
#: A parameter of the operators that tokenise.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digests(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.page_digests(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(table(spark, sf_dir, "documents"), PIECES)


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole renderings that op5 gives in segments."""
    return perspectives.transcript(perspectives.rotate(table(spark, sf_dir, "conversations")))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.similar_classes(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_licenses,
        op3_warc,
        op4_language,
        op5_perspectives,
        chat_transcripts,
        op6_nearest,
        op7_line_dedup,
        op8_jaccard_join,
        op9_packing,
        op10_decontamination,
        op11_minhash_dedup,
        op12_filter_audit,
        op13_spelling_variants,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc_store.SQL,
    "op5_perspectives": perspectives.SQL,
    "chat_transcripts": perspectives.TRANSCRIPT_SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op10_decontamination": decontaminate.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
