"""Line dedup: lines that several documents share go, except in one document.

Lines are exploded as (document, hash of the normalised line); a hash found in ``min_docs``
documents or more loses its lines everywhere but in the largest ``doc_id`` holding it, and
the rest is put together again in the order of its positions. Everything is DataFrame
functions. Only 16-byte hashes and ids are shuffled to count; texts move once, to meet the
hashes that they lose, and not at all where those are few enough for a broadcast, which
adaptive execution decides by their measured size. A very common line meets its documents
in a join whose large partitions Spark splits.

Defined results
* null or empty text: one empty line, kept.
* null ``doc_id``: such rows count for nothing and keep all lines.
* repeated rows: they count as one document, and all of them lose the same lines.
* ties: the keeper is one document, the largest id; it keeps all its copies of the line.
* extra columns pass through; names used inside begin with two underscores.
* empty table: an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with ``_n_lines``, ``_n_dropped`` and ``_kept``, the text without dropped lines.

    Columns of these names that docs already has are replaced.
    """
    docs = docs.drop("_n_lines", "_n_dropped", "_kept")
    long_keys = F.filter(F.transform(_lines(F.col("text")), _key), lambda k: F.char_length(k) >= min_chars)
    seen = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.explode(F.array_distinct(F.transform(long_keys, _hash))).alias("__line")
    )
    # Read twice, to count and to find who loses lines, so written once: 16 bytes a line instead of its text.
    work = Scratch(docs.sparkSession, "lines")
    seen = work.keep(seen)
    common = (
        seen.groupBy("__line")
        .agg(F.count_distinct("doc_id").alias("__n"), F.max("doc_id").alias("__keeper"))
        .where(F.col("__n") >= min_docs)
        .select("__line", "__keeper")
    )
    # A table of its own: adaptive execution then splits the partition of a very common line.
    common = work.keep(common)
    lost = (
        seen.join(common, "__line")
        .where(F.col("doc_id") != F.col("__keeper"))
        .groupBy("doc_id")
        .agg(F.collect_set("__line").alias("__lost"))
    )
    stays = lambda line: ~F.array_contains(F.col("__lost"), _hash(_key(line)))
    kept = F.when(F.col("__lost").isNull(), F.col("__lines")).otherwise(F.filter("__lines", stays))
    joined = docs.withColumn("__lines", _lines(F.col("text"))).join(lost, "doc_id", "left").withColumn("__left", kept)
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("__lines").cast("long").alias("_n_lines"),
        (F.size("__lines") - F.size("__left")).cast("long").alias("_n_dropped"),
        F.array_join("__left", "\n").alias("_kept"),
    )


def line_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``dedup_lines``."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split_ AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows_),
keyed AS (SELECT r, doc_id, line, pos,
                 translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split_),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
           GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT y.*, c.keeper IS NOT NULL AND y.doc_id <> c.keeper AS gone
           FROM keyed y LEFT JOIN common c ON y.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
