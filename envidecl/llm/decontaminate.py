"""Benchmark decontamination: short test items inside long documents.

Items fall into partitions by the size of their shingle set (powers of two). Each partition
has its own bottom-k MinHash sketch size, the smallest that cannot miss an item of any size in
it: of an item with m shingles a document with containment t may lack m - ceil(t m), so one more
than that, with the smallest hashes, must share one with every such document. Documents are
exploded to their shingle hashes and probe the sketches alone; an item whose sketch no shingle
of a document hits is no candidate. Only documents with candidates are read again, and only
their candidates are verified by exact shingle containment.
Plain MinHash banding would miss short items in long documents, as their Jaccard similarity
falls with the document's length; the bottom-k form has the full recall.

All is DataFrame functions. Items are broadcast only while their measured number of
shingles is within ``broadcast_shingles``; beyond that both sides are shuffled on the hash.
What matches is counted per (document, item) with partial aggregation, so a passage that
a third of all documents hold still spreads over the cluster.

Defined results
* words: runs of letters and digits, lower-cased; a shingle is five of them.
* items of one to four words count as one shingle of that many words; null, empty and
  wordless items match nothing, and null ids of either side take no part.
* null or empty text matches nothing; repeated rows count once; equal items each match.
* extra columns are ignored here; the caller joins on ``doc_id``.
* empty table: an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 5
#: Items' shingles that may be broadcast: at 40 bytes each, 40 MB.
BROADCAST_SHINGLES = 1_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; none if there are fewer words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - F.lit(size - 1)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size)))


def item_shingles(items: DataFrame, threshold: float, size: int) -> DataFrame:
    """item_id, n of words in a shingle, m of distinct shingles, hash, and whether the sketch holds it."""
    w = items.where(F.col("item_id").isNotNull()).select("item_id", _words(F.col("text")).alias("_w"))
    w = w.where(F.size("_w") > 0).withColumn("_n", F.least(F.size("_w"), F.lit(size)))
    by_size = F.when(F.col("_n") == size, _shingles(F.col("_w"), size)).otherwise(F.array(F.xxhash64(F.col("_w"))))
    w = w.select("item_id", "_n", F.array_sort(F.array_distinct(by_size)).alias("_s"))
    m = F.size("_s")
    # The partition of sizes 2^p .. 2^(p+1)-1 takes the sketch of its largest member.
    top = F.pow(F.lit(2), F.floor(F.log2(m)) + 1) - 1
    sketch = F.least((top - F.ceil(top * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int"), m)
    return w.select(
        "item_id", "_n", m.alias("_m"), sketch.alias("_k"), F.posexplode("_s").alias("_pos", "_h")
    ).select("item_id", "_n", "_m", "_h", (F.col("_pos") < F.col("_k")).alias("_in"))


def _exploded(texts: DataFrame, lengths: list[int], *also: str) -> DataFrame:
    """doc_id, other columns, and every shingle hash with its number of words."""
    w = texts.select("doc_id", *also, _words(F.col("text")).alias("_w"))
    of = lambda n: lambda h: F.struct(h.alias("_h"), F.lit(n).alias("_n"))
    each = [F.transform(_shingles(F.col("_w"), n), of(n)) for n in lengths]
    # A text of fewer words has no shingles: null, which concat would make of all.
    some = F.concat(*[F.coalesce(x, F.array().cast("array<struct<_h:bigint,_n:int>>")) for x in each])
    return w.select("doc_id", *also, F.explode(some).alias("_x")).select("doc_id", *also, "_x._h", "_x._n")


def candidates(texts: DataFrame, sketches: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id and item_id wherever a document holds a shingle of an item's sketch."""
    return _exploded(texts, lengths).join(sketches, ["_h", "_n"]).select("doc_id", "item_id").distinct()


def find_leaks(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = SIZE, broadcast_shingles: int = BROADCAST_SHINGLES
) -> DataFrame:
    """doc_id, item_id, shared and item shingles, containment of every pair at the threshold."""
    wanted = item_shingles(items, threshold, size)
    held = wanted.groupBy().agg(F.count("*").alias("n"), F.collect_set("_n").alias("lengths")).first()
    lengths = sorted({*(held["lengths"] or []), size})
    near = (lambda x: F.broadcast(x)) if held["n"] <= broadcast_shingles else (lambda x: x)
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    sketches = near(wanted.where("_in").select("item_id", "_n", "_h"))
    found = candidates(texts, sketches, lengths)
    # One row of a document's candidates, so that it is exploded once; an item's number bounds it.
    named = found.groupBy("doc_id").agg(F.collect_set("item_id").alias("_items"))
    chosen = _exploded(texts.join(named, "doc_id"), lengths, "_items")
    return (
        chosen.join(near(wanted.select("item_id", "_n", "_m", "_h")), ["_h", "_n"])
        .where(F.array_contains("_items", F.col("item_id")))
        .select("doc_id", "item_id", "_m", "_h")
        .distinct()
        .groupBy("doc_id", "item_id", "_m")
        .agg(F.count("*").alias("shared"))
        .withColumn("item_shingles", F.col("_m").cast("long"))
        .where(F.col("shared") >= F.col("item_shingles") * F.lit(threshold) - 1e-9)
        .select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))
    )


def clean(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """docs without those that hold a test item."""
    return docs.join(find_leaks(docs, items, **kw).select("doc_id").distinct(), "doc_id", "left_anti")


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
            FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
       FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 5) AS n FROM iw WHERE len(w) > 0),
isx AS (SELECT DISTINCT item_id, least(len(w), 5) AS n,
               unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
        FROM iw WHERE len(w) > 0),
size_ AS (SELECT item_id, count(*) AS m FROM isx GROUP BY item_id),
dsx AS (SELECT DISTINCT doc_id, n,
               unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
        FROM dw, lens)
SELECT d.doc_id, i.item_id, count(*) AS shared, any_value(z.m) AS item_shingles, count(*) / any_value(z.m) AS containment
FROM dsx d JOIN isx i ON d.s = i.s AND d.n = i.n JOIN size_ z ON z.item_id = i.item_id
GROUP BY d.doc_id, i.item_id HAVING count(*) >= 0.8 * any_value(z.m)
"""
