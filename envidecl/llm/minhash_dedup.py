"""Near-duplicates by b-bit MinHash: bands give candidates, packed low bits estimate them, full sets confirm.

A document's sketch is made in one pass over its text: ``PERMUTATIONS`` minima of its shingle
set, a hash of each band of ``ROWS`` minima, and a signature of the low ``BITS`` bits of every
minimum, packed into words. Documents of equal sets are one class, which one of them
stands for. Classes that share a band meet at the bucket's smallest document; a linked pair
shares none of the 32 bands once in 10^10. Only ids and hashes are shuffled up to there; then
the texts of classes that share a bucket move to blocks of bounded size. There the bit counts of
two signatures, corrected for values that agree by chance, estimate a similarity; where that is
within ``SURE`` standard deviations of the threshold, the overlap of the full sets decides.

First each class meets the others of the bucket that most of its bands name, in blocks around the
bucket's own document; the links' components follow. Then buckets whose classes are
in several components yet are compared exhaustively, by pairs of blocks, leaving out pairs that
are linked already. So a group of near copies of any size costs a number of rows in
proportion to it. Parallel, distinct texts of which a third of a corpus would share a band
without being similar would cost pairs of blocks; their signatures thin what is compared, not
what is moved.

Defined results
* null, empty or wordless text: an empty set, linked with nothing; a component of its own.
* fewer words than a shingle has: the whole sequence is the only shingle.
* repeated rows of one id are one document; if their texts differ, it has the links of all.
* null ``doc_id``: the row is returned without a component, and kept, as nothing stands for it.
* ties: the smallest id of a component is its name and the one kept.
* very long texts are whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import Scratch, bounded_batches
from .components import components
from .jaccard_join import _copies, _overlap, _sets, _signed, _thinned, _Union

PERMUTATIONS, ROWS, BITS = 128, 4, 2
#: Estimates may fall so many standard deviations short of the threshold before a pair is given up.
SURE = 8
#: Shingles in a block of texts that meet in one task's memory.
BLOCK = 150_000
_draw = np.random.RandomState(20240311)
_TIMES = _draw.randint(0, 1 << 31, PERMUTATIONS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _draw.randint(0, 1 << 32, PERMUTATIONS, dtype=np.int64).astype(np.uint32)
_LOW = np.uint64(int("01" * (64 // BITS), 2)) if BITS == 2 else None


def minima(r: np.ndarray, s: np.ndarray, n_rows: int) -> np.ndarray:
    """PERMUTATIONS minima of the shingles of each row; r sorted. Rows without shingles get the largest value."""
    out = np.full((n_rows, PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    if not len(r):
        return out
    rows, starts = np.unique(r, return_index=True)
    x = (T.mix(s ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    for k in range(PERMUTATIONS):
        out[rows, k] = np.minimum.reduceat(x * _TIMES[k] + _PLUS[k], starts)
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every band of ROWS minima, its number included."""
    n = PERMUTATIONS // ROWS
    h = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), (len(least), n)).copy()
    for k in range(ROWS):
        h = T.mix(h * np.uint64(0x9E3779B97F4A7C15) + least[:, k::ROWS][:, :n])
    return h


def pack(least: np.ndarray) -> np.ndarray:
    """The low bits of all minima, after mixing them, in 64-bit words."""
    low = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64)
    per = 64 // BITS
    words = low.reshape(len(low), PERMUTATIONS // per, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(words, axis=2)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities from packed signatures: the share of equal values, less what chance makes equal."""
    differ = a ^ b
    differ = (differ | (differ >> np.uint64(1))) & _LOW
    equal = 1 - np.bitwise_count(differ).sum(axis=-1) / PERMUTATIONS
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """What the estimate of a pair at the threshold stays above, but for SURE standard deviations."""
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * percent / 100
    return percent / 100 - SURE * float(np.sqrt(equal * (1 - equal) / PERMUTATIONS)) / (1 - chance)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, a 128-bit hash (cls, cls2) of the shingle set and the hashes of its bands, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.parts(whole, "text"):
                r, s = _sets(b, size)
                n = np.bincount(r, minlength=b.num_rows)
                at = np.concatenate([[0], np.cumsum(n)])
                one, two = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (T.mix(s + np.uint64(11)), T.mix(s ^ np.uint64(0x5851F42D4C957F2D))))
                h = bands(minima(r, s, b.num_rows))
                where = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * h.shape[1])
                yield pa.record_batch(
                    [b.column("doc_id"), pa.array(n, pa.int64()), _signed(T.mix(one[at[1:]] - one[at[:-1]])), _signed(two[at[1:]] - two[at[:-1]]), pa.ListArray.from_arrays(where, _signed(h.ravel()))],
                    names=["doc_id", "n", "cls", "cls2", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cls long, cls2 long, bands array<long>")


def link(sets: list[np.ndarray], signatures: np.ndarray, labels: np.ndarray, sides: np.ndarray, percent: int) -> np.ndarray:
    """A component number for each of the sorted sets; equal labels are linked already.

    sides: 0 and 1 are compared with each other only; 2 with all. Of the earlier, smaller sets the
    likeliest is verified first, and a link spares all others of its component.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, signatures, side = sizes[order], signatures[order], sides[order]
    union, least = _Union(labels[order]), least_estimate(percent)
    low = np.searchsorted(sizes, -((-percent * sizes) // 100))
    for q in range(len(sets)):
        c = np.arange(low[q], q)
        c = c[(union.of[c] != union.of[q]) & ((side[c] != side[q]) | (side[c] == 2))]
        if not len(c):
            continue
        like = estimate(signatures[c], signatures[q])
        c, like = c[like >= least], like[like >= least]
        c = c[np.argsort(-like, kind="stable")]
        while len(c):
            a, b = sets[order[c[0]]], sets[order[q]]
            overlap = _overlap(a, b)
            if 100 * overlap >= percent * (len(a) + len(b) - overlap):
                union.join(int(c[0]), q)
                c = c[union.of[c] != union.of[q]]
            else:
                c = c[1:]
    out = np.empty(len(sets), np.int64)
    out[order] = union.of
    return out


def _linked(size: int, percent: int):
    """Links of labels to the smallest they reach, in one block of texts."""

    def run(block: pa.Table) -> pa.Table:
        label, side = (np.asarray(block.column(k).combine_chunks()) for k in ("label", "side"))
        sets: list[np.ndarray] = []
        signed = []
        for batch in block.combine_chunks().to_batches() if len(np.unique(label)) > 1 else []:
            r, s = _sets(batch, size)
            at = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=batch.num_rows))])
            sets += [s[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]
            signed.append(pack(minima(r, s, batch.num_rows)))
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if sets:
            group = link(sets, np.concatenate(signed), label, side, percent)
            label, first = np.unique(label, return_index=True)
            order = np.lexsort((label, group[first]))
            label, group = label[order], group[first][order]
            head = np.concatenate([[True], group[1:] != group[:-1]])
            smallest = label[np.maximum.accumulate(np.where(head, np.arange(len(label)), 0))]
            a, b = label[~head], smallest[~head]
        return pa.table({"a": a, "b": b})

    return run


def similar_classes(docs: DataFrame, percent: int = 85, size: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept, of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    work = Scratch(spark, "minhash")
    known = work.keep(sketches(docs, size))
    named = known.where("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("cls", "cls2", "n").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"))
    held = work.keep(classes.select("doc", "n", F.explode("bands").alias("band")))
    buckets = held.groupBy("band").agg(F.min("doc").alias("pivot"), F.max("doc").alias("_most")).where("pivot < _most")
    # A table of its own, so that adaptive execution can split the partition of a very common band.
    buckets = work.keep(buckets.select("band", "pivot"))
    members = work.keep(held.join(buckets, "band").groupBy("pivot", "doc", "n").agg(F.count("*").alias("shared")))
    work.drop(held, buckets)

    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    if not known.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc", "text"])
    chosen = members.select("doc").distinct()
    texts = work.keep(_thinned(texts, chosen).join(chosen, "doc"))

    def searched(rows: DataFrame) -> DataFrame:
        full = rows.join(texts, "doc").select("pivot", "block", "label", "side", "text")
        return full.groupBy("pivot", "block").applyInArrow(_linked(size, percent), "a long, b long")

    def dealt(n) -> Column:
        return F.pmod(F.xxhash64("doc"), n).cast("long")

    # First each class at one bucket, and the bucket's own document in all of its blocks.
    main = members.where("doc <> pivot").groupBy("doc", "n").agg(F.max_by("pivot", F.struct("shared", -F.col("pivot"))).alias("pivot"))
    main = main.unionByName(members.where("doc = pivot").select("doc", "n", "pivot"))
    weight = main.groupBy("pivot").agg(F.ceil(F.sum("n") / F.lit(block)).cast("long").alias("_blocks"), F.count("*").alias("_k"))
    main = main.join(weight.where("_k > 1"), "pivot")
    spread = F.when(F.col("doc") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).otherwise(F.array(dealt(F.col("_blocks"))))
    first = main.select("pivot", F.explode(spread).alias("block"), "doc", F.col("doc").alias("label"), F.lit(2).alias("side"))
    links = work.keep(searched(first).unionByName(_copies(named)))
    groups = work.keep(components(links, work))

    # Then what buckets hold of several components yet, blocks of half the weight two by two.
    labelled = work.keep(members.join(groups, F.col("doc") == F.col("node"), "left").select("pivot", "doc", "n", F.coalesce("component", "doc").alias("label")))
    home = F.min(F.when(F.col("doc") == F.col("pivot"), F.col("label"))).alias("home")
    inside = F.col("label") == F.col("home")
    open_ = labelled.groupBy("pivot").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), home, F.sum("n").alias("_n")).where("_lo < _hi")
    rest = work.keep(labelled.join(open_, "pivot").withColumn("inside", inside))
    half = F.lit(max(1, block // 2))
    blocks = lambda weight: F.greatest(F.lit(1), F.ceil(weight / half)).cast("long")
    weights = rest.groupBy("pivot").agg(
        blocks(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0))).alias("_in"), blocks(F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n")))).alias("_out")
    )
    rest = rest.join(weights, "pivot")
    width = F.col("_in") + F.col("_out")
    # Blocks 0.._out-1 lie outside the bucket's own component, the others inside. A pair of blocks x < y
    # compares the two sides, x = y all; a pair of two blocks inside has nothing to compare.
    at = F.when(F.col("inside"), F.col("_out") + dealt(F.col("_in"))).otherwise(dealt(F.col("_out")))
    rest = rest.withColumn("_at", at)
    other = F.sequence(F.lit(0).cast("long"), F.when(F.col("inside"), F.col("_out")).otherwise(width) - 1)
    met = F.transform(
        other,
        lambda y: F.struct(
            (F.least(y, F.col("_at")) * width + F.greatest(y, F.col("_at"))).alias("block"),
            F.when(y == F.col("_at"), 2).when(y < F.col("_at"), 1).otherwise(0).alias("side"),
        ),
    )
    light = F.array(F.struct(F.lit(0).cast("long").alias("block"), F.lit(2).alias("side")))
    second = rest.select("pivot", "doc", "label", F.explode(F.when(F.col("_n") <= block, light).otherwise(met)).alias("_m"))
    more = searched(second.select("pivot", "_m.block", "doc", "label", "_m.side"))
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a != b")
    final = work.keep(components(work.keep(more.unionByName(stars)), work))
    component = F.coalesce("component", "doc_id")
    return known.join(final, known["doc_id"] == final["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
