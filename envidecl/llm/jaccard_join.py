"""N-gram Jaccard join by T-occurrence search: classes of documents with similar shingle sets.

Two documents link when 100 |A & B| >= 80 |A | B| over distinct 5-word shingles. No link is
lost, copies are one class, and no group is ever written out as pairs:

1. Every document gets its shingle set's size and 128-bit hash; equal sets form a class with
   its smallest ``doc_id`` as representative.
2. Each class lists its shortest inverted lists: |A| - ceil(0.8 |A|) + 1 + |A| // 16 shingles,
   rare ones first (a bounded table of the most frequent shingles, counted over all documents,
   sorts last; elsewhere the hash decides). Linked classes share 1 + |B| // 16 of those, B the
   smaller; a class without so many lists that others share goes no further. A list is streamed
   by set size and falls into chains of sizes close enough to link; a chain's first class
   becomes the pivot that all its classes are sent to, so classes that may link meet there.
3. At a pivot, ``search`` answers a T-occurrence query for each class: with T the overlap
   that its size requires, the L longest inverted lists are set aside (DivideSkip), the
   others are heap-merged, classes met T - L times are looked up in the long ones by binary
   probes, and those that reach the overlap of the pair are linked. A class already in the
   same component is skipped, so a group of g near copies takes about g verifications.
4. A first round sends each class to its most frequent pivot; components are contracted; a
   second one repeats steps for all pivots whose classes are still in several components.
   Heavy pivots are split into blocks of bounded weight: the first round searches each block
   with the pivot itself added; the second one searches all blocks outside the pivot's
   component with each other and with the blocks inside.

Defined results
* null, empty or wordless text: 0 shingles, its own component.
* one to four words: the whole sequence is one shingle.
* repeated rows of one ``doc_id`` and text give repeated rows; where texts differ, each row
  keeps its size and all take the smallest component of any.
* null ``doc_id``: the row is returned with a null component.
* extra columns are ignored; an empty table gives an empty result.
* very long texts are whole; a block holds one class at least, whatever its size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import Scratch, bounded_batches
from .components import components

#: Shingles whose frequency sorts them last; 16 bytes each reach every worker.
FREQUENT = 100_000
#: A shingle counts as frequent only if a window of WINDOW shingles holds it so often.
LOCAL, WINDOW = 4, 2_000_000
#: Short lists hold a set's n // MERGED shingles more than needed to share one, so that linked sets share more.
MERGED = 16
#: Shingles in a block of classes that meet in one task's memory, at some 40 bytes each.
BLOCK = 150_000
#: Log of the bits of the filter that thins texts: 16 MB.
MOST_BITS = 27
#: How often the second round looks for pivots that closed.
CLOSINGS = 2
_SIGNED = np.int64


def required(a: int, b: int, percent: int) -> int:
    """The overlap that sets of sizes a and b need."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix(n, percent: int):
    """How many of n shingles, in one order for all sets, are a set's short lists.

    A linked set lacks n - ceil(percent n) of them at most, so of that many and MERGED-th more
    it holds the surplus, 1 + n // MERGED, counted with either set's own size.
    """
    return n - -((-percent * n) // 100) + 1 + n // MERGED


def least_lists(n: str, percent: int) -> str:
    """SQL: lists that a class of n shingles shares with any it links to; that one may be smaller."""
    return f"1 + (({n} * {percent}) div {100 * MERGED})"


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw, rows = T.buffers(batch.column("text"))
    row, _, _, h = T.words(raw, rows, T.SPACED)
    return T.shingles(row, h, batch.num_rows, size)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(_SIGNED))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, and a 128-bit hash (cls, cls2) of the shingle set, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.parts(whole, "text"):
                r, s = _sets(b, size)
                n = np.bincount(r, minlength=b.num_rows)
                at = np.concatenate([[0], np.cumsum(n)])
                one, two = (
                    np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                    for x in (T.mix(s + np.uint64(11)), T.mix(s ^ np.uint64(0x5851F42D4C957F2D)))
                )
                yield pa.record_batch(
                    [b.column("doc_id"), pa.array(n, pa.int64()), _signed(T.mix(one[at[1:]] - one[at[:-1]])), _signed(two[at[1:]] - two[at[:-1]])],
                    names=["doc_id", "n", "cls", "cls2"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, cls long, cls2 long")


def frequent_shingles(docs: DataFrame, size: int, scratch: Scratch, most: int = FREQUENT) -> np.ndarray:
    """Up to ``most`` of the most frequent shingles, sorted by hash, each with its rank (0: rarest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([_signed(s[n >= LOCAL]), pa.array(n[n >= LOCAL], pa.int64())], names=["token", "n"])

        for whole in batches:
            for b in T.parts(whole, "text"):
                held.append(_sets(b, size)[1])
                if sum(map(len, held)) >= WINDOW:
                    yield flush()
        if held:
            yield flush()

    counted = scratch.keep(docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    # The lowest count, on a scale of steps of a sixteenth of a doubling, that at most `most` shingles reach.
    step = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, None
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), reverse=True):
        held += r["k"]
        if held > most:
            break
        least = r["step"]
    top = counted.where(step >= least if least is not None else F.lit(False)).select("token", "n").toArrow()
    scratch.drop(counted)
    token, n = (np.asarray(top[c].combine_chunks()).astype(np.int64) for c in ("token", "n"))
    token = token[np.lexsort((token, -n))].view(np.uint64)
    order = np.argsort(token)
    return np.stack([token[order], (len(token) - 1 - order).astype(np.uint64)])


def _order(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """0 for a rare shingle, 1 and more for frequent ones, the most frequent last."""
    token, rank = frequent
    if not len(token):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
    return np.where(token[at] == s, rank[at].astype(np.int64) + 1, 0)


def short_lists(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(token, cls): the inverted lists, by class, that linked classes must share one of."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.parts(whole, "text"):
                r, s = _sets(b, size)
                n = np.bincount(r, minlength=b.num_rows)
                at = np.concatenate([[0], np.cumsum(n)])
                one = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(s + np.uint64(11)), dtype=np.uint64)])
                cls = T.mix(one[at[1:]] - one[at[:-1]])
                # One of the rows with an equal set is enough.
                _, first = np.unique(cls, return_index=True)
                chosen = np.zeros(b.num_rows, bool)
                chosen[first] = True
                keep = chosen[r]
                r, s = r[keep], s[keep]
                order = np.lexsort((s, _order(s, shared.value), r))
                r, s = r[order], s[order]
                count = np.bincount(r, minlength=b.num_rows)
                place = np.arange(len(r)) - (np.cumsum(count) - count)[r]
                early = place < prefix(count, percent)[r]
                r = r[early]
                yield pa.record_batch([_signed(s[early]), pa.array(n[r], pa.int32()), _signed(cls[r])], names=["token", "n", "cls"])

    return docs.select("text").mapInArrow(run, "token long, n int, cls long")


def _pivots(percent: int):
    """(cls, pivot, lists) from rows sorted by token, n, cls.

    A list falls into chains in which each size is close enough to the one before; only sets of
    one chain can be similar. All classes of a chain go to its first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, size, pivot = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            t, n, c = (np.asarray(b.column(k)) for k in ("token", "n", "cls"))
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, n, c = t[fresh], n[fresh], c[fresh]
            heads = np.ones(len(t), bool)
            heads[1:] = (t[1:] != t[:-1]) | (100 * n[:-1] < percent * n[1:])
            heads[0] = token is None or t[0] != token or 100 * size < percent * n[0]
            first = np.maximum.accumulate(np.where(heads, np.arange(len(t)), -1))
            p = np.where(first >= 0, c[np.maximum(first, 0)], 0 if pivot is None else pivot)
            token, size, pivot = t[-1], n[-1], p[-1]
            rest = ~heads & (c != p)
            # A chain's first class is a member of it too, wherever there is a second one.
            _, chain = np.unique(first[rest], return_index=True)
            own, of_own = np.unique(p[rest][chain], return_counts=True)
            c, p = c[rest], p[rest]
            if not len(c):
                continue
            order = np.lexsort((c, p))
            c, p = c[order], p[order]
            new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (p[1:] != p[:-1])]))
            count = np.diff(np.append(new, len(c)))
            yield pa.record_batch(
                [pa.array(np.concatenate([c[new], own])), pa.array(np.concatenate([p[new], own])), pa.array(np.concatenate([count, of_own]))],
                names=["cls", "pivot", "lists"],
            )

    return run


class _Union:
    """Components of 0..n-1; the smaller of two is relabelled, so all joins take n log n steps."""

    def __init__(self, labels: np.ndarray):
        _, self.of = np.unique(labels, return_inverse=True)
        order = np.argsort(self.of, kind="stable")
        self.members = dict(enumerate(np.split(order, np.flatnonzero(np.diff(self.of[order])) + 1)))

    def join(self, a: int, b: int) -> None:
        x, y = int(self.of[a]), int(self.of[b])
        if x != y:
            if len(self.members[x]) < len(self.members[y]):
                x, y = y, x
            less = self.members.pop(y)
            self.of[less] = x
            self.members[x] = np.concatenate([self.members[x], less])


def _merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists and how many lists hold each: by a heap where they are short, else by one sort of their runs."""
    if sum(map(len, lists)) <= 256:
        runs = [(k, sum(1 for _ in g)) for k, g in groupby(heapq.merge(*(x.tolist() for x in lists)))]
        return np.array([k for k, _ in runs], np.int64), np.array([c for _, c in runs], np.int64)
    all_ = np.sort(np.concatenate(lists), kind="stable")
    head = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
    return all_[head], np.diff(np.append(head, len(all_)))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Values of a that sorted b holds, by binary probes."""
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def search(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, percent: int) -> np.ndarray:
    """A component number for each of the sorted sets, by DivideSkip; equal labels are linked already.

    sides: 0 and 1 are compared with each other only; 2 with all. Sets ask in the order of
    their sizes for earlier ones. A list all of whose earlier members are in one component is
    left out for a set of that component, as nothing new can come of it; so in a group of near
    copies a set asks no list once it is linked to one of them.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    rank = np.argsort(sizes, kind="stable")
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    token = np.concatenate([sets[i] for i in rank])
    owner = np.repeat(np.arange(n), sizes[rank])
    order = np.lexsort((owner, token))
    owner_of = np.empty(len(token), np.int64)
    head = np.ones(len(token), bool)
    head[1:] = token[order[1:]] != token[order[:-1]]
    owner_of[order] = np.cumsum(head) - 1  # the list of each set's each member
    borders = np.append(np.flatnonzero(head), len(token))
    owner = owner[order]
    length = np.diff(borders)
    starts = np.concatenate([[0], np.cumsum(sizes[rank])])
    ordered, size_of = [sets[i] for i in rank], sizes[rank]
    union, side = _Union(labels[rank]), sides[rank]
    first = np.full(len(length), -1, np.int64)  # an earlier member of each list
    last = np.full(len(length), -1, np.int64)  # and the latest one
    mixed = np.zeros(len(length), bool)  # whether the earlier members were in several components
    low = np.searchsorted(size_of, -((-percent * size_of) // 100))

    def meets(a: int, b: int) -> bool:
        return side[a] != side[b] or side[a] == 2

    def linked(q: int, c: int, overlap: int) -> bool:
        return 100 * overlap >= percent * (size_of[q] + size_of[c] - overlap)

    for q in range(n):
        at = owner_of[starts[q] : starts[q + 1]]
        if low[q] < q:
            # The set that most of the lists met last is the likeliest link.
            near = last[at]
            near = near[near >= low[q]]
            if len(near):
                c = int(np.bincount(near - low[q]).argmax() + low[q]) if q - low[q] < 4 * len(near) else int(near[len(near) // 2])
                if union.of[c] != union.of[q] and meets(q, c) and linked(q, c, _overlap(ordered[q], ordered[c])):
                    union.join(c, q)
            _ask(q, at, int(low[q]), ordered, size_of, owner, borders, length, union, side, first, mixed, percent)
        held = first[at]
        apart = (held >= 0) & (union.of[held] != union.of[q])
        mixed[at[apart]] = True
        first[at[held < 0]] = q
        last[at] = q
    return union.of[place]


def _ask(q, at, low, ordered, size_of, owner, borders, length, union, side, first, mixed, percent) -> None:
    """One T-occurrence query of ``search``: links set q to all earlier components that it reaches."""
    mine, m = ordered[q], int(size_of[q])
    t = -((-percent * m) // 100)  # the least overlap with any set of an allowed size up to m
    by_length = np.argsort(length[at], kind="stable")
    n_long = min(t - 1, int(t / (0.01 * np.log2(max(2, int(length[at].max()))) + 1)))
    short, long_ = by_length[: m - n_long], by_length[m - n_long :]
    k = at[short]
    k = k[(length[k] > 1) & (first[k] >= 0) & (mixed[k] | (union.of[first[k]] != union.of[q]))]
    if not len(k):
        return
    other, seen = _merge([owner[borders[x] : borders[x + 1]] for x in k.tolist()])
    good = (other < q) & (other >= low) & (seen >= t - n_long)
    other, seen = other[good], seen[good]
    good = ((side[other] != side[q]) | (side[other] == 2)) & (union.of[other] != union.of[q])
    other, seen = other[good], seen[good]
    # The likeliest first, as a link spares all others of its component.
    go = np.argsort(-seen, kind="stable")
    other, seen = other[go], seen[go]
    probes = np.sort(mine[long_])
    while len(other):
        c = int(other[0])
        # Members outside the component of q are in no list that was left out, so the count is whole.
        overlap = int(seen[0]) + _overlap(probes, ordered[c])
        if 100 * overlap >= percent * (m + len(ordered[c]) - overlap):
            union.join(c, q)
            away = union.of[other] != union.of[q]
            other, seen = other[away], seen[away]
        else:
            other, seen = other[1:], seen[1:]


def _search_blocks(size: int, percent: int):
    """Links of labels to the smallest they reach, for rows sorted by pivot and block."""

    def links(labels: list, sides: list, sets: list[np.ndarray]) -> pa.RecordBatch | None:
        label = np.concatenate(labels)
        if label.min() == label.max():
            return None
        group = search(sets, label, np.concatenate(sides), percent)
        label, at = np.unique(label, return_index=True)
        order = np.lexsort((label, group[at]))
        label, group = label[order], group[at][order]
        head = np.ones(len(label), bool)
        head[1:] = group[1:] != group[:-1]
        least = label[np.maximum.accumulate(np.where(head, np.arange(len(label)), 0))]
        if head.all():
            return None
        return pa.record_batch([pa.array(label[~head]), pa.array(least[~head])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, labels, sides, sets = None, [], [], []
        for whole in batches:
            for b in T.parts(whole, "text"):
                r, s = _sets(b, size)
                at = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=b.num_rows))])
                pivot, block, label, side = (np.asarray(b.column(k)) for k in range(4))
                new = np.ones(b.num_rows, bool)
                new[1:] = (pivot[1:] != pivot[:-1]) | (block[1:] != block[:-1])
                cuts = [*np.flatnonzero(new).tolist(), b.num_rows]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    this = (int(pivot[lo]), int(block[lo]))
                    if this != key:
                        if sets and (out := links(labels, sides, sets)):
                            yield out
                        key, labels, sides, sets = this, [], [], []
                    labels.append(label[lo:hi]), sides.append(side[lo:hi])
                    sets.extend(s[at[k] : at[k + 1]].copy() for k in range(lo, hi))
        if sets and (out := links(labels, sides, sets)):
            yield out

    return run


def similar_classes(docs: DataFrame, percent: int = 80, size: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    work = Scratch(spark, "jaccard")
    known = work.keep(signatures(docs, size))
    named = known.where("n > 0 AND doc_id IS NOT NULL")
    classes = work.keep(named.groupBy("cls", "cls2", "n").agg(F.min("doc_id").alias("doc")))

    frequent = frequent_shingles(docs, size, work)
    lists = short_lists(docs.where(F.col("doc_id").isNotNull()), size, percent, frequent)
    lists = lists.repartition("token").sortWithinPartitions("token", "n", "cls")
    sent = lists.mapInArrow(_pivots(percent), "cls long, pivot long, lists long").groupBy("cls", "pivot").agg(F.sum("lists").alias("lists"))
    sent = work.keep(sent)
    # Linked classes share a number of lists that grows with their size; who has fewer has no link.
    rich = sent.groupBy("cls").agg(F.sum("lists").alias("all_lists"))
    able = classes.join(rich, "cls").where(f"all_lists >= {least_lists('n', percent)}").select("cls", "doc", "n")
    members = work.keep(sent.join(able, "cls"))
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    if not known.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc", "text"])
    chosen = members.select("doc").distinct()
    # An inner join, as the optimiser would push a semi join below the filter that thins.
    texts = work.keep(_thinned(texts, chosen).join(chosen, "doc"))

    def searched(rows: DataFrame) -> DataFrame:
        full = rows.join(texts, "doc").select("pivot", "block", "label", "side", "text")
        dealt = full.repartition("pivot", "block").sortWithinPartitions("pivot", "block")
        return dealt.mapInArrow(_search_blocks(size, percent), "a long, b long")

    # First round: each class at the pivot that most of its lists name.
    main = members.groupBy("cls", "doc", "n").agg(F.max_by("pivot", F.struct("lists", -F.col("pivot"))).alias("pivot"))
    main = main.where("cls != pivot").unionByName(members.where("cls = pivot").select("cls", "doc", "n", "pivot"))
    weight = main.groupBy("pivot").agg(F.sum("n").alias("w"), F.count("*").alias("k")).where("k > 1")
    n_blocks = F.ceil(F.col("w") / F.lit(block)).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("doc"), n)
    main = main.join(weight, "pivot").withColumn("_n", n_blocks)
    spread = F.when(F.col("cls") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)).otherwise(
        F.array(deal(F.col("_n")).cast("long"))
    )
    first = main.select("pivot", F.explode(spread).alias("block"), "doc", F.col("doc").alias("label"), F.lit(2).alias("side"))
    copies = _copies(named)
    links = work.keep(searched(first).unionByName(copies))
    groups = work.keep(components(links, work))

    # Second round: pivots whose classes are in several components yet.
    labelled = members.join(groups, F.col("doc") == F.col("node"), "left").select(
        "cls", "pivot", "lists", "doc", "n", F.coalesce("component", "doc").alias("label")
    )
    labelled = work.keep(labelled)
    # Only lists at such pivots can tell of a new link; who has too few of them is out, and with it pivots may close.
    for _ in range(CLOSINGS):
        still = _open(labelled).select("pivot")
        labelled = labelled.join(still, "pivot", "left_semi")
        able = labelled.groupBy("cls", "n").agg(F.sum("lists").alias("all_lists")).where(f"all_lists >= {least_lists('n', percent)}")
        labelled = work.keep(labelled.join(able.select("cls"), "cls", "left_semi"))
    open_ = _open(labelled)
    rest = labelled.join(open_, "pivot").withColumn("inside", F.col("label") == F.col("home"))
    weights = rest.groupBy("pivot").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("wi"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("wo"),
    )
    # A light pivot is one block; else blocks of half the weight meet two by two.
    half = F.lit(max(1, block // 2))
    weights = weights.select(
        "pivot",
        (F.col("wi") + F.col("wo") <= block).alias("light"),
        F.greatest(F.lit(1), F.ceil(F.col("wi") / half)).cast("long").alias("ni"),
        F.greatest(F.lit(1), F.ceil(F.col("wo") / half)).cast("long").alias("no"),
    )
    rest = rest.join(weights, "pivot")
    mine = deal(F.when(F.col("inside"), F.col("ni")).otherwise(F.col("no")))
    rest = rest.withColumn("at", mine)
    width = F.col("ni") + F.col("no")
    # Blocks 0..no-1 lie outside, no..no+ni-1 inside the home component. The pair (x, y), x < no
    # and x <= y, is numbered x * width + y; a pair of equals compares all, others both sides.
    up_to = F.sequence(F.lit(0).cast("long"), F.col("no") - 1)
    pairs = (
        F.when(F.col("light"), F.array(F.struct(F.lit(0).cast("long").alias("block"), F.lit(2).alias("side"))))
        .when(F.col("inside"), F.transform(up_to, lambda x: F.struct((x * width + F.col("no") + F.col("at")).alias("block"), F.lit(1).alias("side"))))
        .otherwise(
            F.transform(
                F.sequence(F.lit(0).cast("long"), width - 1),
                lambda y: F.struct(
                    F.when((y < F.col("no")) & (y < F.col("at")), y * width + F.col("at")).otherwise(F.col("at") * width + y).alias("block"),
                    F.when(y == F.col("at"), 2).when((y < F.col("no")) & (y < F.col("at")), 1).otherwise(0).alias("side"),
                ),
            )
        )
    )
    second = rest.select("pivot", "doc", "label", F.explode(pairs).alias("_p")).select(
        "pivot", F.col("_p.block").alias("block"), "doc", "label", F.col("_p.side").alias("side")
    )
    more = searched(second)
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a != b")
    final = work.keep(components(more.unionByName(stars), work))
    return known.join(final, known["doc_id"] == final["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def _open(labelled: DataFrame) -> DataFrame:
    """Pivots whose classes are in several components, and the pivot's own (or else the smallest)."""
    home = F.coalesce(F.min(F.when(F.col("cls") == F.col("pivot"), F.col("label"))), F.min("label"))
    found = labelled.groupBy("pivot").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), home.alias("home"))
    return found.where("lo != hi").select("pivot", "home")


def _thinned(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """texts without most rows that are not chosen, before they are shuffled.

    A bit per hashed id, in blocks of 4 KB: 16 bits per chosen id, and 16 MB in all at most,
    whatever the data. Beyond that more rows pass; the join that follows is exact anyway.
    """
    bits = 1 << min(MOST_BITS, max(16, (16 * chosen.count()).bit_length()))
    spot = F.pmod(F.xxhash64("doc"), F.lit(bits))
    at = {"_block": F.floor(spot / F.lit(32768)).cast("long"), "_bit": spot % 32768}
    maps = chosen.withColumns(at).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = texts.withColumns(at).join(F.broadcast(maps), "_block").where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1)
    return held.select(*texts.columns)


def _copies(named: DataFrame) -> DataFrame:
    """Links of every document to its class's representative."""
    least = named.groupBy("cls", "cls2", "n").agg(F.min("doc_id").alias("b"))
    return named.join(least, ["cls", "cls2", "n"]).where("doc_id != b").select(F.col("doc_id").alias("a"), "b")
