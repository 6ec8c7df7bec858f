"""Spelling variant grouping: words one edit apart, by a positional q-gram index with a count filter.

Word counts are native: runs of letters are exploded, edited and counted with partial
aggregation, so only a task's distinct words are shuffled. The index is over the vocabulary.
One edit leaves the first or the last half of a word as it was (a q-gram of half its length,
at one end), so words meet in groups by length and such a half; ``LONGER`` words meet those
shorter by one. A group of more than ``block`` words is split again by halves of what is left
of its words, and so on; at one letter left, a group is bounded by the alphabet. So no
group grows with the data, however many words share a beginning.

In a group, a task holds an inverted index of what is left of its words: padded 2-grams with
their positions, apart by length. A word heap-merges the lists of its own grams at the positions
that one edit allows; those counted at least as often as the overlap bound (the longer one's
letters plus 1 grams, less the 2 that an edit can spoil) are verified on whole words. A pair that
could meet in several groups counts in one only, that of the first half if that is intact,
so a group gives each word's number of near words and the best of them, and no pairs are shuffled.

Defined results
* null or empty text: no words. A null ``doc_id`` deletes nothing from its words.
* repeated rows: every row's words count.
* ties of n: the smaller word in the order of code points.
* words of any length take part; extra columns are ignored.
* empty table, or no word often enough: an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, bounded_batches

LETTERS = "[A-Za-zÀ-ÿ]+"
#: One in so many occurrences loses a code point.
EDITED = 97
#: Words of a group that meet in one task's memory; larger groups are split by halves of what is left.
BLOCK = 256
#: Rows of groups that a task works through.
TASK_ROWS = 100_000
SHORTER, LONGER = 0, 1
_ROW = "key long, word string, n long, side int, lo int, hi int"


def occurrences(docs: DataFrame) -> DataFrame:
    """word, for each run of letters: A-Z lower-cased, and some by their document's checksum without one code point."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    lower = runs.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    crc = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    marked = lower.select("run", crc.alias("h"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return marked.select(F.when(F.col("h") % EDITED == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """word and n of the words of enough code points and occurrences."""
    return occurrences(docs).where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: under the first and under the last half of what is left of its word."""
    left = F.col("hi") - F.col("lo") - F.col("side")  # what is left of the shorter words of the group
    first = F.floor(left / 2).cast("int")
    last = left - first
    piece = lambda start, length: F.substring(F.col("word"), start + 1, length)
    key = lambda name, text: F.xxhash64("key", F.lit(name), text)
    cut = F.array(
        F.struct(key("first", piece(F.col("lo"), first)).alias("key"), (F.col("lo") + first).alias("lo"), F.col("hi").alias("hi")),
        F.struct(key("last", piece(F.col("hi") - last, last)).alias("key"), F.col("lo").alias("lo"), (F.col("hi") - last).alias("hi")),
    )
    return rows.select("word", "n", "side", F.explode(cut).alias("_c")).select("_c.key", "word", "n", "side", "_c.lo", "_c.hi")


def _one_edit(s: str, t: str, lo: int, hi: int) -> bool:
    """Whether t is s with one code point replaced or inserted, at lo or later, and not better found by an intact first half."""
    if s[:lo] != t[:lo]:
        return False
    e, end = lo, len(s)
    while e < end and s[e] == t[e]:
        e += 1
    if e >= hi and hi < end:
        return False
    return s[e + 1 :] == t[e + 1 :] and e < end if len(t) == end else s[e:] == t[e + 1 :]


def _runs(lists: list[list[int]], least: int) -> list[int]:
    """Members that so many of the sorted lists hold: a heap merge and a count of its runs."""
    return [k for k, g in groupby(heapq.merge(*lists)) if sum(1 for _ in g) >= least]


def _grams(word: str, lo: int, hi: int) -> list[tuple[int, str]]:
    """Positions and 2-grams of what is left of a word, padded on both sides by a sign that no word has."""
    padded = f"\0{word[lo:hi]}\0"
    return [(k, padded[k : k + 2]) for k in range(hi - lo + 1)]


def search(words: list[str], sides: list[int], lo: list[int], hi: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of near words among one group's."""
    index: tuple[dict, dict] = ({}, {})
    for k, side in enumerate(sides):
        if side == LONGER:
            for gram in _grams(words[k], lo[k], hi[k]):
                index[LONGER].setdefault(gram, []).append(k)
    longer = [k for k, side in enumerate(sides) if side == LONGER]
    earlier: list[int] = []
    out = []
    for k, side in enumerate(sides):
        if side == LONGER:
            continue
        grams, left = _grams(words[k], lo[k], hi[k]), hi[k] - lo[k]
        # Equal lengths: a replacement moves nothing. The longer: what follows the insertion moves by one.
        same = [index[SHORTER][g] for g in grams if g in index[SHORTER]]
        found = _runs(same, left - 1) if left > 1 else earlier
        out += [(k, c) for c in found if _one_edit(words[k], words[c], lo[k], hi[k])]
        if longer:
            moved = [index[LONGER][g] for p, x in grams for g in ((p, x), (p + 1, x)) if g in index[LONGER]]
            out += [(k, c) for c in _runs(moved, max(left, 1)) if _one_edit(words[k], words[c], lo[k], hi[k])]
        for gram in grams:
            index[SHORTER].setdefault(gram, []).append(k)
        if left <= 1:
            earlier.append(k)
    return out


def _near_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, near words counted, and the best of them, for rows sorted by key."""
    names = ["word", "n_near", "best_n", "best"]

    def told(group: list) -> dict[str, list]:
        words, n = [r[1] for r in group], [r[2] for r in group]
        near: dict[int, tuple[int, int, str]] = {}
        for a, b in search(words, [r[3] for r in group], [r[4] for r in group], [r[5] for r in group]):
            for x, y in ((a, b), (b, a)):
                count, best_n, best = near.get(x, (0, 0, ""))
                if n[y] > best_n or (n[y] == best_n and words[y] < best):
                    best_n, best = n[y], words[y]
                near[x] = (count + 1, best_n, best)
        return {words[x]: v for x, v in near.items()}

    key, group = None, []
    out: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            if row[0] != key:
                out += [(w, *v) for w, v in told(group).items()] if len(group) > 1 else []
                key, group = row[0], []
            group.append(row)
        if len(out) >= 10_000:
            yield pa.record_batch([list(c) for c in zip(*out, strict=True)], names=names)
            out = []
    out += [(w, *v) for w, v in told(group).items()] if len(group) > 1 else []
    if out:
        yield pa.record_batch([list(c) for c in zip(*out, strict=True)], names=names)


def near_words(words: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """word, n_near, best_n and best (the most frequent near word) of every word that has one; words: word, n, no word twice."""
    bounded_batches(words.sparkSession)
    length = F.char_length("word")
    sides = F.array(F.struct(F.lit(SHORTER).alias("side"), length.alias("_l")), F.struct(F.lit(LONGER).alias("side"), (length - 1).alias("_l")))
    # A single letter has no shorter half: its group is that of all single letters, and none is shorter.
    rows = words.select("word", "n", F.explode(sides).alias("_s")).where("_s._l > 0").select(
        F.xxhash64("_s._l").alias("key"), "word", "n", "_s.side", F.lit(0).alias("lo"), length.alias("hi")
    )
    results = None
    while True:
        rows = scratch.keep(_halves(rows))
        left = F.max(F.col("hi") - F.col("lo") - F.col("side"))
        groups = rows.groupBy("key").agg(F.count("*").alias("_rows"), F.min("side").alias("_least"), left.alias("_left"))
        groups = scratch.keep(groups.where(f"_rows > 1 AND _least = {SHORTER}"))
        large = (F.col("_rows") > block) & (F.col("_left") > 1)
        held = groups.agg(F.sum(F.when(~large, F.col("_rows"))), F.max(large)).first()
        tasks = max(min(rows.sparkSession.sparkContext.defaultParallelism, (held[0] or 0) // 5000), (held[0] or 0) // TASK_ROWS, 1)
        small = rows.join(groups.where(~large).select("key"), "key").repartition(tasks, "key").sortWithinPartitions("key")
        found = small.mapInArrow(_near_in_groups, "word string, n_near long, best_n long, best string")
        results = found if results is None else results.unionByName(found)
        if not held[1]:
            break
        rows = rows.join(groups.where(large).select("key"), "key")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("_b")
    return results.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("_b.n")).alias("best_n"), F.col("_b.word").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root of words with a form: each round replaces a word's target by its target's, so chains halve."""
    known = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = scratch.keep(known.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"))
        scratch.drop(known)
        if moved.where("_next IS NOT NULL").isEmpty():
            return moved.select("word", "root")
        known = scratch.keep(moved.select("word", "root"))
        scratch.drop(moved)


def variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, times: int = 2, block: int = BLOCK) -> DataFrame:
    """word, n, form, form_n, root and n_near of every word; a form is at least so many times as frequent."""
    work = Scratch(docs.sparkSession, "spelling")
    words = work.keep(vocabulary(docs, min_chars, min_count))
    near = near_words(words, work, block)
    is_form: Column = F.col("best_n") >= times * F.col("n")
    told = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    told = work.keep(told)
    root = roots(told.where("form IS NOT NULL"), work)
    return told.join(root, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
