"""Best-fit packing of token sequences by large-item matching.

Documents are tokenised once, cut into pieces of at most ``capacity`` tokens, and only their
lengths, at most ``capacity`` different ones with a count each, reach the driver. There the
exact greedy packing of all pieces is worked out on counts: pieces above a third of the
capacity are matched in pairs, the longest with the longest that still fits; shorter ones,
longest first, go into the smallest gap that holds them, or else into new sequences. The
result is a short table that says, for the r-th piece of a length, its sequence and offset;
pieces are ranked within their length by their task's own numbers and the counts of the
tasks before, so no length is gathered anywhere, and meet that table in a broadcast join (its
size does not depend on the number of documents).

Tokens: a column's bytes are cut into units at places that the tokenizer's pattern never
crosses, whatever stands around them: before a white-space character that follows another
sign, after a run of letters or digits, and between signs and letters where no apostrophe is
near. White-space runs are never cut, and other scripts only at white space. A unit's hash
looks up its ids in an open-addressing table, so each distinct unit is encoded once by a
worker and nothing loops over units in Python. Texts that hold the literal of an added token
are encoded as a whole, as the tokenizer itself cuts at those first.

Defined results
* null or empty text: one piece of one token, the end token.
* the literal of an added token (<|endoftext|>) in a text becomes its single id, as the
  tokenizer's defaults have it.
* repeated rows, and rows without ``doc_id``, are documents of their own, packed each.
* a text of any length is cut, its first piece taking the remainder.
* extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens as T
from .common import Scratch, bounded_batches, worker_state

CAPACITY = 2048
END = 0
#: Units and ids that a worker keeps: 36 bytes a unit and 4 an id, 70 MB in all.
CACHED_UNITS, CACHED_IDS = 1 << 20, 1 << 23
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _nth long"

# Classes of bytes: white space, letters, digits, other visible ASCII signs, the apostrophe,
# bytes of other characters, and control characters.
WHITE, LETTER, DIGIT, SIGN, APOSTROPHE, OTHER, CONTROL = range(7)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[:128] = SIGN
    out[:32], out[127] = CONTROL, CONTROL
    out[[9, 10, 11, 12, 13, 32]] = WHITE
    out[48:58], out[65:91], out[97:123], out[39] = DIGIT, LETTER, LETTER, APOSTROPHE
    return out


def _borders() -> np.ndarray:
    """Whether a unit may begin between a byte of one class and a byte of the next."""
    out = np.zeros((7, 7), bool)
    for before in (LETTER, DIGIT, SIGN, APOSTROPHE, OTHER):
        out[before, WHITE] = True
    for after in (DIGIT, SIGN, APOSTROPHE):
        out[LETTER, after] = True
    for after in (LETTER, SIGN, APOSTROPHE):
        out[DIGIT, after] = True
    for after in (LETTER, DIGIT):
        out[SIGN, after] = True
    return out.ravel()


CLASS, BORDER = _classes(), _borders()
#: White space of more than one byte in UTF-8.
WIDE_SPACES = [chr(k).encode() for k in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE = np.array(sorted(int.from_bytes(w.rjust(3, b"\0"), "big") for w in WIDE_SPACES), np.uint32)


def unit_borders(raw: np.ndarray) -> np.ndarray:
    """For each byte of a run of UTF-8, whether a unit begins there; the first one is left open."""
    kind = CLASS[raw]
    # Latin letters of two bytes, U+00C0 to U+024F but for the signs of multiplication and division.
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC9))
    lead = lead[lead < len(raw) - 1]
    lead = lead[(raw[lead] != 0xC3) | ((raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7))]
    lead = lead[(raw[lead] != 0xC9) | (raw[lead + 1] < 0x90)]
    kind[lead] = kind[lead + 1] = LETTER
    found = np.zeros(len(raw), bool)
    found[1:] = BORDER[kind[:-1] * np.uint8(7) + kind[1:]]
    # White space after a character that is white space itself goes on with its run.
    at = np.flatnonzero((kind[:-1] == OTHER) & found[1:]) + 1
    if len(at):
        one, two, three = (np.where(at >= k, raw[np.maximum(at - k, 0)], 0).astype(np.uint32) for k in (1, 2, 3))
        found[at[np.isin(two << 8 | one, _WIDE) | np.isin(three << 16 | two << 8 | one, _WIDE)]] = False
    return found


class Table:
    """Unit hashes to slots, by linear probing; a slot says where the unit's ids lie."""

    def __init__(self, units: int = CACHED_UNITS, ids: int = CACHED_IDS):
        self.most_units, self.most_ids = units, ids
        self.clear()

    def clear(self) -> None:
        size = 2 * self.most_units
        self.key, self.slot, self.mask = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.uint64(size - 1)
        self.first, self.count = np.empty(self.most_units, np.int32), np.empty(self.most_units, np.int32)
        self.ids = np.empty(self.most_ids, np.uint32)
        self.n, self.n_ids = 0, 0

    def takes(self, h: np.ndarray, n_bytes: int) -> bool:
        """Whether there is room for as many new units as hashes, and as many ids as their bytes."""
        if self.n_ids + n_bytes > self.most_ids and self.n_ids:
            return False
        return self.n + len(h) <= self.most_units or self.n + int((self.find(h) < 0).sum()) <= self.most_units

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashes, or -1. No hash is zero."""
        at = (h & self.mask).astype(np.int64)
        held = self.key[at]
        out = np.where(held == h, self.slot[at], -1)
        rest = np.flatnonzero((held != h) & (held != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & int(self.mask)
            held = self.key[at[rest]]
            out[rest] = np.where(held == h[rest], self.slot[at[rest]], -1)
            rest = rest[(held != h[rest]) & (held != 0)]
        return out

    def add(self, h: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """New distinct hashes with the ids of their units, one after the other."""
        rest, slot = h, np.arange(self.n, self.n + len(h), dtype=np.int32)
        at = (h & self.mask).astype(np.int64)
        while len(rest):
            free = self.key[at] == 0
            # Of several that want one place, the last one written has it.
            self.key[at[free]], self.slot[at[free]] = rest[free], slot[free]
            left = self.key[at] != rest
            rest, slot, at = rest[left], slot[left], (at[left] + 1) & int(self.mask)
        after, n_ids = self.n + len(h), self.n_ids + len(ids)
        if n_ids > len(self.ids):  # a single very long unit
            self.ids = np.concatenate([self.ids[: self.n_ids], np.empty(len(ids), np.uint32)])
        self.first[self.n : after] = self.n_ids + np.cumsum(count) - count
        self.count[self.n : after], self.ids[self.n_ids : n_ids] = count, ids
        self.n, self.n_ids = after, n_ids

    def spread(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids, of units one after the other."""
        n = self.count[slots].astype(np.int64)
        total = np.cumsum(n)
        at = np.repeat(self.first[slots] - total + n, n) + np.arange(total[-1] if len(total) else 0)
        return n, self.ids[at]


class UnitEncoder:
    """Ids of whole columns, encoding each distinct unit once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_file(path), Table()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([len(x) for x in found], np.int64), np.fromiter(chain.from_iterable(found), np.uint32)

    def _chunk(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of the units that begin at ``starts``, the first at 0."""
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(T.BYTES[raw] * T.power(len(raw)), out=total[1:])
        stops = np.append(starts[1:], len(raw))
        h = T.mix((total[stops] - total[starts]) * T.power(len(raw), inverse=True)[starts])
        h[h == 0] = 1
        if not self.table.takes(h, len(raw)):
            self.table.clear()
        slots = self.table.find(h)
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh, at = np.unique(h[new], return_index=True)
            data, at = raw.tobytes(), new[at]
            self.table.add(fresh, *self._encode([data[a:b].decode() for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]))
            slots[new] = self.table.find(h[new])
        return self.table.spread(slots)

    def _whole(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Rows that hold the literal of an added token, with their ids."""
        some = np.zeros(len(column), bool)
        for t in self.added:
            some |= np.asarray(pc.match_substring(column, t).fill_null(False).to_numpy(zero_copy_only=False), bool)
        for k in np.flatnonzero(some).tolist():
            yield k, self._encode([column[k].as_py()])[1]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each row has, and all of them; null is empty."""
        whole = dict(self._whole(column))
        if whole:
            keep = np.ones(len(column), bool)
            keep[list(whole)] = False
            column = pc.if_else(pa.array(keep), column, pa.scalar("", column.type))
        raw, rows = T.buffers(column)
        counts, parts = np.zeros(len(column), np.int64), []
        lo, end = 0, len(raw)
        while lo < end:
            hi = min(lo + T.CHUNK, end)
            a, z = np.searchsorted(rows, [lo, hi])
            begins = unit_borders(raw[lo:hi])
            begins[rows[a:z] - lo] = True
            begins[0] = False
            starts = np.flatnonzero(begins)
            if hi < end and hi not in rows[z : z + 1]:
                # The last unit may go on behind the chunk.
                if not len(starts):
                    hi = self._next(raw, rows, hi)
                    starts = np.zeros(0, np.int64)
                else:
                    hi, starts = lo + int(starts[-1]), starts[:-1]
            starts = np.concatenate([[0], starts])
            n, ids = self._chunk(raw[lo:hi], starts)
            counts += np.bincount(np.searchsorted(rows, starts + lo, side="right") - 1, n, len(counts)).astype(np.int64)
            parts.append(ids)
            lo = hi
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if whole:
            before = np.concatenate([[0], np.cumsum(counts)])
            order, pieces, at = sorted(whole), [], 0
            for k in order:
                pieces += [ids[at : before[k]], whole[k]]
                at, counts[k] = int(before[k]), len(whole[k])
            ids = np.concatenate([*pieces, ids[at:]])
        return counts, ids

    @staticmethod
    def _next(raw: np.ndarray, rows: np.ndarray, at: int) -> int:
        """The end of a unit that is longer than a chunk."""
        border = int(rows[np.searchsorted(rows, at)])
        while at < border:
            stop = min(at + T.CHUNK, border)
            found = np.flatnonzero(unit_borders(raw[at - 4 : stop])[4:])
            if len(found):
                return at + int(found[0])
            at = stop
        return border


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The contract's columns of every piece; _part and _nth: the task, and the number among its pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_state(("units", tokenizer), lambda: UnitEncoder(tokenizer))
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for b in T.parts(whole, "text"):
                n, ids = encode(b.column("text"))
                n += 1
                # Every document's ids with the end token behind them.
                full = np.full(int(n.sum()), end, "<u4")
                last = np.cumsum(n) - 1
                inner = np.ones(len(full), bool)
                inner[last] = False
                full[inner] = ids
                k = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                head = n - (k - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                size = np.where(piece == 0, head[doc], capacity)
                at = (last + 1 - n)[doc] + start
                view = memoryview(full).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), size.tolist(), strict=True)]
                order = np.argsort(size, kind="stable")
                count = np.bincount(size, minlength=capacity + 1)
                nth = np.empty(len(size), np.int64)
                nth[order] = seen[size[order]] + np.arange(len(size)) - (np.cumsum(count) - count)[size[order]]
                seen += count
                yield pa.record_batch(
                    [
                        b.column("doc_id").take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(start),
                        pa.array(size),
                        pa.array(crc, pa.int64()),
                        pa.array(np.full(len(size), part, np.int32)),
                        pa.array(nth),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_nth"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class _Plan:
    """Sequences of equal fill as ranges of numbers; placements as (length, ranks, sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.used, self.next = capacity, dict(counts), dict.fromkeys(counts, 0), 0
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, number)
        self.heap: list[int] = []
        self.rows: list[tuple[int, int, int, int, int, int]] = []

    def open(self, number: int) -> int:
        self.next += number
        return self.next - number

    def place(self, length: int, each: int, first: int, number: int, offset: int) -> None:
        """``each`` pieces of a length, one after the other, into every sequence of a range."""
        took = each * number
        self.rows.append((length, self.used[length], self.used[length] + took, each, first, offset))
        self.used[length] += took
        self.left[length] -= took

    def free(self, gap: int, first: int, number: int) -> None:
        if gap and number:
            self.gaps.setdefault(gap, []).append((first, number))

    def pair(self) -> None:
        """Greedy matching of pieces above a third: each with the longest partner that fits."""
        large = sorted((n for n in self.left if 3 * n > self.capacity), reverse=True)
        for n in large:
            while self.left[n]:
                fits = [m for m in large if m <= self.capacity - n and m <= n and self.left[m] - (m == n) > 0]
                if not fits:
                    number = self.left[n]
                    first = self.open(number)
                    self.place(n, 1, first, number, 0)
                    self.free(self.capacity - n, first, number)
                    break
                m = fits[0]
                number = self.left[n] // 2 if m == n else min(self.left[n], self.left[m])
                first = self.open(number)
                if m == n:
                    self.place(n, 2, first, number, 0)
                else:
                    self.place(n, 1, first, number, 0)
                    self.place(m, 1, first, number, n)
                self.free(self.capacity - n - m, first, number)

    def fill(self) -> None:
        """Best fit of the others, longest first: the smallest gap that holds the piece."""
        for n in sorted((n for n in self.left if 3 * n <= self.capacity), reverse=True):
            fitting = [g for g in self.gaps if g >= n]
            heapq.heapify(fitting)
            while self.left[n] and fitting:
                gap = heapq.heappop(fitting)
                each = gap // n
                for first, number in self.gaps.pop(gap):
                    whole = min(number, self.left[n] // each)
                    if whole:
                        self.place(n, each, first, whole, self.capacity - gap)
                        self.free(gap - each * n, first, whole)
                    first, number, rest = first + whole, number - whole, self.left[n]
                    if number and rest:  # fewer than a sequence takes
                        self.place(n, rest, first, 1, self.capacity - gap)
                        self.free(gap - rest * n, first, 1)
                        first, number = first + 1, number - 1
                    self.free(gap, first, number)
            each = self.capacity // n
            if whole := self.left[n] // each:
                first = self.open(whole)
                self.place(n, each, first, whole, 0)
                self.free(self.capacity - each * n, first, whole)
            if rest := self.left[n]:
                first = self.open(1)
                self.place(n, rest, first, 1, 0)
                self.free(self.capacity - rest * n, first, 1)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(length, from rank, to rank, pieces in a sequence, first sequence, offset) and the number of sequences."""
    p = _Plan(counts, capacity)
    p.pair()
    p.fill()
    return p.rows, p.next


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = Scratch(spark, "packing").keep(tokenized_pieces(docs, tokenizer, capacity, end))
    # A piece's rank among all of its length: its number in its task, and what tasks before hold.
    held = pieces.groupBy(F.col("length").alias("_l"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    counts = {r["_l"]: r["n"] for r in held.groupBy("_l").agg(F.sum("_n").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    places = F.broadcast(
        spark.createDataFrame(rows, "_length long, _from long, _to long, _each long, _first long, _offset long")
    )
    before = Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("_l", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = pieces.join(bases, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.withColumn("_r", F.col("_nth") + F.col("_base"))
    put = ranked.join(
        places, (F.col("length") == F.col("_length")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to"))
    )
    nth = F.col("_r") - F.col("_from")
    return put.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_first") + F.floor(nth / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_each")) * F.col("length")).alias("offset"),
    )
