"""Words and word shingles of whole Arrow columns, hashed without a Python loop over words.

A column's UTF-8 buffer is scanned in chunks cut at separators. Each byte is folded, word
borders come from a table of separators, and a word's 64-bit hash is a difference of
prefix sums of a polynomial in an odd base modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTES = np.random.RandomState(20240229).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    key = str(base)
    have = _powers.get(key, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[key] = have
    return have[:n]


def power(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash's base, or of its inverse."""
    return _power(_INVERSE if inverse else _BASE, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Alphabet:
    """What separates words and how bytes are folded before hashing."""

    def __init__(self, separators: bytes):
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        self.word = ~self.separator[self.fold]
        self.value = BYTES[self.fold]


#: Words between white space, A-Z lower-cased.
SPACED = Alphabet(bytes([32, *range(9, 14)]))
#: Words of digits, letters and all that is not ASCII, A-Z lower-cased.
ALNUM = Alphabet(bytes([*range(0, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
ALNUM.word[65:91] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, where, data = column.buffers()
    starts = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def words(raw: np.ndarray, rows: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, start, stop and hash of every word, in order."""
    out: list[tuple] = []
    lo, end = 0, len(raw)
    while lo < end:
        hi = min(lo + CHUNK, end)
        if hi < end:
            hi = _cut(raw, rows, lo, hi, alphabet)
        b = raw[lo:hi]
        inside = alphabet.word[b]
        first = np.zeros(hi - lo + 1, bool)
        first[-1] = True
        a, z = np.searchsorted(rows, [lo, hi])
        first[rows[a:z] - lo] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:-1]
        s, t = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(alphabet.value[b] * _power(_BASE, hi - lo), out=total[1:])
        h = mix((total[t] - total[s]) * _power(_INVERSE, hi - lo)[s])
        out.append((np.searchsorted(rows, s + lo, side="right") - 1, s + lo, t + lo, h))
        lo = hi
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cut(raw: np.ndarray, rows: np.ndarray, lo: int, hi: int, alphabet: Alphabet) -> int:
    """The last place up to hi where no word is cut, or else the first one after it."""
    back = raw[max(lo, hi - 4096) : hi]
    free = np.flatnonzero(~alphabet.word[back])
    if len(free):
        return max(lo, hi - 4096) + int(free[-1]) + 1
    border = rows[np.searchsorted(rows, hi)]
    for at in range(hi, int(border), CHUNK):
        free = np.flatnonzero(~alphabet.word[raw[at : min(at + CHUNK, int(border))]])
        if len(free):
            return at + int(free[0]) + 1
    return int(border)


def shingles(row: np.ndarray, hashed: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """row and hash of every distinct shingle of ``size`` words, sorted by row, then hash.

    A row with fewer words has its whole sequence as its only shingle; one without words has none.
    """
    n = len(hashed)
    m = max(0, n - size + 1)
    s = np.zeros(m, np.uint64)
    for k in range(size):
        s += hashed[k : k + m] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    full = row[:m] == row[size - 1 :] if m else np.zeros(0, bool)
    r, s = row[:m][full], mix(s[full])
    counts = np.bincount(row, minlength=n_rows)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        at = np.concatenate([[0], np.cumsum(counts)])
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            whole[has] += hashed[at[short[has]] + k] * np.uint64(pow(0xA24BAED4963EE407, k + 1, 1 << 64))
        r, s = np.concatenate([r, short]), np.concatenate([s, mix(whole + counts[short].astype(np.uint64))])
    order = np.lexsort((s, r))
    r, s = r[order], s[order]
    if len(r):
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        r, s = r[new], s[new]
    return r, s


def parts(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each, one row at least."""
    text = batch.column(column)
    size = np.asarray(pc.binary_length(text).fill_null(0), np.int64) if len(text) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
