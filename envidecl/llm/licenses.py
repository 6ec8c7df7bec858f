"""License scans: exact phrases, and short notices with a bounded number of edits.

Exact phrases are runs of words, compared by hash over all words of a batch at once. For the
fuzzy search a text is normalised (A-Z lower-cased, words joined by single blanks). A notice
that may have e edits is split into e + 1 pieces, one of which must occur unchanged (the
pigeonhole principle); an Aho-Corasick automaton finds all pieces of all notices in one pass,
and the regex library's bounded-error matching verifies each place and reports the span and
its edits. The edits may not make one licence of another: a place whose telling word (licence
name, version number, "nc") is another one, rather than a misspelling, is no notice. Rows are
scanned alone, so nothing is shuffled and no key can be hot.

Defined results
* null, empty or wordless text: no words, no labels (empty strings), score 0, null places.
* places overlap freely; every start of a phrase counts. Labels are distinct and sorted.
* score: 1 with an exact phrase, else the best 1 - edits / length of a notice, else 0.
* telling words: another number or rival, none, or more edits than a third of the word (one at
  least; neighbours swapped are free) reject the place; other spellings of it stay near copies.
* notices that follow each other are each found, near copies before a better one too; of
  places of one notice that overlap, the one with the fewest edits stays.
* repeated rows get equal results; extra columns are ignored; an empty table gives none.
* texts are whole, however long; a notice is never cut by a border of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import bounded_batches

#: Exact phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices, their labels, and the edits that they may have (a tenth of the length, about).
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2 0", "apache-2", 4),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("licensed under the gnu general public license version 3", "gpl-3", 5),
    ("gnu lesser general public license version", "lgpl", 3),
    ("mozilla public license version 2 0", "mpl-2", 3),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("all rights reserved", "all-rights-reserved", 1),
)
#: Words of notices that tell their licence from others, and words that edits must not turn into them.
NUMBERS = "numbers"
TELLING = (
    ("released under the mit license", "mit", ()),
    ("licensed under the apache license version 2 0", "apache", ()),
    ("licensed under the apache license version 2 0", "2", NUMBERS),
    ("licensed under cc by nc 4 0", "nc", ("nd", "sa")),
    ("creative commons attribution noncommercial", "noncommercial", ("commercial",)),
    ("licensed under the gnu general public license version 3", "3", NUMBERS),
    ("mozilla public license version 2 0", "2", NUMBERS),
)
#: Characters behind a place, after its possible edits, in which its last word may end.
WORD_REST = 40
_NORMAL = bytes(T.ALNUM.fold[k] if T.ALNUM.word[k] else 32 for k in range(256))
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, notices array<struct<label:string,start:long,stop:long,edits:int,text:string>>"
)


def normal(text: str | None) -> str:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()).decode("utf-8", "replace")


def _align(row: list[int], part: str, text: str) -> list[int]:
    """Least edits up to each place of the text, after a further part of a notice."""
    for c in part:
        new = [row[0] + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return row


def _border(text: str, j: int) -> bool:
    """Whether neither a word nor a number goes on at a place."""
    return not 0 < j < len(text) or " " in text[j - 1 : j + 1] or text[j - 1].isdigit() != text[j].isdigit()


def _runs(row: list[int], text: str, digits: bool) -> list[int]:
    """Least edits up to each place, after the rest of any one word, or any number."""
    out = [len(text) + len(row)] * len(row)
    for j in range(1, len(row)):
        i = j
        while _border(text, j) and i and text[i - 1] != " " and (text[i - 1].isdigit() or not digits):
            i -= 1
            out[j] = min(out[j], row[i])
    return out


@lru_cache(maxsize=20_000)
def _tells(notice: str, word: str, rivals: tuple[str, ...] | str, text: str) -> bool:
    """Whether the place holds a notice's telling word, misspelt at most, and no other word instead."""
    words = notice.split(" ")
    k = words.index(word)
    after = "".join(" " + w for w in words[k + 1 :])
    before = _align([0] * (len(text) + 1), " ".join(words[:k]), text)
    blank = _align(before, " ", text)

    def edits(row: list[int]) -> int:
        ends = enumerate(_align(row, after, text))
        return min(x for j, x in ends if after or _border(text, j) and text[j - 1 : j] != " ")

    swapped = [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)]
    own = min(edits(_align(blank, w, text)) for w in (word, *swapped))
    if rivals == NUMBERS:
        others = [edits(_runs(blank, text, digits=True))]
    else:
        others = [edits(_align(blank, w, text)) for w in rivals]
    any_word = [min(x) for x in zip(before, _runs(blank, text, digits=False), strict=True)]
    return own <= min(others, default=own) and own - edits(any_word) <= max(1, len(word) // 3)


class Notices:
    """Finds notices with edits."""

    def __init__(self, notices=NOTICES):
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (text, _, edits) in enumerate(notices):
            borders = np.linspace(0, len(text), edits + 2).round().astype(int)
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                seeds.setdefault(text[lo:hi], []).append((k, int(lo)))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()
        self.verify = [regex.compile(f"(?b)(?:{regex.escape(t, literal_spaces=True)}){{e<={e}}}") for t, _, e in notices]

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Ranges of the text that may hold each notice: seeds whose places differ by the edits at most give one, so a range is bounded."""
        found: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.seeds.iter(text):
            at = end + 1 - size
            for k, offset in places:
                full, _, edits = self.notices[k]
                lo, hi = max(0, at - offset - edits), min(len(text), at - offset + len(full) + edits)
                mine = found.setdefault(k, [])
                mine.append([lo, hi])
        for k, ranges in found.items():
            edits, merged = self.notices[k][2], []
            for lo, hi in sorted(ranges):
                if merged and lo - merged[-1][0] <= 2 * edits:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            found[k] = merged
        return found

    def places(self, k: int, text: str, lo: int, hi: int) -> Iterator[regex.Match]:
        """The best place of a range, and those of the parts before and after it."""
        full, _, edits = self.notices[k]
        parts = [(lo, hi)]
        while parts:
            lo, hi = parts.pop()
            if hi - lo >= len(full) - edits and (m := self.verify[k].search(text, lo, hi)):
                yield m
                parts += [(lo, m.start()), (m.end(), hi)]

    def holds(self, k: int, text: str, start: int, stop: int, edits: int) -> bool:
        """Whether a place is a notice's own, not another licence's with its telling words edited."""
        full, _, most = self.notices[k]
        if not edits and _border(text, stop):
            return True
        end = text.find(" ", stop + most, stop + most + WORD_REST)
        place = text[max(0, start - most) : end if end >= 0 else stop + most + WORD_REST]
        return all(_tells(full, word, rivals, place) for notice, word, rivals in TELLING if notice == full)

    def __call__(self, text: str) -> list[tuple[str, int, int, int, str]]:
        """label, start and stop in the normalised text, edits and the span itself."""
        out = []
        for k, ranges in self.windows(text).items():
            done = 0  # where the last place of this notice ends
            for lo, hi in ranges:
                for m in sorted(self.places(k, text, max(lo, done), hi), key=lambda m: m.start()):
                    done = max(done, m.end())
                    edits = sum(m.fuzzy_counts)
                    if self.holds(k, text, m.start(), m.end(), edits):
                        out.append((self.notices[k][1], m.start(), m.end(), edits, m.group(), k))
        out.sort(key=lambda x: (x[1], x[2], x[0], x[3]))
        return out


def phrase_places(row: np.ndarray, h: np.ndarray, phrases=PHRASES) -> list[np.ndarray]:
    """For each phrase, the words that it starts at."""
    out = []
    for text, _ in phrases:
        raw, rows = T.buffers(pa.array([text]))
        want = T.words(raw, rows, T.ALNUM)[3]
        n = len(h) - len(want) + 1
        if n <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        hit = row[:n] == row[len(want) - 1 :]
        for k, x in enumerate(want):
            hit &= h[k : k + n] == x
        out.append(np.flatnonzero(hit))
    return out


_notices: list[Notices] = []


def scan(docs: DataFrame) -> DataFrame:
    """Digest columns and all notices with their spans, of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _notices:
            _notices.append(Notices())
        find = _notices[0]
        for whole in batches:
            for b in T.parts(whole, "text"):
                raw, rows = T.buffers(b.column("text"))
                row, _, _, h = T.words(raw, rows, T.ALNUM)
                count = np.bincount(row, minlength=b.num_rows)
                begin = np.cumsum(count) - count
                base: dict[int, list[tuple[int, str]]] = {}
                for at, (_, label) in zip(phrase_places(row, h), PHRASES, strict=True):
                    for r, k in zip(row[at].tolist(), at.tolist(), strict=True):
                        base.setdefault(r, []).append((k - int(begin[r]), label))
                out = []
                for r, (doc, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                    places = base.get(r, [])
                    found = find(normal(text))
                    own = {label for _, label in places}
                    best = 1.0 if places else max((1 - x[3] / len(NOTICES[x[5]][0]) for x in found), default=0.0)
                    out.append(
                        {
                            "doc_id": doc,
                            "n_words": int(count[r]),
                            "n_base": len(places),
                            "first_word": min(places)[0] if places else None,
                            "last_word": max(places)[0] if places else None,
                            "base_labels": ",".join(sorted(own)),
                            "labels": ",".join(sorted(own | {x[0] for x in found})),
                            "score": best,
                            "notices": [dict(zip(("label", "start", "stop", "edits", "text"), x[:5], strict=True)) for x in found],
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


_NOTICE = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32()), ("text", pa.string())])
_ARROW = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("notices", pa.list_(_NOTICE))]
)


def license_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, how many notices there are, and their spans: label, start and stop in the normalised text, edits."""
    spans = F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["stop"].cast("string"), x["edits"].cast("string"))), " ")
    return scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("notices").cast("long").alias("n_notices"), spans.alias("spans")
    )
