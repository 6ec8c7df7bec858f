"""Language identification by unigram pieces, summed over all segmentations of a text.

Every language has its own probabilities over one fixed public vocabulary of pieces (and the
256 single bytes, so that everything can be segmented). The probability of a word is the sum
over all its segmentations, by the forward algorithm; a text's is the product over its words,
which pieces never cross, and the language with the largest posterior wins. Probabilities
come from expectation maximisation (forward and backward sums) over the words of a bounded
sample of labelled documents, which Spark counts.

Texts are whole. Words are hashed from the column's bytes; each distinct word is segmented
once by a worker, all new words of a batch together, and looked up afterwards.

Defined results
* null text, or text without a letter: ``und``, score 1.
* letters without any word of the alphabet cannot occur; without any learned language, or
  labelled rows, everything is ``und`` with score 0.
* a null ``doc_id`` is not held out; repeated rows get equal results.
* ties go to the first language in alphabetical order.
* words of any length are summed whole: the forward sums keep as many places as the longest
  piece has bytes, and their scale apart. They are learned whole, too: forward sums are kept
  at the starts of parts of ``LEARNED_PART`` bytes and made again part by part.
* every value of lang is learned, however many there are; the sample leaves each ``SAMPLE_LEAST`` documents at least.
* extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import ascii_lower, bounded_batches, held_out, worker_state

#: The bounds of the training sample: documents of a language, and of all.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_LEAST = 600, 4000, 50
ROUNDS = 4
#: Bytes of a long word whose sums learning holds at once.
LEARNED_PART = 4096
#: Words longer than this are summed and learned one by one, the others together.
TOGETHER = 512
#: Places times words that are summed together.
CELLS = 400_000
#: Steps between two looks at the scale of the sums.
RESCALE = 8
#: Added to every piece's expected count.
SMOOTH = 0.05
#: Distinct words whose sums a worker keeps.
CACHED_WORDS = 400_000
BORDER = 0x20
_VALUE = T.ALNUM.value
_STEP = 0x9E3779B97F4A7C15


def _hashes(b: np.ndarray) -> np.ndarray:
    """Prefix sums whose scaled differences are the hashes of runs of bytes."""
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[b] * T._power(_STEP, len(b)), out=total[1:])
    return total


def _run_hash(total: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    return (total[start + size] - total[start]) * T._power(T._INVERSE, len(total))[start]


class Pieces:
    """The vocabulary: sorted hashes of the pieces' bytes, word borders as a blank."""

    def __init__(self, pieces: list[bytes]):
        own = sorted({p.lower() for p in pieces if p} | {bytes([k]).lower() for k in range(256)})
        raw = np.frombuffer(b"".join(own), np.uint8)
        size = np.array([len(p) for p in own])
        start = np.cumsum(size) - size
        total = _hashes(raw)
        h = (total[start + size] - total[start]) * T._power(T._INVERSE, len(total))[start]
        self.sorted, self.id = np.unique(h, return_index=True)
        self.n, self.longest = len(own), int(size.max())

    def lattice(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each piece length, the piece that starts at each byte of the words, or -1; words' starts and sizes.

        Every word is written out with a border before it; ids are by position in that text.
        """
        size = stop - start + 1
        begin = np.cumsum(size) - size
        text = np.full(int(size.sum()), BORDER, np.uint8)
        where = np.repeat(start - 1 - begin, size) + np.arange(len(text))
        inner = np.ones(len(text), bool)
        inner[begin] = False
        text[inner] = raw[where[inner]]
        left = np.repeat(begin + size, size) - np.arange(len(text))
        total = _hashes(text)
        out = []
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(left >= n)
            h = _run_hash(total, at, n)
            k = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            ids = np.full(len(text), -1, np.int32)
            ids[at] = np.where(self.sorted[k] == h, self.id[k], -1)
            out.append(ids)
        return out, begin, size


def load_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model, its border sign as a blank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return Pieces([p.replace("▁", " ").encode() for p in found])


def _groups(size: np.ndarray) -> Iterator[np.ndarray]:
    """Words of similar size, longest first, of at most CELLS places together."""
    order = np.argsort(-size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + max(1, CELLS // (int(size[order[lo]]) + 1))
        yield order[lo:hi]
        lo = hi


def _rescale(window: np.ndarray, log: np.ndarray) -> None:
    """Brings the largest of the last sums of each word and language to one."""
    top = window.max(axis=0)
    top[top == 0] = 1
    window /= top
    log += np.log(top)


def log_sums(lattice: list[np.ndarray], begin: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of each word, by languages; words longest first; p: pieces by languages."""
    longest = len(lattice)
    ring = np.zeros((longest + 1, len(begin), p.shape[1]))
    ring[0] = 1
    log = np.zeros((len(begin), p.shape[1]))
    out = np.empty_like(log)
    live = np.searchsorted(-size, -np.arange(size[0] + 2), side="right")
    for t in range(1, int(size[0]) + 1):
        m = live[t]
        now = ring[t % (longest + 1), :m]
        now[:] = 0
        for n in range(1, min(t, longest) + 1):
            ids = lattice[n - 1][begin[:m] + t - n]
            k = np.flatnonzero(ids >= 0)
            if len(k):
                now[k] += ring[(t - n) % (longest + 1), k] * p[ids[k]]
        done = live[t + 1]
        if done < m:
            out[done:m] = np.log(now[done:]) + log[done:m]
        if t % RESCALE == 0:
            _rescale(ring[:, :done], log[:done])
    return out


def long_log_sum(pieces: Pieces, word: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``log_sums`` of one long word, whose lattice is made in parts."""
    longest = pieces.longest
    n = np.arange(1, longest + 1)
    ring = np.zeros((longest + 1, p.shape[1]))
    ring[0] = 1
    log = np.zeros(p.shape[1])
    whole, part = len(word) + 1, 1 << 16
    for lo in range(0, whole, part):
        # Starts of pieces from lo - longest on; the border is place 0 of the word.
        first = max(0, lo - longest)
        raw = word[max(0, first - 1) : lo + part + longest]
        lattice, _, _ = pieces.lattice(raw, np.array([0]), np.array([len(raw)]))
        ids = np.stack(lattice)
        if first:
            ids = ids[:, 1:]  # the border that lattice puts before each part is none here
        for t in range(lo + 1, min(lo + part, whole) + 1):
            k = n[: min(t, longest)]
            i = ids[k - 1, t - k - first]
            k, i = k[i >= 0], i[i >= 0]
            ring[t % (longest + 1)] = (ring[(t - k) % (longest + 1)] * p[i]).sum(axis=0)
            if t % RESCALE == 0:
                _rescale(ring, log)
    return np.log(ring[whole % (longest + 1)]) + log


def expected(lattice: list[np.ndarray], begin: np.ndarray, size: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of pieces by languages, words weighted by their counts."""
    longest, top, words = len(lattice), int(size.max()), np.arange(len(begin))
    logs = []
    for back in (False, True):
        a = np.zeros((top + 1, len(begin), p.shape[1]))
        scale, now = np.zeros_like(a), np.zeros(a.shape[1:])
        if back:
            a[size, words] = 1
        else:
            a[0] = 1
        for s in range(1, top + 1):
            t = top - s if back else s
            for n in range(1, min(s, longest) + 1):
                near = np.flatnonzero(size >= (t + n if back else t))
                ids = lattice[n - 1][begin[near] + (t if back else t - n)]
                k = np.flatnonzero(ids >= 0)
                w = near[k]
                a[t, w] += a[t + n if back else t - n, w] * p[ids[k]]
            scale[t] = now
            if s % RESCALE == 0:
                # All sums that later ones still need share a scale; the others keep theirs.
                last = slice(t, t + longest) if back else slice(max(0, t - longest + 1), t + 1)
                shift = np.zeros(a.shape[1:])
                _rescale(a[last], shift)
                scale[last] += shift
                now += shift
        with np.errstate(divide="ignore"):
            logs.append(np.log(a) + scale)
    forward, backward = logs
    whole = forward[size, words]
    out, log_p = np.zeros_like(p), np.log(p)
    for t in range(top):
        for n in range(1, min(longest, top - t) + 1):
            fits = np.flatnonzero(size >= t + n)
            ids = lattice[n - 1][begin[fits] + t]
            k = np.flatnonzero(ids >= 0)
            w, i = fits[k], ids[k]
            full = np.exp(forward[t, w] + log_p[i] + backward[t + n, w] - whole[w]) * weight[w]
            for lang in range(p.shape[1]):
                out[:, lang] += np.bincount(i, full[:, lang], len(p))
    return out


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=0)
    return top + np.log(np.exp(terms - top).sum(axis=0))


def long_expected(pieces: Pieces, word: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``expected`` of one long word, part by part: forward over all parts, then back from the last."""
    longest, whole, log_p = pieces.longest, len(word) + 1, np.log(p)

    def forward(lo: int, known: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Pieces that start at place ``first`` and later ones of the part, and forward sums from there; known: those up to lo."""
        first, hi = max(0, lo + 1 - longest), min(lo + LEARNED_PART, whole)
        raw = word[max(0, first - 1) : hi + longest - 1]
        ids = np.stack(pieces.lattice(raw, np.array([0]), np.array([len(raw)]))[0])
        ids = ids[:, 1 if first else 0 :][:, : hi - first]  # lattice puts a border before, which only the word's start has
        sums = np.concatenate([known, np.empty((hi - lo, p.shape[1]))])
        for t in range(lo + 1, hi + 1):
            k = np.arange(1, min(t, longest) + 1)
            i = ids[k - 1, t - k - first]
            k, i = k[i >= 0], i[i >= 0]
            sums[t - first] = _log_sum(sums[t - k - first] + log_p[i])
        return first, ids, sums

    starts, known = list(range(0, whole, LEARNED_PART)), [np.zeros((1, p.shape[1]))]
    for lo in starts:
        known.append(forward(lo, known[-1])[2][-longest:])
    total, out = known.pop()[-1], np.zeros_like(p)
    after = np.zeros((1, p.shape[1]))  # backward sums from the end of the part on
    for lo in reversed(starts):
        first, ids, sums = forward(lo, known.pop())
        hi = min(lo + LEARNED_PART, whole)
        back = np.concatenate([np.empty((hi - lo, p.shape[1])), after])
        for t in range(hi - 1, lo - 1, -1):
            i = ids[: min(longest, whole - t), t - first]
            k = np.flatnonzero(i >= 0)
            back[t - lo] = _log_sum(back[t + 1 + k - lo] + log_p[i[k]])
        for k in range(1, longest + 1):
            i = ids[k - 1, lo - first :]
            t = np.flatnonzero(i >= 0)
            np.add.at(out, i[t], np.exp(sums[t + lo - first] + log_p[i[t]] + back[t + k] - total) * weight)
        after = back[:longest]
    return out


class Model:
    def __init__(self, languages: list[str], p: np.ndarray):
        self.languages, self.p = languages, p


def train(pieces: Pieces, langs: list[str], words: list[bytes], counts: list[int]) -> Model:
    """From words of languages with their counts."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((pieces.n, 0)))
    of: dict[bytes, int] = {}
    row = np.array([of.setdefault(w, len(of)) for w in words])
    weight = np.zeros((len(of), len(names)))
    np.add.at(weight, (row, np.searchsorted(names, langs)), counts)
    size = np.array([len(w) for w in of])
    raw = np.frombuffer(b"".join(of), np.uint8)
    start = np.cumsum(size) - size
    short, long_ = np.flatnonzero(size <= TOGETHER), np.flatnonzero(size > TOGETHER)
    p = np.full((pieces.n, len(names)), 1 / pieces.n)
    groups = [short[g] for g in _groups(size[short])]
    held = [pieces.lattice(raw, start[g], (start + size)[g]) for g in groups]
    for _ in range(ROUNDS):
        count = sum((expected(*x, p, weight[g]) for x, g in zip(held, groups, strict=True)), np.zeros_like(p))
        for w in long_.tolist():
            count += long_expected(pieces, raw[start[w] : start[w] + size[w]], p, weight[w])
        p = (count + SMOOTH) / (count.sum(axis=0) + SMOOTH * pieces.n)
    return Model(names, p)


class Scorer:
    def __init__(self, pieces: Pieces, model: Model):
        self.pieces, self.model = pieces, model
        self.clear()

    def clear(self) -> None:
        self.hashes, self.sums = np.zeros(0, np.uint64), np.zeros((0, len(self.model.languages)), np.float32)

    def _new(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size, p = stop - start, self.model.p
        out = np.zeros((len(start), len(self.model.languages)))
        short, long_ = np.flatnonzero(size <= TOGETHER), np.flatnonzero(size > TOGETHER)
        for g in _groups(size[short]):
            w = short[g]
            out[w] = log_sums(*self.pieces.lattice(raw, start[w], stop[w]), p)
        for w in long_.tolist():
            out[w] = long_log_sum(self.pieces, T.ALNUM.fold[raw[start[w] : stop[w]]], p)
        return out

    def __call__(self, column: pa.Array) -> np.ndarray:
        """Log probabilities of rows by languages."""
        raw, rows = T.buffers(column)
        row, start, stop, h = T.words(raw, rows, T.ALNUM)
        out = np.zeros((len(column), len(self.model.languages)))
        if not len(h):
            return out
        if len(self.hashes) > CACHED_WORDS:
            self.clear()
        distinct, first, of = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            fresh = self._new(raw, start[first[new]], stop[first[new]])
            hashes, sums = np.concatenate([self.hashes, distinct[new]]), np.concatenate([self.sums, fresh.astype(np.float32)])
            order = np.argsort(hashes)
            self.hashes, self.sums = hashes[order], sums[order]
            at = np.searchsorted(self.hashes, distinct)
        each = self.sums[at][of]
        for lang in range(out.shape[1]):
            out[:, lang] = np.bincount(row, each[:, lang], len(column))
        return out


_pieces: dict[str, Pieces] = {}


def _vocabulary(path: str) -> Pieces:
    return _pieces.get(path) or _pieces.setdefault(path, load_pieces(path))


#: Words as ``tokens.ALNUM`` has them.
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def fit(docs: DataFrame, path: str, per_language: int = SAMPLE_DOCS, overall: int = SAMPLE_ALL, least: int = SAMPLE_LEAST) -> Model:
    """Learn from at most about so many documents, chosen by a hash of the id, never held-out ones; ``least`` of each language in any case."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    by_lang = known.groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in by_lang.collect()}
    if not counts:
        return train(_vocabulary(path), [], [], [])
    most = min(per_language, max(least, overall // len(counts)))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, most / n) * 1_000_000)))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < share[F.col("lang")])
    words = chosen.select("lang", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(1))).alias("word"))
    rows = words.groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    return train(_vocabulary(path), rows["lang"].to_pylist(), [w.encode() for w in rows["word"].to_pylist()], rows["n"].to_pylist())


def identify(docs: DataFrame, model: Model, path: str) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    # The key tells a worker that is used again that the model is another one.
    shared, key = spark.sparkContext.broadcast((model.languages, model.p)), uuid.uuid4().hex
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(key, lambda: Scorer(_vocabulary(path), Model(*shared.value)))
        names = scorer.model.languages
        for whole in batches:
            for b in T.parts(whole, "text"):
                if names:
                    logs = scorer(b.column("text"))
                    best = logs.argmax(axis=1)
                    score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    lang = np.array(names, object)[best]
                else:
                    score, lang = np.zeros(b.num_rows), np.full(b.num_rows, "und", object)
                some = np.asarray(b.column("letter").to_numpy(zero_copy_only=False), bool)
                lang[~some], score[~some] = "und", 1.0
                yield pa.record_batch([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text", letter.alias("letter")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    return identify(docs, fit(docs, path), path).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
