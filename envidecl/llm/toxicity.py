"""Toxicity: a bidirectional GRU with attention pooling, trained and run in numpy.

A word's input is its own embedding (zero if training did not keep the word) joined with the
mean embedding of its hashed character n-grams and prefixes. A forward and a backward GRU run
over windows of 32 words, one at every 16th word, so each overlaps the next by half and they
cover every word; all of them are scored. Attention pools the states of a window, and a
document's score is that of its most toxic window.

Training takes a bounded sample of labelled rows (``SAMPLE_ROWS`` rows of each label, chosen
by a hash of the id, whatever their length), whole texts, from a scratch table; held-out rows
are never read, and the driver gets the parameters alone. Spark counts the words to keep and
sorts the rows of all epochs, and one task reads them as a stream and holds a batch at a time. Words lose their own embedding at random (``DROPPED``), and parameters
shrink (``DECAY``), so that a few hundred rows are not learned by heart. A document's gradient is spread over all its windows by a softmax of their scores,
whose temperature falls, so that the network finds the windows that explain the label. Windows
beyond ``TRAINED_WINDOWS`` are run again, block by block, for their gradient, which is exact.

Scoring is vectorised over Arrow batches: words are hashed from the column's bytes, the
input side of the gates is computed once per distinct word and kept by the worker, and all
windows of a batch advance together. Each row is scored alone, so no key can be hot.

Defined results
* null, empty or wordless text: score 0, where both labels were learned.
* repeated rows get equal scores; a null ``doc_id`` is not held out.
* labels that are null or lack their document teach nothing; several labels of a document
  are several examples. Without both labels or any word in the sample all scores, of wordless
  texts too, are the share of ones; without any label they are 0.
* extra columns pass through ``score``; an empty table gives an empty result.
* very long texts are scored whole, window by window in blocks of bounded size.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import tokens as T
from .common import Scratch, bounded_batches, held_out, worker_state

WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM = 32, 16, 8, 8, 8
BUCKETS, VOCABULARY = 1 << 13, 20_000
#: The bound of the training sample: rows of each label.
SAMPLE_ROWS = 2000
EPOCHS, LEAST_STEPS, BATCH_DOCS, RATE = 4, 400, 32, 0.01
#: Windows whose states training holds at once, and bytes of text after which a batch is full.
TRAINED_WINDOWS, BATCH_TEXT = 4096, 16 << 20
#: Share of a batch's words that lose their own embedding, and by how much parameters shrink in a step, times the rate.
DROPPED, DECAY = 0.6, 1.0
THRESHOLD = 0.3
#: Distinct words whose gate inputs a worker keeps, 200 bytes each.
CACHED_WORDS = 250_000
BLOCK = 2048


def char_features(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word and bucket of every n-gram (3 to 5 bytes) and prefix (2 to 6 bytes)."""
    values = T.SPACED.value
    size = stop - start
    words, buckets = [], []
    for salt, n, prefix in [(k, k, False) for k in (3, 4, 5)] + [(k + 10, k, True) for k in (2, 3, 4, 5, 6)]:
        number = np.where(size >= n, 1 if prefix else size - n + 1, 0)
        w = np.repeat(np.arange(len(start)), number)
        at = start[w] + np.arange(len(w)) - np.repeat(np.cumsum(number) - number, number)
        h = np.full(len(w), salt, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + values[raw[at + k]]
        words.append(w), buckets.append((T.mix(h) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(words), np.concatenate(buckets)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.clip(x, -30, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sums(rows: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(groups):
        order = np.argsort(groups, kind="stable")
        ordered = groups[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        out[ordered[heads]] = np.add.reduceat(rows[order], heads, axis=0)
    return out


def _mean(rows: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    return _sums(rows, groups, n) / np.maximum(1, np.bincount(groups, minlength=n))[:, None].astype(np.float32)


@dataclass
class Network:
    """Parameters by name: E words, C characters, W b U of both directions, attention v, output w c."""

    p: dict[str, np.ndarray]
    vocabulary: np.ndarray  # sorted hashes of the kept words
    base: float | None = None  # the only score, if there was nothing to learn
    cache: dict = field(default_factory=dict)

    def inputs(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple:
        """Embeddings of distinct words, with what the gradient needs."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(0, len(self.vocabulary) - 1))
        kept = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        e = np.where(kept[:, None], self.p["E"][at], 0).astype(np.float32)
        w, b = char_features(raw, start, stop)
        return np.concatenate([e, _mean(self.p["C"][b], w, len(hashes))], axis=1), at, kept, w, b

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]

    def run(self, gf: np.ndarray, gb: np.ndarray, at: np.ndarray, valid: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows; at: the word of each place; keep: gets what the gradient needs."""
        n, size = at.shape
        states = np.empty((size, n, 2 * HIDDEN), np.float32)
        steps: list[list[tuple]] = [[], []]
        for d, (gate, order) in enumerate(((gf, range(size)), (gb, range(size - 1, -1, -1)))):
            u = self.p["Uf" if d == 0 else "Ub"]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in order:
                x, s = gate[at[:, t]], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = s[:, 2 * HIDDEN :]
                m = np.tanh(x[:, 2 * HIDDEN :] + r * c)
                before = h
                h = m + z * (h - m)
                if d:
                    h *= valid[:, t, None]
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
                if keep is not None:
                    steps[d].append((t, before, z, r, c, m))
        score = np.where(valid, (states @ self.p["v"]).T, -1e9)
        score -= score.max(axis=1, keepdims=True)
        a = np.exp(score)
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,tnk->nk", a, states)
        if keep is not None:
            keep.extend((states, steps, a, pooled))
        return pooled @ self.p["w"] + self.p["c"][0]

    def gradient(self, dl: np.ndarray, at: np.ndarray, valid: np.ndarray, kept: list, n_words: int) -> tuple[dict, np.ndarray, np.ndarray]:
        """Of the shared parameters, and of both directions' gate inputs of each distinct word."""
        states, steps, a, pooled = kept
        g = {"w": pooled.T @ dl, "c": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * self.p["w"]
        da = np.einsum("tnk,nk->nt", states, dp)
        ds = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nt,tnk->k", ds, states)
        dstates = a.T[:, :, None] * dp[None] + ds.T[:, :, None] * self.p["v"]
        sides = []
        for d in (0, 1):
            u = self.p["Uf" if d == 0 else "Ub"]
            du, dh = np.zeros_like(u), np.zeros((len(dl), HIDDEN), np.float32)
            dgate = np.empty((at.shape[1], len(dl), 3 * HIDDEN), np.float32)
            for t, before, z, r, c, m in reversed(steps[d]):
                dh = dh + dstates[t, :, d * HIDDEN : (d + 1) * HIDDEN]
                if d:
                    dh = dh * valid[:, t, None]
                dm = dh * (1 - z) * (1 - m * m)
                dz = dh * (before - m) * z * (1 - z)
                dr = dm * c * r * (1 - r)
                dgate[t] = np.concatenate([dz, dr, dm], axis=1)
                dsum = np.concatenate([dz, dr, dm * r], axis=1)
                du += before.T @ dsum
                dh = dh * z + dsum @ u.T
            g["Uf" if d == 0 else "Ub"] = du
            flat = dgate.transpose(1, 0, 2).reshape(-1, 3 * HIDDEN)
            sides.append(_sums(flat, at.ravel(), n_words))
        return g, sides[0], sides[1]


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, first word and length of every window of documents with so many words."""
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(counts)), n)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, (np.cumsum(counts) - counts)[doc] + step * STRIDE, np.minimum(WINDOW, counts[doc] - step * STRIDE)


def _batches(examples: Iterable[tuple[str, int]]) -> Iterator[tuple[list[str], np.ndarray]]:
    texts, labels, size = [], [], 0
    for text, label in examples:
        texts.append(text), labels.append(label)
        size += len(text)
        if len(texts) == BATCH_DOCS or size > BATCH_TEXT:
            yield texts, np.array(labels, np.float32)
            texts, labels, size = [], [], 0
    if texts:
        yield texts, np.array(labels, np.float32)


def train(examples: Iterable[tuple[str, int]], n: int, vocabulary: np.ndarray, seed: int = 7) -> Network:
    """From a stream of n texts, each with a word at least, and labels; vocabulary: sorted hashes of the words that get an embedding."""
    rng = np.random.RandomState(seed)
    rand = lambda *s: (rng.randn(*s) * 0.2).astype(np.float32)
    d = WORD_DIM + CHAR_DIM
    p = {"E": rand(max(1, len(vocabulary)), WORD_DIM), "C": rand(BUCKETS, CHAR_DIM), "v": rand(2 * HIDDEN), "w": rand(2 * HIDDEN)}
    p |= {f"{k}{s}": rand(*shape) for s in "fb" for k, shape in (("W", (d, 3 * HIDDEN)), ("U", (HIDDEN, 3 * HIDDEN)))}
    p |= {"bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32), "c": np.array([-1.0], np.float32)}
    net = Network(p, vocabulary)
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    seen = 0
    for step, (texts, y) in enumerate(_batches(examples), 1):
        # The temperature falls from 2 to 0.25, and the rate to 0.
        g = _slope(net, texts, y, 2.0 * 0.125 ** (seen / n), rng)
        seen += len(texts)
        rate = RATE * max(0.0, 1 - seen / (n + BATCH_DOCS)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k in p:
            mean[k] += 0.1 * (g[k] - mean[k])
            square[k] += 0.001 * (g[k] ** 2 - square[k])
            p[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
            if p[k].ndim == 2:
                p[k] *= np.float32(1 - rate * DECAY)
    return net


def _slope(net: Network, texts: list[str], y: np.ndarray, heat: float, rng: np.random.RandomState) -> dict[str, np.ndarray]:
    """The gradient of a batch by all windows of its texts."""
    p = net.p
    raw, rows = T.buffers(pa.array(texts, pa.large_string()))
    row, start, stop, h = T.words(raw, rows, T.ALNUM)
    distinct, first, of = np.unique(h, return_index=True, return_inverse=True)
    doc, begin, size = windows(np.bincount(row, minlength=len(texts)))
    x, known, kept, cw, cb = net.inputs(distinct, raw, start[first], stop[first])
    kept &= rng.rand(len(distinct)) >= DROPPED
    x[~kept, :WORD_DIM] = 0
    gf, gb = net.gates(x)

    def run(block: slice, hold: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = of[np.minimum(begin[block, None] + np.arange(WINDOW), len(h) - 1)]
        valid = np.arange(WINDOW) < size[block, None]
        return at, valid, net.run(gf, gb, at, valid, hold)

    blocks = [slice(lo, lo + TRAINED_WINDOWS) for lo in range(0, len(doc), TRAINED_WINDOWS)]
    hold: list = []
    ran = [run(b, hold if len(blocks) == 1 else None) for b in blocks]
    logit = np.concatenate([r[2] for r in ran])
    # Softmax over the windows of each document.
    top = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(top, doc, logit)
    share = np.exp((logit - top[doc]) / heat)
    share /= np.bincount(doc, share, len(texts))[doc]
    score = np.bincount(doc, share * logit, len(texts))
    error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
    dl = (error[doc] * share / len(texts)).astype(np.float32)
    g: dict[str, np.ndarray] = {}
    df, db = (np.zeros((len(distinct), 3 * HIDDEN), np.float32) for _ in range(2))
    for b, (at, valid, _) in zip(blocks, ran, strict=True):
        if len(blocks) > 1:
            hold = []
            run(b, hold)
        part, f, r = net.gradient(dl[b], at, valid, hold, len(distinct))
        df += f
        db += r
        g = {k: g[k] + v if g else v for k, v in part.items()}
    dx = df @ p["Wf"].T + db @ p["Wb"].T
    g |= {"Wf": x.T @ df, "bf": df.sum(axis=0), "Wb": x.T @ db, "bb": db.sum(axis=0)}
    g["E"] = _sums(dx[kept, :WORD_DIM], known[kept], len(p["E"]))
    per = dx[:, WORD_DIM:] / np.maximum(1, np.bincount(cw, minlength=len(distinct)))[:, None].astype(np.float32)
    g["C"] = _sums(per[cw], cb, BUCKETS)
    return g


class Scorer:
    """Scores whole columns; keeps the gate inputs of words seen before."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.gf = self.gb = np.zeros((0, 3 * HIDDEN), np.float32)

    def _words(self, h: np.ndarray, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if len(self.hashes) > CACHED_WORDS:
            self.clear()
        distinct, first, of = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            x, *_ = self.net.inputs(distinct[new], raw, start[first[new]], stop[first[new]])
            gf, gb = self.net.gates(x)
            slots = np.arange(len(self.gf), len(self.gf) + len(gf))
            self.gf, self.gb = np.concatenate([self.gf, gf]), np.concatenate([self.gb, gb])
            hashes, all_slots = np.concatenate([self.hashes, distinct[new]]), np.concatenate([self.slots, slots])
            order = np.argsort(hashes)
            self.hashes, self.slots = hashes[order], all_slots[order]
            at = np.searchsorted(self.hashes, distinct)
        return self.slots[at][of]

    def __call__(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if self.net.base is not None:
            return out + self.net.base
        raw, rows = T.buffers(column)
        row, start, stop, h = T.words(raw, rows, T.ALNUM)
        if not len(h):
            return out
        slot = self._words(h, raw, start, stop)
        doc, begin, size = windows(np.bincount(row, minlength=len(column)))
        best = np.full(len(column), -np.inf)
        for lo in range(0, len(doc), BLOCK):
            b, s = begin[lo : lo + BLOCK], size[lo : lo + BLOCK]
            at = slot[np.minimum(b[:, None] + np.arange(WINDOW), len(slot) - 1)]
            logit = self.net.run(self.gf, self.gb, at, np.arange(WINDOW) < s[:, None])
            np.maximum.at(best, doc[lo : lo + BLOCK], logit)
        some = np.isfinite(best)
        out[some] = 1 / (1 + np.exp(-np.clip(best[some], -30, 30)))
        return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """Train on the bounded sample; held-out rows take no part."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("_doc"), F.col("toxic").alias("_toxic"))
    order = F.xxhash64("_doc")
    # Three times the rows wanted, as labels may lack their documents.
    sample = known.where("_toxic = 1").orderBy(order, "_doc").limit(3 * rows)
    sample = sample.union(known.where("_toxic = 0").orderBy(order, "_doc").limit(3 * rows))
    sample = docs.select("doc_id").join(F.broadcast(sample), F.col("doc_id") == F.col("_doc")).select("_toxic", order.alias("_o"), "_doc").distinct()
    chosen = [sample.where(F.col("_toxic") == k).orderBy("_o", "_doc").limit(rows) for k in (0, 1)]
    # Texts move only now, those of the chosen ids.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), F.col("doc_id") == F.col("_doc"))
    found = found.select("_toxic", "_o", "_doc", F.coalesce("text", F.lit("")).alias("text")).distinct()
    place = F.row_number().over(Window.partitionBy("_toxic").orderBy("_o", "_doc", "text"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    kept = scratch.keep(found.withColumn("_n", place).where(F.col("_n") <= rows))
    net = _learn(kept)
    scratch.drop(kept)
    return net


#: Some byte of a word of ``tokens.ALNUM``.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _learn(sample: DataFrame) -> Network:
    """From rows of _toxic, _doc and text, as many as a task may read again in each epoch."""
    bounded_batches(sample.sparkSession)
    counts = sample.groupBy("_toxic").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(WORD)).alias("worded")).collect()
    every, worded = sum(r["n"] for r in counts), sum(r["worded"] for r in counts)
    if len(counts) < 2 or not worded:
        return Network({}, np.zeros(0, np.uint64), sum(r["n"] * r["_toxic"] for r in counts) / max(1, every))
    texts = sample.where(F.col("text").rlike(WORD))

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.parts(whole, "text"):
                row, _, _, h = T.words(*T.buffers(b.column("text")), T.ALNUM)
                seen = np.unique(np.stack([row.astype(np.int64), h.view(np.int64)]), axis=1)[1]
                yield pa.record_batch([pa.array(seen)], names=["h"])

    often = texts.select("text").mapInArrow(distinct_words, "h long").groupBy("h").count().where("count >= 2")
    vocabulary = np.sort(often.orderBy(F.desc("count"), "h").limit(VOCABULARY).select("h").toArrow()["h"].to_numpy().view(np.uint64))
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-worded // BATCH_DOCS)))
    # The rows of an epoch by a hash with its number: one sorted stream, which spills where it is large.
    turns = texts.select("_toxic", "_doc", "text", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("_epoch"))
    turns = turns.coalesce(1).sortWithinPartitions("_epoch", F.xxhash64("_epoch", "_doc"), "_doc", "text", "_toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(b.column("text").to_pylist(), b.column("_toxic").to_pylist(), strict=True))
        net = train(rows, epochs * worded, vocabulary)
        yield pa.record_batch([pa.array([pickle.dumps(net.p)], pa.binary())], names=["net"])

    # A task that is lost trains again, to the same network.
    made = turns.select("text", "_toxic").mapInArrow(learn, "net binary").first()
    return Network(pickle.loads(made["net"]), vocabulary)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """docs with ``_score``, which replaces a column of that name."""
    spark, docs = docs.sparkSession, docs.drop("_score")
    bounded_batches(spark)
    # The key tells a worker that is used again that the model is another one.
    shared, key = spark.sparkContext.broadcast((net.p, net.vocabulary, net.base)), uuid.uuid4().hex
    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(key, lambda: Scorer(Network(*shared.value)))
        for whole in batches:
            for b in T.parts(whole, "text"):
                yield pa.record_batch([*b.columns, pa.array(scorer(b.column("text")))], names=[*b.schema.names, "_score"])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )
