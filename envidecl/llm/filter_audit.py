"""Filter interaction audit: what each of five quality filters removes, in every order of applying them.

A relational word pipeline: words are exploded, aggregated by (document, word), then by document,
which gives totals and distinct words. The other flags come from a second scan, the words are
outer-joined to them, and per part 32 conditional counts are taken, one for each set of filters
that a document can fail (and as many of good and of toxic documents). Every order and step is
a sum over some of the 32, so documents are read once for all 120 orders.

Everything is DataFrame functions. Texts are shuffled once, to the task that counts their words:
dealt by document, the aggregation by (document, word) and the one by document need no other
exchange, while exchanging counted words would move several times as many bytes, twice. Flags
are some 80 bytes a document; equal texts are found by hash, and a text that a third of all
documents share is met in a join whose large partitions adaptive execution splits.

Defined results
* null or empty text: no words, no code points; it fails A only, and E if a smaller id has the same.
* null ``doc_id``: a document like others, without labels; neither it nor its text is a smaller id's.
* repeated ids: every row is a document; rows of one id are not each other's copies (E asks for a
  smaller id), and each has the id's labels.
* repeated labels: a document is good (toxic) if any label of its id says so; null says nothing.
* null ``lang`` and the empty string are one part, the empty string.
* ties do not arise; a text is one row of a task, whatever its length.
* extra columns are ignored; empty table: an empty result, as there is no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LETTERS = "ABCDE"
#: White space that ends a word: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"
_BIT = {letter: 1 << k for k, letter in enumerate(LETTERS)}
_KINDS = ("n", "good", "toxic")


def _keys() -> list[Column]:
    """Two numbers that tell rows apart, or hold for rows equal in id, part and text."""
    part = F.coalesce("lang", F.lit(""))
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
        F.xxhash64(F.col("doc_id").isNull(), part, "text").alias("_tag"),
    ]


def word_counts(docs: DataFrame) -> DataFrame:
    """_id, _tag, words and distinct_words of every document with words; rows equal in all are counted together."""
    text = F.coalesce("text", F.lit(""))
    dealt = docs.select("doc_id", "lang", text.alias("text")).select(*_keys(), "text").repartition("_id", "_tag")
    words = dealt.select("_id", "_tag", F.explode(F.split("text", BLANKS)).alias("word")).where("word <> ''")
    return (
        words.groupBy("_id", "_tag", "word")
        .agg(F.count("*").alias("n"))
        .groupBy("_id", "_tag")
        .agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))
    )


def plain_flags(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """_id, _tag, doc_id, part, rows equal in these (copies), and failures of C, D and E."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", text.alias("text")).select(
        *_keys(),
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        (100 * F.char_length(F.regexp_replace("text", "[^A-Z]+", "")) > 10 * F.char_length("text")).alias("C"),
        F.col("text").rlike(SIGNS).alias("D"),
        F.unhex(F.sha2("text", 256)).alias("_text"),
    )
    rows = scratch.keep(rows)
    first = rows.groupBy("_text").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL")
    # A table of its own, so that adaptive execution can split the partition of a very common text.
    first = scratch.keep(first.select("_text", "_first"))
    marked = rows.join(first, "_text", "left").withColumn("E", F.coalesce(F.col("_first") < F.col("doc_id"), F.lit(False)))
    return marked.groupBy("_id", "_tag", "doc_id", "part", "C", "D", "E").agg(F.count("*").alias("copies"))


def failures(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, part, copies and the boolean columns A to E: which filters reject the document."""
    flags = plain_flags(docs, scratch)
    joined = flags.join(word_counts(docs), ["_id", "_tag"], "left")
    words = F.coalesce(F.col("words") / F.col("copies"), F.lit(0)).cast("long")
    distinct = F.coalesce("distinct_words", F.lit(0))
    return joined.select("doc_id", "part", "copies", (words < 100).alias("A"), (100 * distinct < 80 * words).alias("B"), "C", "D", "E")


def pattern_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part and, for each kind of document, an array of 32 counts by the set of filters failed (bit 0: A)."""
    says = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    pattern = sum((F.col(c).cast("int") * b for c, b in _BIT.items()), F.lit(0))
    rows = failed.select("doc_id", "part", "copies", pattern.alias("_p")).join(says, "doc_id", "left")
    # Documents equal in part, pattern and labels go on as one number.
    few = rows.groupBy("part", "_p", "good", "toxic").agg(F.sum("copies").alias("k"))
    which = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    columns = [
        F.coalesce(F.sum(F.when((F.col("_p") == p) & which[kind], F.col("k"))), F.lit(0)).alias(f"{kind}{p}") for kind in _KINDS for p in range(32)
    ]
    wide = few.groupBy("part").agg(*columns)
    return wide.select("part", *[F.array(*[f"{kind}{p}" for p in range(32)]).alias(kind) for kind in _KINDS])


def orders(counts: DataFrame) -> DataFrame:
    """The contract's rows: part, order and step, with what the step's filter does there."""
    steps = [
        f"named_struct('filter_order', '{''.join(o)}', 'step', {k + 1}, 'own', {_BIT[o[k]]}, 'earlier', {sum(_BIT[c] for c in o[:k])})"
        for o in permutations(LETTERS)
        for k in range(5)
    ]
    rows = counts.select("*", F.explode(F.expr(f"array({', '.join(steps)})")).alias("_s")).select("part", *_KINDS, "_s.*")
    own, earlier = F.col("own"), F.col("earlier")
    fails = lambda p: p.bitwiseAND(own) != 0
    gone = lambda p: p.bitwiseAND(earlier) != 0

    def total(kind: str, use, weight=lambda p: F.lit(1)) -> Column:
        one = lambda p: F.when(use(p), F.get(F.col(kind), p) * weight(p)).otherwise(0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, p: s + one(p))

    here = lambda p: fails(p) & ~gone(p)
    # Among the 120 orders a document's failed filters come first equally often each.
    share = lambda p: (F.lit(120) / F.greatest(F.bit_count(p), F.lit(1))).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda p: ~fails(p) & ~gone(p)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda p: fails(p) & gone(p)).alias("redundant"),
        F.get("n", own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("n", fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step."""
    work = Scratch(docs.sparkSession, "audit")
    counts = pattern_counts(failures(docs, work), labels)
    # Few rows, and each of the 600 that follow from one needs all its numbers.
    return orders(work.keep(counts))


SQL = r"""
WITH split_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words_ AS (SELECT r, unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS word FROM split_),
counted AS (SELECT r, count(*) AS words, count(DISTINCT word) AS distinct_words FROM words_ WHERE word <> '' GROUP BY r),
says AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    coalesce(words, 0) < 100 AS a, 100 * coalesce(distinct_words, 0) < 80 * coalesce(words, 0) AS b,
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(min(split_.doc_id) OVER (PARTITION BY text) < split_.doc_id, false) AS e
    FROM split_ LEFT JOIN counted USING (r) LEFT JOIN says ON says.doc_id = split_.doc_id),
docs_ AS (SELECT part, good, toxic, [a, b, c, d, e] AS f FROM failed),
letters(l, i) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)),
orders_ AS (SELECT [p.i, q.i, s.i, t.i, u.i] AS o, p.l || q.l || s.l || t.l || u.l AS filter_order
    FROM letters p, letters q, letters s, letters t, letters u
    WHERE p.i NOT IN (q.i, s.i, t.i, u.i) AND q.i NOT IN (s.i, t.i, u.i) AND s.i NOT IN (t.i, u.i) AND t.i <> u.i),
steps AS (SELECT o, filter_order, step, o[step] AS own, o[:step - 1] AS earlier FROM orders_, (SELECT unnest(range(1, 6)) AS step)),
patterns AS (SELECT part, good, toxic, f, count(*) AS n FROM docs_ GROUP BY ALL),
each AS (SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails, len(list_filter(earlier, lambda x: f[x])) > 0 AS gone,
    len(list_filter(f, lambda x: x)) = 1 AS single FROM patterns, steps),
told AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails AND single THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM each GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM told
"""
