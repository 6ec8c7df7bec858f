"""The audit of filter interactions against a plain walk over all orders."""

import re
from collections import defaultdict
from itertools import permutations

from tests.conftest import SF, canonical

from envidecl.llm import filter_audit
from envidecl.llm.common import table

DOCS = "doc_id long, text string, lang string, part string, copies int"
LABELS = "doc_id long, quality int, toxic int, text string"


def plain(docs, labels):
    good = {d for d, q, *_ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, *_ in labels if t == 1 and d is not None}
    first = {}
    for d, t, *_ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    failed = []
    for d, text, lang, *_ in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": d is not None and first.get(text, d) < d,
        }
        failed.append((lang or "", {c for c in fails if fails[c]}, d in good, d in toxic))
    out, shapley = [], defaultdict(int)
    for part in {f[0] for f in failed}:
        for order in permutations("ABCDE"):
            left = [f for f in failed if f[0] == part]
            for step, c in enumerate(order, 1):
                removed = [f for f in left if c in f[1]]
                redundant = sum(f[0] == part and c in f[1] for f in failed) - len(removed)
                unique = sum(f[0] == part and f[1] == {c} for f in failed)
                left = [f for f in left if c not in f[1]]
                shapley[part, c] += len(removed)
                out.append([part, "".join(order), step, len(left), len(removed), redundant, unique, sum(f[2] for f in removed), sum(f[3] for f in removed)])
    return sorted(tuple(r + [shapley[r[0], r[1][r[2] - 1]]]) for r in out)


def rows():
    long = " ".join(f"w{k}" for k in range(120))
    texts = [None, "", "a", long, long, long.upper(), "x " * 150, long + " #", long + "\v\f|", "ß" * 50 + " É " * 120, "A " * 130 + "$", "\n\t ", "y" * 100_000]
    docs = [(k, t, ("en", "fr", None, "")[k % 4], "p", 7) for k, t in enumerate(texts)]
    docs += [(3, long, "en", "p", 7), (3, long, "fr", "p", 7), (3, long, "en", "p", 7), (None, long, "en", "p", 7), (None, None, None, None, None), (-5, long + " #", "fr", None, None), (20, "a", "en", "p", 1)]
    labels = [(3, 1, 0, "t"), (3, 0, 1, "t"), (4, None, 1, "t"), (None, 1, 1, "t"), (7, 1, None, "t"), (99, 1, 1, "t"), (20, 1, 1, None)]
    return docs, labels

NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_matches_a_plain_walk(spark):
    docs, labels = rows()
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect())) == plain(docs, labels)


def test_empty_tables(spark):
    docs, labels = rows()
    none = filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS))
    assert none.collect() == [] and none.columns == NAMES
    unlabelled = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))
    assert sorted(map(tuple, unlabelled.collect())) == plain(docs, [])


def test_matches_sql(spark, duck):
    ours = filter_audit.audit(table(spark, SF, "documents"), table(spark, SF, "labels")).toPandas()
    assert canonical(ours) == canonical(duck.sql(filter_audit.SQL).df())


def test_words_are_counted_after_one_exchange(spark):
    plan = filter_audit.word_counts(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "PythonUDF" not in plan
