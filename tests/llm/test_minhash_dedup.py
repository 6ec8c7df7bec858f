"""b-bit MinHash dedup against brute force over all pairs of shingle sets."""

import random
import re

import numpy as np

from tests.conftest import SF

from envidecl.llm import minhash_dedup
from envidecl.llm.common import table

DOCS = "doc_id long, text string, kept boolean, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    return {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def plain(docs):
    """doc_id, set size and component of every row; ids that have several texts are one node."""
    sets = [(d, shingles(t)) for d, t, *_ in docs]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = {}
    for d, s in sets:
        if d is not None and s:
            distinct.setdefault(frozenset(s), []).append(d)
    for same in distinct.values():
        for d in same:
            a, b = sorted((find(d), find(same[0])))
            parent[b] = a
    lists = {}
    for k, s in enumerate(distinct):
        for x in s:
            lists.setdefault(x, []).append(k)
    keys = list(distinct)
    for k, s in enumerate(keys):
        count = {}
        for x in s:
            for o in lists[x]:
                if o < k:
                    count[o] = count.get(o, 0) + 1
        for o, both in count.items():
            if 100 * both >= 85 * (len(s) + len(keys[o]) - both):
                a, b = sorted((find(distinct[s][0]), find(distinct[keys[o]][0])))
                parent[b] = a
    return sorted((d is None, d or 0, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets)


def told(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_documents(spark):
    docs = table(spark, SF, "documents")
    expected = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert any(not r[4] for r in expected)
    assert told(minhash_dedup.similar_classes(docs)) == expected
    assert told(minhash_dedup.similar_classes(docs, block=2000)) == expected


def grown(draw, n, words, edits):
    """n texts, each one of the earlier ones with some of its words replaced."""
    texts = [[f"w{draw.randrange(5000)}" for _ in range(words)]]
    while len(texts) < n:
        new = list(draw.choice(texts))
        for _ in range(draw.randint(0, edits)):
            new[draw.randrange(len(new))] = f"w{draw.randrange(5000)}"
        texts.append(new)
    return [" ".join(t) for t in texts]


def test_groups_of_near_copies_in_small_blocks(spark):
    draw = random.Random(3)
    texts = grown(draw, 250, 60, 3) + grown(draw, 60, 200, 8) + [f"only {k} of its kind" for k in range(40)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"q{draw.randrange(90000)}" for _ in range(14)) for _ in range(80)]
    draw.shuffle(texts)
    docs = [(k * 7 % 1000, t, True, "x") for k, t in enumerate(texts)]
    expected = plain(docs)
    frame = spark.createDataFrame(docs, DOCS).repartition(7)
    assert told(minhash_dedup.similar_classes(frame)) == expected
    assert told(minhash_dedup.similar_classes(frame, block=1500)) == expected


def test_edges(spark):
    base = " ".join(f"w{k}" for k in range(50))
    docs = [
        (1, None, None, None), (2, "", True, "x"), (3, " \t\n", True, "x"), (4, "a b", True, "x"), (5, "A  B", False, "x"), (6, "a", True, "x"), (None, base, True, "x"), (None, None, True, "x"),
        (7, base, True, "x"), (7, base, True, "x"), (8, base + " more", True, "x"), (8, "another text of its own", True, "x"), (9, "another text of its own", True, "x"),
        (10, "long " * 100_000, True, "x"), (11, " ".join(map(str, range(60_000))), True, "x"), (12, " ".join(map(str, range(61_000))), True, "x"), (-3, base.upper(), None, "x"),
    ]
    assert told(minhash_dedup.similar_classes(spark.createDataFrame(docs, DOCS))) == plain(docs)
    assert told(minhash_dedup.similar_classes(spark.createDataFrame([], DOCS))) == []


def test_estimates_are_near_the_truth():
    draw = np.random.RandomState(1)
    for share in (0.5, 0.85, 0.97):
        off = []
        for _ in range(40):
            all_ = draw.randint(1, 1 << 62, 1000).astype(np.uint64)
            both = int(2 * 1000 * share / (1 + share) / 2 * 1)
            a, b = np.sort(all_[:both + (1000 - both) // 2]), np.sort(np.concatenate([all_[:both], all_[both + (1000 - both) // 2 :]]))
            true = both / 1000
            packed = [minhash_dedup.pack(minhash_dedup.minima(np.zeros(len(x), np.int64), x, 1)) for x in (a, b)]
            off.append(float(minhash_dedup.estimate(packed[0], packed[1])[0]) - true)
        assert abs(np.mean(off)) < 0.03 and np.max(np.abs(off)) < 0.25
    assert 0.5 < minhash_dedup.least_estimate(85) < 0.6
