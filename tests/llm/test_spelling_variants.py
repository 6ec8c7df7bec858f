"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from tests.conftest import SF

from envidecl.llm import spelling_variants
from envidecl.llm.common import Scratch, table

DOCS = "doc_id long, text string, word string, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs):
    count = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return grouped({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})


def grouped(n):
    """All that one deletion or replacement of a word's letters leads to meets in a dictionary of patterns."""
    near = {w: set() for w in n}
    patterns = {}
    for w in n:
        for k in range(len(w)):
            patterns.setdefault((w[:k], w[k + 1 :]), []).append(w)
            if (short := w[:k] + w[k + 1 :]) in n:
                near[w].add(short), near[short].add(w)
    for same in patterns.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], form[w], n[form[w]] if form[w] else None, root, len(near[w]))
    return out


def told(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["form"], r["form_n"], r["root"], r["n_near"]) for r in rows}


def test_documents(spark):
    docs = table(spark, SF, "documents")
    expected = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert len(expected) > 1000 and any(v[1] for v in expected.values())
    assert told(spelling_variants.variants(docs)) == expected
    assert told(spelling_variants.variants(docs, block=2)) == expected


def test_edges(spark):
    long = "ab" * 3000
    docs = [
        (1, None, "w", 1), (2, "", "w", 1), (None, "Straße STRASSE strasse " * 3, None, None), (3, ("aaaaa aaaaaa aaaaaaa aaaab " * 4) + "aaaaa " * 9, "w", 1),
        (3, ("aaaaa aaaaaa aaaaaaa aaaab " * 4) + "aaaaa " * 9, "w", 1), (4, f"{long} {long}b {long[:-1]} " * 3, "w", 1), (5, "×÷abc étés-étés1étést Ābcdef" * 5, "w", 1),
        (6, "tiest tiesa tiesb " * 5 + "tiesa tiesb ties tie " * 9, "w", 1),
    ]
    docs += [(100 + k, "repeated words repeatet wordz repeatd " * 2, "w", 1) for k in range(300)]
    assert told(spelling_variants.variants(spark.createDataFrame(docs, DOCS))) == plain(docs)
    none = spelling_variants.variants(spark.createDataFrame([], DOCS))
    assert none.collect() == [] and none.columns == ["word", "n", "form", "form_n", "root", "n_near"]
    assert spelling_variants.variants(spark.createDataFrame([(1, "once upon a time", "w", 1)], DOCS)).collect() == []


def test_a_common_beginning_is_split(spark):
    draw = random.Random(5)
    letters = "abcdeé"
    words = {"internation" + "".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(2500)}
    words |= {"".join(draw.choice("ab") for _ in range(draw.randint(1, 9))) for _ in range(900)}
    n = {w: draw.randint(1, 30) for w in sorted(words)}
    near = spelling_variants.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), Scratch(spark, "test"), block=40)
    got = {r["word"]: (r["n_near"], r["best"]) for r in near.collect()}
    best = {w: (v[4], None) for w, v in grouped(n).items() if v[4]}
    assert {w: v[0] for w, v in got.items()} == {w: v[0] for w, v in best.items()}
