"""The text operators on whole small tables and on edge cases, against brute force."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, canonical

from envidecl.llm import (
    components,
    decontaminate,
    jaccard_join,
    language,
    licenses,
    line_dedup,
    nearest,
    packing,
    perspectives,
    queries,
    tokens,
    toxicity,
    warc_store,
)
from envidecl.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BPE, PIECES = queries.BYTE_BPE, queries.PIECES
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
EDGES = [
    None, "", " \n\t ", "one", "Two words", LONG, "a b c d e", "A B C D E", "a b c d e", "ünï cödé ß × – 12,5", "x" * 5000, "é" * 3000,
    "line that is long enough to count\nline that is long enough to count\nshort", "  LINE that is long enough to count \nother",
    "line that is long enough to count", "under the MIT License, cc by-nc", "Relased under teh MIT License",
]


def edge_docs(spark):
    """Nulls, empties, long texts, ties, repeated rows and clashing columns."""
    rows = [(k, t, "en" if k % 2 else None, "s", len(t or "")) for k, t in enumerate(EDGES)]
    rows += [rows[6], rows[6], (None, "a b c d e f", None, None, None), (None, None, None, None, None)]
    clash = {c: F.lit(1) for c in ("score", "token", "_h", "cls", "n", "line", "hash", "component_id", "_score", "piece")}
    return spark.createDataFrame(rows, DOCS).withColumns(clash)


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert canonical(ours) == canonical(theirs)


def test_words_and_shingles():
    import pyarrow as pa

    for alphabet, split in ((tokens.SPACED, lambda t: t.encode().lower().split()), (tokens.ALNUM, lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.encode().lower()))):
        raw, rows = tokens.buffers(pa.array(EDGES))
        row, start, stop, h = tokens.words(raw, rows, alphabet)
        want = [split(t or "") for t in EDGES]
        assert [bytes(raw[a:b]).lower() for a, b in zip(start, stop, strict=True)] == [w for t in want for w in t]
        r, s = tokens.shingles(row, h, len(EDGES))
        assert np.bincount(r, minlength=len(EDGES)).tolist() == [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) > 4 else int(bool(w)) for w in want]


def test_chunks_are_cut_between_words(monkeypatch):
    import pyarrow as pa

    whole = tokens.words(*tokens.buffers(pa.array(EDGES)), tokens.SPACED)
    monkeypatch.setattr(tokens, "CHUNK", 7)
    for a, b in zip(whole, tokens.words(*tokens.buffers(pa.array(EDGES)), tokens.SPACED), strict=True):
        assert (a == b).all()


# --- 7 ------------------------------------------------------------------------------------------
def brute_lines(rows):
    blank = " \t\n\x0b\f\r"
    seen = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None:
                seen[line.strip(blank).translate(UP)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(k := x.strip(blank).translate(UP)) < 20 or len(seen[k]) < 3 or d == max(seen[k])]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_edges(spark):
    docs = edge_docs(spark)
    want = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, line_dedup.line_digests(docs).collect()), key=str) == want
    full = line_dedup.dedup_lines(docs)
    assert full.columns[: len(docs.columns)] == docs.columns and full.count() == docs.count()
    assert line_dedup.line_digests(docs.limit(0)).count() == 0


# --- 8 ------------------------------------------------------------------------------------------
def brute_classes(rows):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and a is not None and b is not None and 100 * len(s & u) >= 80 * len(s | u):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def near_copies(seed, groups=12, most=9):
    rng = np.random.RandomState(seed)
    out = []
    shared = [f"p{k}" for k in range(60)]
    for _ in range(groups):
        base = [f"w{rng.randint(400)}" for _ in range(rng.randint(3, 160))]
        if rng.rand() < 0.4:
            base += shared
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40) + 1)):
                copy[rng.randint(len(copy))] = f"x{rng.randint(10_000)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 150])
def test_jaccard_join(spark, block):
    """Small blocks make every pivot a heavy one."""
    rows = [(k, t) for seed in range(3) for k, t in enumerate(near_copies(seed), 1000 * seed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.similar_classes(docs, block=block).collect()), key=str)
    assert got == brute_classes(rows)


def test_linked_sets_share_enough_short_lists():
    rng = np.random.RandomState(8)
    for _ in range(400):
        n = rng.randint(1, 400)
        a = set(rng.permutation(1 << 20)[:n].tolist())
        b = set(list(a)[rng.randint(0, n // 5 + 1) :]) | set((rng.permutation(1000) + (1 << 20))[: rng.randint(0, n // 8 + 1)].tolist())
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        shared = set(sorted(a)[: jaccard_join.prefix(len(a), 80)]) & set(sorted(b)[: jaccard_join.prefix(len(b), 80)])
        for x in (a, b):
            assert len(shared) >= 1 + len(x) * 80 // (100 * jaccard_join.MERGED)


def test_jaccard_join_edges(spark):
    docs = edge_docs(spark)
    got = sorted(map(tuple, jaccard_join.similar_classes(docs).collect()), key=str)
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert jaccard_join.similar_classes(docs.limit(0)).count() == 0


def test_search_finds_all_components():
    rng = np.random.RandomState(5)
    for _ in range(20):
        sets = []
        for _ in range(rng.randint(2, 40)):
            if sets and rng.rand() < 0.6:
                s = set(sets[rng.randint(len(sets))].tolist())
                for x in list(s)[: rng.randint(0, max(1, len(s) // 6) + 1)]:
                    s.discard(x)
                    s.add(int(rng.randint(1 << 40)))
            else:
                s = set(rng.randint(0, 1 << 40, rng.randint(1, 60)).tolist())
            sets.append(np.array(sorted(s), np.uint64))
        n = len(sets)
        group = jaccard_join.search(sets, np.arange(n), np.full(n, 2), 80)
        link = [[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets]
        reach = np.linalg.matrix_power(np.array(link, float), n) > 0
        assert ((group[:, None] == group[None]) == reach).all()


def test_components(spark):
    rows = [(k, k + 1) for k in range(100, 160)] + [(5, 3), (9, 5), (3, 9), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(rows, "a long, b long"), Scratch(spark, "t")).collect()))
    assert {v for k, v in got.items() if k >= 100} == {100} and {got[k] for k in (3, 5, 9)} == {3}


# --- 10 -----------------------------------------------------------------------------------------
def test_decontamination_edges(spark):
    item = " ".join(f"t{k}" for k in range(30))
    near = " ".join(f"t{k}" if k != 1 else "other" for k in range(30))
    far = " ".join(f"t{k}" if k != 15 else "other" for k in range(12, 30))
    docs = docs_of(spark, [LONG + " " + item.upper() + ". " + LONG, near, far, "so short it is", None, "", item.replace(" ", ", ")]).withColumns({c: F.lit(1) for c in ("item_id", "_h", "shared")})
    docs = docs.unionByName(docs.where("doc_id = 1"))
    items = spark.createDataFrame([(1, item), (2, "short it"), (3, None), (4, ""), (None, item), (5, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.find_leaks(docs, items).collect()}
    assert set(got) == {(d, i) for d in (0, 1, 6) for i in (1, 5)} | {(3, 2)}
    assert got[(0, 1)] == 1.0 and 0.8 <= got[(1, 1)] < 1
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [2, 4, 5]
    assert decontaminate.find_leaks(docs.limit(0), items).count() == decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    shuffled = decontaminate.find_leaks(docs, items, broadcast_shingles=0)
    assert {(r["doc_id"], r["item_id"]): r["containment"] for r in shuffled.collect()} == got


def test_sketches_alone_find_candidates(spark):
    sizes = [1, 3, 4, 7, 8, 12, 15, 16, 40]
    items = spark.createDataFrame([(m, " ".join(f"i{m}w{k}" for k in range(m + 4))) for m in sizes], "item_id long, text string")
    rows = decontaminate.item_shingles(items, 0.8, 5).collect()
    held = Counter(r["item_id"] for r in rows if r["_in"])
    assert held == {1: 1, 3: 1, 4: 2, 7: 2, 8: 4, 12: 4, 15: 4, 16: 7, 40: 13}  # 63 - ceil(0.8 * 63) + 1
    # A document of all shingles but one: a candidate by any sketch shingle, whichever one is missing.
    w = [f"i8w{k}" for k in range(12)]
    docs = docs_of(spark, [" ".join(w[1:]), " ".join(w[:-1]), " ".join(w[:5]), " ".join(w[7:]), *(" ".join(w[k : k + 5]) for k in range(8))])
    sketches = decontaminate.item_shingles(items, 0.8, 5).where("_in").select("item_id", "_n", "_h")
    found = {r["doc_id"] for r in decontaminate.candidates(docs, sketches, [5]).collect()}
    assert {0, 1} <= found and len(found - {0, 1, 2, 3}) == 4  # of single shingles, those of the sketch
    assert {r["doc_id"] for r in decontaminate.find_leaks(docs, items).collect()} == {0, 1}


# --- 9 ------------------------------------------------------------------------------------------
def test_plan_packs_everything_once():
    rng = np.random.RandomState(2)
    for n in (0, 1, 7, 300, 3000):
        counts = Counter(np.minimum(2048, rng.exponential(700, n).astype(int) + 1).tolist())
        rows, bins = packing.plan(dict(counts))
        filled = [[] for _ in range(bins)]
        placed = Counter()
        for size, lo, hi, each, first, offset in rows:
            assert lo == placed[size]
            placed[size] = hi
            for r in range(lo, hi):
                filled[first + (r - lo) // each].append((offset + (r - lo) % each * size, size))
        assert placed == counts
        for f in filled:
            at = 0
            for offset, size in sorted(f):
                assert offset == at
                at += size
            assert 0 < at <= 2048
        if n >= 300:
            assert bins <= 1.02 * sum(k * v for k, v in counts.items()) / 2048 + 2


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = edge_docs(spark).unionByName(docs_of(spark, ["<|endoftext|> it's  a 'test", "a\n\nb  c", "Ωmega αβ"]).withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    t = Tokenizer.from_file(BPE)
    want = Counter()
    for r in docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        at = 0
        for k, end in enumerate(range(head, len(ids) + 1, 2048)):
            want[(r["doc_id"], k, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes()))] += 1
            at = end
    rows = packing.pack(docs, BPE).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for f in by.values():
        at = 0
        for offset, size in sorted(f):
            assert offset == at
            at += size
        assert at <= 2048
    assert packing.pack(docs.limit(0), BPE).count() == 0


def test_units_give_the_plain_tokenizers_ids(monkeypatch):
    """100,000 random strings of letters, signs, white space of all kinds and the end token's literal."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = np.random.RandomState(9)
    signs = [*"ab sS'tTreEvml d19.,-(\"\n\t \r\x0b\x0c\x1c\x1f\x00\x85\xa0é×÷ßɐɏ\u2003\u3000\u1680\u2028中文Ω٣½²_😀\u0301\u200b\u180e\ufeff’“", "  ", " '", "'ll", "<|endoftext|>"]
    weight = np.ones(len(signs))
    weight[2], weight[-1] = 6, 0.05
    texts = ["".join(signs[k] for k in rng.choice(len(signs), rng.randint(0, 14), p=weight / weight.sum())) for _ in range(100_000)]
    plain = [x.ids for x in Tokenizer.from_file(BPE).encode_batch_fast(texts, add_special_tokens=False)]
    encode = packing.UnitEncoder(BPE)
    for chunk, n in ((tokens.CHUNK, len(texts)), (7, 5000)):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        counts, ids = encode(pa.array(texts[:n]))
        assert counts.tolist() == [len(x) for x in plain[:n]]
        assert ids.tolist() == [k for x in plain[:n] for k in x]
    assert encode.added == ["<|endoftext|>"] and any(50256 in x for x in plain)
    # A table that is cleared all the time, and units longer than a chunk.
    encode.table = packing.Table(units=256, ids=512)
    texts = ["x" * 50 + "é" * 40, "中" * 60 + " y", *texts[:300]]
    for lo in range(0, len(texts), 5):
        part = texts[lo : lo + 5]
        assert encode(pa.array(part))[1].tolist() == [k for x in encode.tokenizer.encode_batch_fast(part, add_special_tokens=False) for k in x.ids]


def test_packing_is_near_the_optimum():
    """Against the least number of bins, by search, for small cases of all kinds."""

    def least(sizes, capacity):
        best = len(sizes)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(sizes):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + sizes[k] <= capacity and bins[j] not in bins[:j]:
                    bins[j] += sizes[k]
                    go(k + 1, bins)
                    bins[j] -= sizes[k]
            go(k + 1, [*bins, sizes[k]])

        go(0, [])
        return best

    rng = np.random.RandomState(3)
    over = 0
    for _ in range(150):
        sizes = sorted(rng.randint(1, rng.choice([12, 31]), rng.randint(1, 12)).tolist(), reverse=True)
        bins = packing.plan(dict(Counter(sizes)), 30)[1]
        want = least(sizes, 30)
        assert want <= bins <= want + 1
        over += bins > want
    assert over <= 8


# --- 3 ------------------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "ü\r\n", "<p>a</p>", LONG, "<p>a</p>"]
    rows = [(k, f"http://x/{k}\r\nEvil: 1", h) for k, h in enumerate(html)] + [(0, None, "<p>a</p>"), (None, "u", "<p>a</p>"), (None, "u", "only null")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "payload", "owner", "size")})
    archive = warc_store.write(pages, Scratch(spark, "t"))
    assert archive.payloads.count() == len({h or "" for *_, h in rows})
    records = warc_store.read(archive).collect()
    assert len(records) == len(rows)
    for r in records:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert block == (b"" if b"revisit" in head.split(b"\r\n")[1] else bytes(r["payload"])) + b"\r\n\r\n" and size == len(block) - 4
        assert b"\r\nEvil" not in head
        digest = base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest())
        assert b"sha1:" + digest in head
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc_store.page_digests(pages).collect() if r["page_id"] is not None}
    assert got[0] == ("response", None, 8) and got[3] == ("revisit", 0, 8) and got[1] == ("response", None, 0) and got[2] == ("revisit", 1, 0)
    assert warc_store.page_digests(pages.limit(0)).count() == 0
    parsed = {(r["page_id"], bytes(r["header"]) + bytes(r["block"]) + b"\r\n\r\n") for r in warc_store.parse(warc_store.read(archive)).collect()}
    assert parsed == {(r["page_id"], bytes(r["record"])) for r in records}
    read = warc_store.read(archive)
    other = F.concat(F.substring(F.col("record"), F.lit(1), F.octet_length("record") - 5), F.lit(b"y\r\n\r\n"))
    for what, changed in {"length": F.concat("record", F.lit(b"z")), "digest": other, "record digest": F.encode(F.replace(F.decode("record", "UTF-8"), F.lit("http://x"), F.lit("http://y")), "UTF-8")}.items():
        with pytest.raises(Exception, match=what):
            warc_store.parse(read.where("page_id = 4").withColumn("record", changed)).collect()
    # The query's plan holds the rebuilt record, so nothing is told of it that its bytes do not say.
    plan = warc_store.page_digests(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "0D0A0D0A" in plan and "record digest" in plan
    broken = warc_store.Archive(archive.payloads.withColumn("payload", F.lit(b"x")), archive.headers)
    with pytest.raises(Exception, match="does not match"):
        warc_store.read(broken).collect()


# --- 6 ------------------------------------------------------------------------------------------
def exact_nearest(ids, x, q, k=20):
    """The k best ids of a query by products of rows in double precision, equal ones by id."""
    score = (x * x[q]).sum(axis=1)
    score[ids == ids[q]] = -np.inf
    return [(int(ids[i]), float(score[i])) for i in np.lexsort((ids, -score))[:k]]


def found_nearest(v, **kw):
    got = defaultdict(list)
    for r in nearest.nearest(v, F.col("vec_id") % 20 == 0, **kw).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_nearest_recall_and_edges(spark):
    rng = np.random.RandomState(3)
    x = rng.randn(1500, 16).round(3)
    x[40] = x[60] = x[80]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("nan")] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (2005, [1.0] * 3), (None, [1.0] * 16), (2006, [])]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + bad + [(0, x[0].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("shard", "kind", "rank", "score", "cell", "kth")})
    x = x.astype(np.float32).astype(np.float64)
    ids = np.arange(1500)
    exact = {q: exact_nearest(ids, x, q) for q in range(0, 1500, 20)}
    assert found_nearest(v, factor=1.0, shard_rows=40) == exact
    got = found_nearest(v)
    assert sorted(got) == sorted(exact)
    assert np.mean([len(set(got[q]) & set(exact[q])) / 20 for q in got]) >= 0.9
    assert all(len(f) == 20 and f == sorted(f, key=lambda y: (-y[1], y[0])) for f in got.values())
    few = nearest.nearest(v.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3, 4]
    assert nearest.nearest(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.nearest(v.where("vec_id % 20 = 1"), F.col("vec_id") % 20 == 0).count() == 0


def otherwise_than_the_sample():
    """Candidates in tight clusters, queries in between: what suits the sample misses what is near to queries."""
    rng = np.random.RandomState(11)
    middle = rng.randn(100, 32)
    x = middle[rng.randint(0, 100, 4000)] + 0.05 * rng.randn(4000, 32)
    x[::20] = rng.randn(200, 32)
    return x


def test_nearest_for_queries_unlike_the_sample(spark):
    x, ids = otherwise_than_the_sample(), np.arange(4000)
    v = spark.createDataFrame([(int(k), y.tolist()) for k, y in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    assert found_nearest(v) == {q: exact_nearest(ids, x, q) for q in range(0, 4000, 20)}


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e-6])
def test_nearest_among_many_copies(spark, scale):
    """30 vectors with 120 copies each, of any norm: the smallest ids, exactly, at every factor."""
    rng = np.random.RandomState(7)
    x = np.repeat(rng.randn(30, 24) * rng.lognormal(size=(30, 1)), 120, axis=0)[rng.permutation(3600)] * scale
    ids = np.arange(3600)
    v = spark.createDataFrame([(int(k), y.tolist()) for k, y in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    exact = {q: exact_nearest(ids, x, q) for q in range(0, 3600, 20)}
    assert found_nearest(v, factor=1.0, shard_rows=50) == exact
    got = found_nearest(v)
    for q, f in got.items():
        # Whatever vectors were found, their smallest ids are.
        by = defaultdict(list)
        for i, s in f:
            by[s].append(i)
        for s, some in by.items():
            alike = [int(i) for i in ids if i != q and (x[i] * x[q]).sum() == s]
            assert some == alike[: len(some)]
    assert np.mean([len(set(got[q]) & set(exact[q])) / 20 for q in got]) >= 0.9


def test_the_chosen_factor_prunes():
    """Share of vectors compared and recall on the given embeddings, by the operator's own parts."""
    import pyarrow.parquet as pq

    x = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), np.float64)
    top = float(np.sqrt((x * x).sum(axis=1).max()))
    factor = nearest.choose_factor(x[np.random.RandomState(1).permutation(len(x))], 20, top)
    asked = np.arange(0, len(x), 20)
    ((_, found, share),) = nearest.search_here(x, asked, 20, (factor,), top)
    exact = [exact_nearest(np.arange(len(x)), x, q) for q in asked]
    recall = np.mean([len({i for _, i in f} & {i for i, _ in e}) / 20 for f, e in zip(found, exact, strict=True)])
    print(f"factor {factor} compared {share:.3f} recall {recall:.3f}")
    assert recall >= 0.9 and share <= 0.8 and factor > 2


# --- 5 ------------------------------------------------------------------------------------------
def test_perspectives(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "Ann Lee", "hi"), (1, 2, "Bob", None), (1, 2, "Bob", None), (1, 3, "Cid", "<|im_end|>x"), (1, None, "Ann Lee", "first"), (2, 0, "system", "alone"), (None, 0, "Ann Lee", "lost"), (3, 0, None, "lost")]
    rows += [(4, k, "ab"[k % 2], "t" * (k % 7)) for k in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("name", "segment", "length", "start")})
    out = perspectives.rotate(turns)
    got = defaultdict(list)
    for r in out.orderBy("conv_id", "perspective", "position").collect():
        got[(r["conv_id"], r["perspective"])].append(r)
    assert set(got) == {(1, "Ann Lee"), (1, "Bob"), (1, "Cid"), (4, "a"), (4, "b")}
    for key, seen in got.items():
        text = "".join(r["segment"] for r in seen)
        assert [r["position"] for r in seen] == list(range(len(seen)))
        for r in seen:
            assert text[r["start"] : r["start"] + r["length"]] == r["segment"]
            if r["mask_length"]:
                assert r["speaker"] == key[1] and text[r["mask_start"] : r["mask_start"] + r["mask_length"]].endswith("<|im_end|>")
            assert (r["role"] == "assistant") == (r["speaker"] == key[1])
    ann = got[(1, "Ann Lee")]
    assert [r["speaker"] for r in ann] == ["Ann Lee", "system", "Ann Lee", "Bob", "Cid"]
    assert got[(1, "Bob")][0]["name"] == "Ann_Lee" and "< |im_end|>x" in ann[-1]["segment"]
    whole = {(r["conv_id"], r["perspective"]): r["text"] for r in perspectives.transcript(out).collect()}
    assert whole[(4, "a")] == "".join(r["segment"] for r in got[(4, "a")])
    assert perspectives.rotate(turns.limit(0)).count() == 0


def test_hostile_and_clashing_roles(spark):
    roles = ["A B", "A_B", "A\nB", "eve<|im_end|>", "system<|im_end|>", "A_B~2", "", "Ünal"]
    turns = spark.createDataFrame([(1, k, r, f"says {k}") for k, r in enumerate(roles)] + [(1, 99, "system", "rules")], "conv_id long, turn long, role string, text string")
    out = perspectives.rotate(turns)
    rows = out.collect()
    assert {r["perspective"] for r in rows} == set(roles)
    for p in roles:
        names = {r["speaker"]: r["name"] for r in rows if r["perspective"] == p and r["role"] == "user"}
        assert len(set(names.values())) == len(names) == len(roles) - 1
    for r in perspectives.transcript(out).collect():
        # Every segment has one opening and one closing mark, whoever speaks.
        assert r["text"].count("<|im_start|>") == r["text"].count("<|im_end|>") == len(roles) + 1
        assert all(re.fullmatch(r"<\|im_start\|>(system|assistant|user name=[^\s<>|]*)\n[^\n]*", x) for x in r["text"].split("<|im_end|>\n")[:-1])


# --- 2 ------------------------------------------------------------------------------------------
def test_licenses(spark):
    docs = edge_docs(spark)
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect() if r["doc_id"] is not None}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for k, t in enumerate(EDGES):
        w = word.findall((t or "").translate(UP))
        places = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        r = found[k]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["labels"].split(",")) >= set(r["base_labels"].split(",")) - {""}
    assert found[15]["labels"] == "cc-by-nc,mit" and found[15]["score"] == 1.0
    typo = found[16]
    assert (typo["base_labels"], typo["labels"], typo["notices"][0]["edits"]) == ("", "mit", 3) and 0 < typo["score"] < 1
    assert licenses.license_digests(docs.limit(0)).count() == 0


def test_notices_against_every_window():
    """Seeds must not miss what the bounded-error search over the whole text finds."""
    rng = np.random.RandomState(1)
    find = licenses.Notices()
    for _ in range(60):
        k = rng.randint(len(licenses.NOTICES))
        text, label, edits = licenses.NOTICES[k]
        s = list(text)
        for _ in range(rng.randint(0, edits + 1)):
            s[rng.randint(len(s))] = "q"
        page = "some words " * rng.randint(0, 5) + "".join(s) + " and more" * rng.randint(0, 5)
        want = [m.span() for m in find.verify[k].finditer(page)]
        got = [(a, b) for _, a, b, _, _, n in find(page) if n == k]
        assert bool(want) == bool(got) and label in {x[0] for x in find(page)}


@pytest.mark.parametrize(
    "text",
    [
        "licensed under cc by sa 4 0", "licensed under cc by nd 4 0", "licensed under cc by nd 3 0", "released under the bsd license",
        "released under the gpl license", "released under the isc license", "released under the zlib license", "released under the same license",
        "licensed under the gnu general public license version 2", "licensed undr the gnu general public license version 2 or later",
        "licensed under the gnu general public license version two", "licensed under the gnu general public license version 35",
        "licensed under the gnu general public license version", "mozilla public license version 1 1", "mozilla public license version 1 0",
        "licensed under the apache license version 1 1", "licensed under the apache license version 12 0", "licensed under the apple license version 2 0",
        "licensed under the apache license version", "creative commons attribution commercial",
    ],
)
def test_other_licences_are_no_near_copies(text):
    find = licenses.Notices()
    assert not find(text) and not find(f"some words {text} and more")


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("relased under teh mit license", "mit"), ("released under the mti license", "mit"), ("released under themit license", "mit"),
        ("released under the mut license", "mit"), ("licensed under cc bync 4 0", "cc-by-nc"), ("licensed under cc by n c 4 0", "cc-by-nc"),
        ("licensed under cc by nc 3 0", "cc-by-nc"), ("creative commons attribution non commercial", "cc-by-nc"),
        ("licenced under the gnu general public licence version 3", "gpl-3"), ("licensed under the gnu general public license version3", "gpl-3"),
        ("licensed under gnu general public license version 3", "gpl-3"), ("mozilla public licence version 2", "mpl-2"),
        ("licensed under the apahce license version 2 0", "apache-2"), ("licensed under the apache licence version 2", "apache-2"),
    ],
)
def test_misspelt_notices_stay(text, label):
    find = licenses.Notices()
    for page in (text, f"some words {text} and more"):
        assert [x[0] for x in find(page)] == [label]


def test_time_grows_with_repeated_notices_and_no_faster():
    """Near copies in one long text; each range is bounded, so twice the copies take about twice the time."""
    import time

    find = licenses.Notices()
    took = {}
    for n in (1000, 2000, 4000):
        page = "relased under teh mit license " * n
        began = time.perf_counter()
        found = find(page)
        took[n] = time.perf_counter() - began
        assert len(found) == n and all(b[1] >= a[2] for a, b in zip(found, found[1:], strict=False))
    assert took[4000] < 3 * took[2000] + 0.2


def test_spans_stand_in_the_query(spark):
    docs = spark.createDataFrame([(1, "Relased under teh MIT license, and again: relased under teh mit license"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in licenses.license_digests(docs).collect()}
    assert got == {1: "mit:0:29:3 mit:40:69:3", 2: "", 3: ""}


def test_adjacent_notices_are_all_found():
    find = licenses.Notices()
    both = find("released under teh mit license released under the mit license")
    assert [(x[1], x[2], x[3]) for x in both] == [(0, 30, 2), (31, 61, 0)]
    assert [x[3] for x in find("all rights reserve d all rights reserved")] == [1, 0]
    rng = np.random.RandomState(2)
    for _ in range(200):
        k = rng.randint(len(licenses.NOTICES))
        text, _, edits = licenses.NOTICES[k]
        page, copies = "some words ", []
        for _ in range(rng.randint(2, 7)):
            s = list(text)
            for _ in range(rng.randint(0, edits + 1)):
                s[rng.randint(text.index(" "))] = "q"
            copies.append((len(page), len(page) + len(text)))
            page += "".join(s) + " "
        got = sorted((a, b) for _, a, b, _, _, n in find(page) if n == k)
        assert len(got) == len(copies)
        assert all(abs(a - lo) <= edits and abs(b - hi) <= edits for (a, b), (lo, hi) in zip(got, copies, strict=True))


# --- 4 ------------------------------------------------------------------------------------------
def brute_sums(pieces, prob, word):
    """Sums over all segmentations of a word by plain recursion, in logs of exact big fractions."""
    from fractions import Fraction

    text = b" " + word
    known = {p: [Fraction(float(x)) for x in prob[k]] for k, p in enumerate(pieces)}
    sums = [[Fraction(1)] * prob.shape[1]]
    for t in range(1, len(text) + 1):
        here = [Fraction(0)] * prob.shape[1]
        for n in range(1, t + 1):
            if (p := known.get(text[t - n : t])) is not None:
                here = [x + y * z for x, y, z in zip(here, sums[t - n], p, strict=True)]
        sums.append(here)
    return [math.log(x.numerator) - math.log(x.denominator) for x in sums[-1]]


def test_forward_sums_all_segmentations(monkeypatch):
    import pyarrow as pa

    own = [b" th", b"the", b"he", b"in", b"ing", b" a", b"ab", b"a piece of more bytes than twelve".replace(b" ", b""), b"ababababababababababababa"]
    p = language.Pieces(own)
    assert p.longest == 27
    everything = sorted({*own, *(bytes([k]).lower() for k in range(256))})
    rng = np.random.RandomState(0)
    prob = rng.rand(p.n, 2) / p.n
    words = ["the", "thing", "ab", "x", "é", "ab" * 70, "apieceofmorebytesthantwelve" * 4 + "x", "thein" * 12]
    raw, rows = tokens.buffers(pa.array(words))
    _, start, stop, _ = tokens.words(raw, rows, tokens.ALNUM)
    for k, w in enumerate(words):
        one = np.array([k])
        want = brute_sums(everything, prob, w.encode())
        assert np.allclose(language.log_sums(*p.lattice(raw, start[one], stop[one]), prob)[0], want, rtol=1e-9)
        assert np.allclose(language.long_log_sum(p, raw[start[k] : stop[k]], prob), want, rtol=1e-9)
    scorer = language.Scorer(p, language.Model(["a", "b"], prob))
    for together in (language.TOGETHER, 30):
        monkeypatch.setattr(language, "TOGETHER", together)
        got = scorer._new(raw, start, stop)
        assert np.allclose(got, [brute_sums(everything, prob, w.encode()) for w in words], rtol=1e-9)
    # Expected counts: their bytes are the words' own, and they are the slope of the log sums.
    lattice, begin, size = p.lattice(raw, start, stop)
    counts = language.expected(lattice, begin, size, prob, np.ones((len(words), 2)))
    assert np.allclose(sum(counts[k] * len(x) for k, x in enumerate(everything)), size.sum())
    for k in (everything.index(b"ab"), everything.index(b"t"), everything.index(b"a")):
        more = prob.copy()
        more[k] *= 1 + 1e-6
        slope = sum(np.array(brute_sums(everything, more, w.encode())) - brute_sums(everything, prob, w.encode()) for w in words) / 1e-6
        assert np.allclose(counts[k], slope, rtol=1e-3, atol=1e-4)


def test_language_against_plain_sums(spark):
    """Predictions of whole texts, long unspaced ones too, by a plain recursion over every word."""
    pieces = language.load_pieces(PIECES)
    rng = np.random.RandomState(5)
    p = rng.dirichlet(np.full(pieces.n, 0.05), 3).T + 1e-9
    model = language.Model(["x", "y", "z"], p)
    texts = ["the quick brown fox", "日本語" * 300 + " abc", "Ünïcode straße, 12 words", "a" * 3000]
    got = {r["doc_id"]: r for r in language.identify(docs_of(spark, texts), model, PIECES).collect()}
    index = {}

    def ids(text):
        if text not in index:
            raw = np.frombuffer(text, np.uint8)
            h = language._run_hash(language._hashes(raw), np.array([0]), len(raw))
            k = int(np.searchsorted(pieces.sorted, h)[0])
            index[text] = int(pieces.id[k]) if k < pieces.n and pieces.sorted[k] == h[0] else None
        return index[text]

    for d, text in enumerate(texts):
        logs = np.zeros(3)
        for word in re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.encode().lower()):
            t = b" " + word
            sums, scale = [np.ones(3)], [np.zeros(3)]
            for e in range(1, len(t) + 1):
                at = [(n, k) for n in range(1, min(e, pieces.longest) + 1) if (k := ids(t[e - n : e])) is not None]
                terms = np.array([np.log(sums[e - n]) + scale[e - n] + np.log(p[k]) for n, k in at])
                top = terms.max(axis=0)
                sums.append(np.exp(terms - top).sum(axis=0)), scale.append(top)
            logs += np.log(sums[-1]) + scale[-1]
        best = int(logs.argmax())
        assert got[d]["lang_pred"] == model.languages[best]
        assert abs(got[d]["score"] - 1 / np.exp(logs - logs.max()).sum()) < 1e-4


def test_language(spark):
    docs = sf_docs(spark)
    got = language.language(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.85
    edges = language.language(edge_docs(spark), PIECES).collect()
    assert len(edges) == len(EDGES) + 4 and all(0 <= r["score"] <= 1 for r in edges)
    by = {r["doc_id"]: r["lang_pred"] for r in edges}
    assert by[0] == by[1] == by[2] == "und" and by[5] == "en"
    assert language.language(edge_docs(spark).withColumn("lang", F.lit(None).cast("string")), PIECES).where("lang_pred <> 'und'").count() == 0
    assert language.language(docs.limit(0), PIECES).count() == 0


# --- 1 ------------------------------------------------------------------------------------------
def test_gradient_is_the_slope():
    rng = np.random.RandomState(4)
    d = toxicity.WORD_DIM + toxicity.CHAR_DIM
    p = {k: rng.randn(*s) for k, s in {"v": (2 * toxicity.HIDDEN,), "w": (2 * toxicity.HIDDEN,), "Uf": (toxicity.HIDDEN, 3 * toxicity.HIDDEN), "Ub": (toxicity.HIDDEN, 3 * toxicity.HIDDEN)}.items()}
    p = {k: (x * 0.3).astype(np.float32) for k, x in p.items()} | {"c": np.zeros(1, np.float32)}
    net = toxicity.Network(p, np.zeros(0, np.uint64))
    gf, gb = (rng.randn(9, 3 * toxicity.HIDDEN).astype(np.float32) for _ in range(2))
    at = rng.randint(0, 9, (3, toxicity.WINDOW))
    valid = np.arange(toxicity.WINDOW) < np.array([[32], [5], [1]])
    kept: list = []
    net.run(gf, gb, at, valid, kept)
    g, df, db = net.gradient(np.ones(3, np.float32), at, valid, kept, 9)
    for name, grad, array in (*[(k, g[k], p[k]) for k in ("v", "w", "Uf", "Ub")], ("f", df, gf), ("b", db, gb)):
        for _ in range(6):
            k = tuple(rng.randint(0, s) for s in array.shape)
            old, step = array[k], 3e-3
            array[k] = old + step
            up = net.run(gf, gb, at, valid).sum()
            array[k] = old - step
            down = net.run(gf, gb, at, valid).sum()
            array[k] = old
            assert abs((up - down) / (2 * step) - grad[k]) < 2e-2 * max(1, abs(grad[k])), name
    assert d == 16


def test_windows_against_a_plain_network():
    """Scores of random texts by loops over windows, words and gates."""
    import pyarrow as pa

    rng = np.random.RandomState(14)
    texts = [" ".join(rng.choice(["foo", "Bar", "ünï", "longerword", "x", "12", "awful"], rng.randint(1, 90))) for _ in range(25)] + ["", "one", None]
    raw, rows = tokens.buffers(pa.array(["foo bar longerword x"]))
    known = np.sort(tokens.words(raw, rows, tokens.ALNUM)[3])
    net = toxicity.train([(t, k % 2) for _ in range(20) for k, t in enumerate(texts[:20])], 400, known)
    got = toxicity.Scorer(net)(pa.array(texts))
    p, H = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def embed(word):
        raw = np.frombuffer(word, np.uint8)
        h = tokens.words(raw, np.array([0, len(raw)]), tokens.ALNUM)[3][0]
        e = p["E"][list(net.vocabulary).index(h)] if h in net.vocabulary else np.zeros(toxicity.WORD_DIM)
        low, grams = word.lower(), []
        for salt, g in [(n, low[i : i + n]) for n in (3, 4, 5) for i in range(len(low) - n + 1)] + [(n + 10, low[:n]) for n in (2, 3, 4, 5, 6) if len(low) >= n]:
            x = salt
            for b in g:
                x = (x * 0x9E3779B97F4A7C15 + int(tokens.BYTES[b])) % (1 << 64)
            grams.append(p["C"][int(tokens.mix(np.array([x], np.uint64))[0] % np.uint64(toxicity.BUCKETS))])
        return np.concatenate([e, np.mean(grams, axis=0) if grams else np.zeros(toxicity.CHAR_DIM)])

    def gru(xs, side):
        w, u, b, h, out = p["W" + side], p["U" + side], p["b" + side], np.zeros(H), []
        for x in xs:
            g, s = x @ w + b, h @ u
            z, r = sig(g[:H] + s[:H]), sig(g[H : 2 * H] + s[H : 2 * H])
            m = np.tanh(g[2 * H :] + r * s[2 * H :])
            h = (1 - z) * m + z * h
            out.append(h)
        return out

    for k, t in enumerate(texts):
        xs = [embed(w) for w in re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").encode())]
        best = 0.0
        for at in range(0, len(xs), toxicity.STRIDE):
            part = xs[at : at + toxicity.WINDOW]
            states = np.array([np.concatenate(x) for x in zip(gru(part, "f"), gru(part[::-1], "b")[::-1], strict=True)])
            a = np.exp(states @ p["v"])
            best = max(best, sig((a / a.sum()) @ states @ p["w"] + p["c"][0]))
            if at + toxicity.WINDOW >= len(xs):
                break
        assert abs(got[k] - best) < 1e-4


def test_long_documents_teach(spark, monkeypatch):
    """Training reads whole texts: words of any place get an embedding, and windows of any number are learned from."""
    import pyarrow as pa

    texts = [" ".join(f"w{k}" for k in range(n)) for n in (3, 2500, 2600, 2400)]
    docs = docs_of(spark, texts)
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2][: len(texts)]
    docs = docs.withColumn("doc_id", F.element_at(F.array(*map(F.lit, ids)), (F.col("doc_id") + 1).cast("int")).cast("long"))
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 20)
    net = toxicity.fit(docs, spark.createDataFrame([(i, 0, n % 2) for n, i in enumerate(ids)], "doc_id long, quality int, toxic int"))
    raw, start = tokens.buffers(pa.array([texts[1]]))
    assert set(tokens.words(raw, start, tokens.ALNUM)[3]) == set(net.vocabulary)
    monkeypatch.undo()
    rng = np.random.RandomState(4)
    rows, labels = [], []
    for k in range(120):
        w = [f"w{rng.randint(300)}" for _ in range(700)]
        if k % 3 == 0:
            w[rng.randint(700)] = w[rng.randint(700)] = "awful"
        rows.append((k, " ".join(w))), labels.append((k, 0, int(k % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = toxicity.fit(docs, labels)
    assert net.base is None
    got = {r["doc_id"]: r["_score"] for r in toxicity.score(spark.createDataFrame([(0, "it is awful here"), (1, "w1 w2 w3 w4")], "doc_id long, text string"), net).collect()}
    assert got[0] > 0.5 > got[1]


def test_blocks_of_windows_teach_the_same(monkeypatch):
    """Windows run again in blocks give the gradient of all windows at once."""
    rng = np.random.RandomState(3)
    texts = [" ".join(f"v{rng.randint(50)}" for _ in range(n)) for n in (900, 1, 40, 333)]
    net = toxicity.train([], 1, np.zeros(0, np.uint64))
    got = []
    for block in (10_000, 7):
        monkeypatch.setattr(toxicity, "TRAINED_WINDOWS", block)
        got.append(toxicity._slope(net, texts, np.array([1, 0, 1, 0], np.float32), 0.5, np.random.RandomState(1)))
    assert got[0].keys() == got[1].keys() == net.p.keys()
    assert all(np.allclose(got[0][k], got[1][k], rtol=1e-3, atol=1e-6) for k in net.p)


def toxic_corpus(spark, n=600):
    rng = np.random.RandomState(6)
    rows, labels = [], []
    for k in range(n):
        w = [f"w{rng.randint(300)}" for _ in range(rng.randint(5, 120))]
        bad = k % 5 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randint(len(w)), "awful" + "abcdefghij"[rng.randint(10)] * rng.randint(0, 3))
        rows.append((k, " ".join(w)))
        labels.append((k, 0, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = toxic_corpus(spark)
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"]]
    wrong = sum(r["predicted"] != r["toxic"] for r in held)
    assert wrong <= 0.03 * len(held)
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_toxicity_edges(spark):
    docs, labels = edge_docs(spark), spark.createDataFrame([(k, 0, k % 2) for k in range(40)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(EDGES) + 4 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (0, 1, 2)} == {0.0}
    assert toxicity.toxicity(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_workers_change_models(spark):
    docs = docs_of(spark, ["a b c"]).repartition(1)
    for base in (0.2, 0.7, 0.4):
        net = toxicity.Network({}, np.zeros(0, np.uint64), base)
        assert toxicity.score(docs, net).first()["_score"] == base
    for name in ("xx", "yy"):
        model = language.Model([name], np.full((language.load_pieces(PIECES).n, 1), 1e-4))
        assert language.identify(docs, model, PIECES).first()["lang_pred"] == name


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 1000])
    doc, begin, size = toxicity.windows(counts)
    at = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        seen = {w for b, s in zip(begin[doc == k], size[doc == k], strict=True) for w in range(b - at[k], b - at[k] + s)}
        assert seen == set(range(n))


def test_tokenizer_path_is_a_parameter():
    assert BPE == public_tokenizers.path("byte_bpe_50k.json")


def test_long_words_are_learned_whole(monkeypatch):
    """Expected counts of a long word, made part by part, are those of the whole lattice."""
    from envidecl.llm.queries import PIECES

    pieces, rng = language.load_pieces(PIECES), np.random.RandomState(8)
    p = rng.rand(pieces.n, 3) + 0.01
    p /= p.sum(axis=0)
    for n in (40, 41, 700):
        word = np.frombuffer("".join(rng.choice(["the", "ing", "ö", "a", "tion", "q"], n)).encode()[: n + 3], np.uint8)
        want = language.expected(*pieces.lattice(word, np.array([0]), np.array([len(word)])), p, np.array([[2.0, 0.0, 5.0]]))
        for part in (17, 40, 4096):
            monkeypatch.setattr(language, "LEARNED_PART", part)
            assert np.allclose(language.long_expected(pieces, word, p, np.array([2.0, 0.0, 5.0])), want, rtol=1e-6, atol=1e-9)
    # A long word counts as it stands: no piece of it begins after a border of its own.
    word = b"ab" * 600
    model = language.train(pieces, ["x"], [word], [1])
    blank = pieces.id[np.searchsorted(pieces.sorted, language._run_hash(language._hashes(np.frombuffer(b" ", np.uint8)), np.array([0]), 1)[0])]
    assert 0 < model.p[blank, 0] < 1.1 / 100


def test_every_language_is_learned(spark):
    """More values of lang than any fixed number: each has words of its own."""
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}q " * 20, f"l{k % 260:03d}") for k in range(260 * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from envidecl.llm.queries import PIECES

    model = language.fit(docs, PIECES)
    assert len(model.languages) == 260
