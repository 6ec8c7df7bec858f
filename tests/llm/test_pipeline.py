"""The pipeline's stages against plain versions of what each decides."""

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF

import corpus_pipeline
from envidecl.llm import decontaminate, jaccard_join, line_dedup


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns
        counts.append(docs.count())
        lost = {r["doc_id"] for r in before.select("doc_id").collect()} - {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "line_dedup":
            assert not lost
            kept = {r["doc_id"]: r["_kept"] for r in line_dedup.dedup_lines(before).collect()}
            assert all(kept[r["doc_id"]] == r["text"] and len(r["text"]) == r["n_chars"] for r in docs.collect())
        if name == "jaccard_join":
            classes = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_classes(before).collect()}
            assert lost == {d for d, c in classes.items() if d != c}
        if name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert lost == {r["doc_id"] for r in decontaminate.find_leaks(before, items).collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    assert counts == sorted(counts, reverse=True)


def test_missing_ids_and_texts_pass_through(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "x y", None, None, 3), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 3
    assert docs.where(F.col("doc_id").isNull()).count() == 1


def test_repeated_and_missing_ids_are_judged_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 40").orderBy("item_id").first()["text"]
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    leak = f"before {item} after"
    rows = [(7, a), (7, b), (7, a), (8, a), (None, c), (None, c), (None, b), (None, leak), (9, leak), (9, "clean words"), (None, None), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    stages = dict(corpus_pipeline.STAGES)
    unique = stages["jaccard_join"](spark, docs, SF).cache()
    assert unique.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in unique.collect()), key=str)
    assert kept == sorted([(7, a), (7, b), (None, c), (9, leak), (9, "clean words"), (None, None), (None, None)], key=str)
    clean = stages["decontamination"](spark, docs, SF)
    assert clean.columns == docs.columns
    texts = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert not any(t == leak for _, t in texts) and (9, "clean words") in texts and texts.count((None, c)) == 2


NAMES = ["_key", "_score", "_kept", "_n_lines", "_n_dropped", "_row", "_c1", "key", "node", "component", "n_shingles", "cls", "lang", "n_chars"]


def test_columns_of_any_name_pass_through(spark, monkeypatch):
    """Names that the operators use inside come out as they went in; empty tables and very long texts do, too."""
    from envidecl.llm import toxicity

    # A network that finds nothing toxic.
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: toxicity.Network({}, np.zeros(0, np.uint64), 0.0))
    shared = "a line that stands in many of these documents"
    texts = [f"{k} own words of this text\n{shared}" for k in range(5)] + [None, "", "same same same same same same", "same same same same same same", "word " * 100_000]
    rows = [(k if k != 6 else None, t, *[f"{n}{k}" for n in NAMES[:-1]], len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{n} string' for n in NAMES[:-1])}, n_chars int")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, SF).cache(), stage(spark, empty, SF)
        assert docs.columns == ["doc_id", "text", *NAMES] and empty.count() == 0 and empty.columns == docs.columns
        got = docs.collect()
        assert len(got) == (9 if name in ("jaccard_join", "decontamination") else 10)
        for r in got:
            k = int(r["lang"].removeprefix("lang"))
            assert all(r[n] == f"{n}{k}" for n in NAMES[:-1]) and r["n_chars"] == len(r["text"] or "")
            assert r["text"] == (texts[k] or (texts[k] if name == "toxicity" else "")) or shared in texts[k]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("doc_id IS NOT NULL").select("doc_id").distinct().count() == 8
