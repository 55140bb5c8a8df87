"""The pipeline as a whole, and its stages on odd rows."""

from __future__ import annotations

import pytest

import corpus_pipeline
from labelloom.llm.queries import QUERIES
from labelloom.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_from_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.stored(stage(spark, kept[-1], SF), "test-stage"))
        assert kept[-1].columns == COLUMNS
    start, clean, single, apart, mixed = kept
    scores = {r.doc_id: r.predicted for r in QUERIES["op1_toxicity"](spark, SF).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, bad in scores.items() if not bad)
    assert sorted(r.text for r in single.collect()) == sorted({r.text for r in clean.collect()})
    components = {r.component_id for r in near_duplicates(single).collect()}
    assert sorted(r.doc_id for r in apart.collect()) == sorted(components)
    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, SF)
    words = sum(len(r.text.split()) for r in mixed.collect())
    assert sum(r.words for r in packed.collect()) == words
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


@pytest.mark.parametrize("rows", [0, 1])
def test_stages_on_odd_rows(spark, rows):
    some = [
        (None, None, None, None, None, None, "k"),
        (1, "", None, "s", 0, 5, None),
        (1, "", None, "s", 0, 5, None),
        (2, "word " * 50_000, "en", None, 250_000, None, "k"),
        (2, "word " * 50_000, "en", None, 250_000, None, "k"),
        (3, "  \n ", "de", "s", 4, 1, "k"),
    ] * rows
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, _uid string"
    docs = spark.createDataFrame(some, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, SF), "odd")
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
        assert (out.count() > 0) == bool(rows)
