"""The pipeline against a plain composition of the same decisions."""

from collections import Counter

import pytest

import corpus_pipeline
from llm_plain import bpe_ids, components, leaks, line_dedup
from mementa.llm import toxicity


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE",
    ]


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, toxicity.grades(spark.read.parquet(f"{sf}/labels.parquet")))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if model.above(r["text"] or "")[0] < 0.5]
    rows = line_dedup(spark, rows)
    rows = [(i, t) for (i, t), c in zip(rows, components(rows)) if i == c]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(i, t) for i, t in rows if not leaks([(i, t)], items)]
    expected = Counter((i, tuple(bpe_ids(t))) for i, t in rows)
    found = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf).collect())
    assert found == expected and 0 < sum(found.values()) < docs.count()


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, sf, odd_docs, no_docs, empty):
    docs = no_docs if empty else odd_docs
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.columns == (columns if name != "byte-level BPE" else ["doc_id", "ids"])
    assert docs.count() == 0 if empty else docs.count() > 0
