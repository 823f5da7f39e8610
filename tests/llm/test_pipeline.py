"""The pipeline's stages in a row, and its last rows."""

from collections import Counter

import corpus_pipeline

ROOT = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = first = spark.read.parquet(f"{ROOT}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, ROOT), "test")
        assert docs.columns == first.columns
        kept.append(docs.count())
    assert first.count() >= kept[0] > kept[1] > kept[2] and kept[3] >= kept[2]
    assert docs.select("doc_id").distinct().count() == kept[2]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, ROOT).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == kept[3] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
