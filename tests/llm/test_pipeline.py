import brute

import corpus_pipeline
from sparkrank.llm.sp_tokens import DEFAULT_MODEL


def test_decisions_take_effect(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, folder)
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert sum(q == 1 and k in kept for k, q in labels.items()) >= 0.99 * sum(q == 1 for q in labels.values())
    assert sum(q == 0 and k in kept for k, q in labels.items()) <= 0.05 * sum(q == 0 for q in labels.values())

    single = stages["near_duplicates"](spark, good, folder)
    left = {r["doc_id"] for r in single.collect()}
    classes = brute.near_classes(kept)
    assert left <= set(classes.values()) and len(left) >= len(set(classes.values())) - 3

    clean = stages["secrets"](spark, single, folder)
    assert {r["doc_id"] for r in clean.collect()} == left and not any(brute.secrets(r["text"]) for r in clean.collect())

    mixed = stages["mixing"](spark, clean, folder)
    assert mixed.columns == docs.columns
    tokens = stages["sentencepiece"](spark, mixed, folder)
    assert tokens.count() == mixed.count() and DEFAULT_MODEL


def test_run_applies_all_stages(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert found and all(r["round_trip"] for r in found)
