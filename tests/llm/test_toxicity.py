"""Toxicity: grams, ratios and loss by definition, held-out rows of the table, odd texts."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import story
from pyspark.sql import functions as F

from sparkrank.llm import toxicity


def grams_of(text):
    """The distinct grams of a text by definition."""
    spaced = re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalnum() else " ", f" {(text or '').lower()} ")
    return {spaced[i : i + n] for n in toxicity.SIZES for i in range(len(spaced) - n + 1)}


def held(texts):
    """For each text the set of its grams' hashes."""
    owner, hashed = toxicity.distinct_grams(pa.array(texts, pa.string()), np.ones(toxicity.BUCKETS, bool))
    return [set(hashed[owner == k].tolist()) for k in range(len(texts))]


@pytest.mark.parametrize("slice_", [16, 1 << 19])
def test_grams_are_those_of_the_text(monkeypatch, slice_):
    monkeypatch.setattr(toxicity, "SLICE", slice_)
    texts = [None, "", "a", "Idiot!", "ab  cd\nab", "é😀ß ÉÀ", story(3, 60), "x" * 50, "Iİ", " .,;"]
    found, expected = held(texts), [grams_of(t) for t in texts]
    assert [len(f) for f in found] == [len(e) for e in expected]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    assert all(len(found[i] & found[j]) == len(expected[i] & expected[j]) for i, j in pairs)


def test_ratios_by_definition():
    ratio, apart = toxicity.ratios(np.array([3.0, 0.0]), np.array([1.0, 5.0]), 4, 10)
    assert ratio == pytest.approx([np.log((4 / 6) / (2 / 12)), np.log((1 / 6) / (6 / 12))])
    assert apart[0] > 0 > apart[1]


def test_fit_minimises_the_ridged_loss():
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(1, 40, 12).astype(np.uint64)) for _ in range(300)]
    toxic = np.array([(7 in x or 9 in x) != (r.random() < 0.1) for x in rows])
    c = toxicity.Classifier.fit(rows, toxic, features=10)
    known = np.unique(np.concatenate(rows))
    ratio, apart = toxicity.ratios(*[np.array([sum(k in x for x, t in zip(rows, toxic) if t == kind) for k in known], float) for kind in (True, False)], toxic.sum(), (~toxic).sum())
    best = np.sort(np.lexsort((known, -np.abs(apart)))[:10])
    assert (c.hashes == known[best]).all()
    x = np.array([[ratio[k] * (known[k] in row) for k in best] for row in rows])
    w = c.values / ratio[best]
    p = 1 / (1 + np.exp(-(x @ w + c.intercept)))
    assert np.abs(x.T @ (toxic - p) - w).max() < 1e-2 and abs((toxic - p).sum()) < 1e-2


def test_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert len(rows) > 60 and right >= 0.93 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(2)
    insult = lambda t: " ".join(x if k != 3 else "blockhead" for k, x in enumerate(t.split()))
    docs = [(k, insult(story(k, 60)) if k % 4 == 0 else story(k, 60)) for k in range(400)]
    docs += [(1000, story(5000, 40_000)), (1001, story(5000, 40_000) + " BLOCKHEAD!"), (1002, None), (1003, ""), (1004, "blockhead"), (None, "blockhead"), (1004, "blockhead")]
    labels = [(k, r.randint(0, 1), int(k % 4 == 0)) for k in range(400)] + [(0, 0, 0), (1, None, None), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("score", F.lit(0)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_one_word_in_a_long_text_counts(planted):
    rows = toxicity.toxicity_scores(*planted).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == 407 and found[1001]["predicted"] == 1 and found[1000]["predicted"] == 0
    assert found[1002]["score"] == found[1003]["score"] and found[1004]["predicted"] == found[None]["predicted"] == 1
    assert found[None]["held_out"] is False and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows if r["doc_id"] is not None and r["doc_id"] < 400)


def test_held_out_labels_change_nothing(planted):
    docs, labels = planted
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(0))
    score = lambda l: {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs.drop("score"), l).collect()}  # noqa: E731, E741
    assert score(labels) == score(turned)


def test_one_kind_of_label_scores_a_half(planted):
    docs, labels = planted
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels.where("toxic = 1")).collect()} == {0.5}
