import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import story

from sparkrank.llm import minhash, textscan
from sparkrank.llm.common import Scratch


def changed(text, n, seed):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies on either side of the threshold, and many texts that share a long passage."""
    base = {k: story(k) for k in range(12)}
    out = dict(base)
    for k in range(12):
        out[100 + k] = base[k]
        out[200 + k] = base[k].replace(" ", "\n", 3) + " "
        for n in range(1, 7):
            out[1000 * n + k] = changed(base[k], n, 10 * k + n)
    hot = story(500, 150)
    for k in range(260):  # one large group of near copies of which many are just too far from each other
        out[20000 + k] = changed(hot, k % 9, 7000 + k)
    passage = story(501, 60)
    for k in range(150):
        out[30000 + k] = f"{story(600 + k, 60)} {passage}"
    return out


def test_classes_equal_brute_force(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(rows).collect()}
    expected = brute.near_classes(texts)
    assert set(found) == set(texts)
    # brute force links by plain Jaccard; probability Jaccard may link some more, never fewer
    for k, c in expected.items():
        assert found[k] == found[c]
    assert sum(found[k] != expected[k] for k in texts) <= 0.02 * len(texts)
    sizes = {c: sum(1 for x in found.values() if x == c) for c in set(found.values())}
    assert all(sizes[found[30000 + k]] == 1 for k in range(150))


def test_keep_one_keeps_a_document_of_each_class(spark, texts):
    rows = spark.createDataFrame([(k, t, "x") for k, t in texts.items() if k < 20000], "doc_id long, text string, other string")
    kept = minhash.keep_one(rows)
    assert kept.columns == rows.columns
    classes = {r["class_id"] for r in minhash.near_duplicates(rows).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)


def test_signatures_estimate_probability_jaccard():
    r = random.Random(1)
    a = [f"w{r.randrange(400)}" for _ in range(500)]
    b = a[:350] + [f"v{r.randrange(400)}" for _ in range(150)]
    s = textscan.scan(pa.array([" ".join(a), " ".join(b)]))
    owner, value, count = textscan.shingles(s)
    signed = minhash.signatures(owner, value, minhash.weighed(count), 2, 4096)
    x, y = minhash._sets(pa.array([" ".join(a), " ".join(b)]))
    exact, _ = minhash.similarities(x, y)
    assert abs((signed[0] == signed[1]).mean() - exact) < 0.04


def test_similarities_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = {int(k): float(v) for k, v in zip(rng.choice(30, 12, False), rng.integers(1, 6, 12), strict=True)}
        b = {int(k): float(v) for k, v in zip(rng.choice(30, 15, False), rng.integers(1, 6, 15), strict=True)}
        every = set(a) | set(b)
        expected = sum(1 / sum(max(a.get(d, 0) / a[i], b.get(d, 0) / b[i]) for d in every) for i in set(a) & set(b))
        as_arrays = lambda m: (np.array(sorted(m), np.uint64), np.array([m[k] for k in sorted(m)]))
        p, j = minhash.similarities(as_arrays(a), as_arrays(b))
        assert p == pytest.approx(expected) and j == pytest.approx(len(set(a) & set(b)) / len(every))


def test_blocks_find_what_pairs_find():
    texts = [changed(story(9), k % 7, k) for k in range(40)] + [story(k) for k in range(40, 60)]
    sets = minhash._sets(pa.array(texts))
    links = minhash.block_links(sets[:25], sets, 0.8)
    for i in range(25):
        for j in range(len(sets)):
            assert links[i, j] == (max(minhash.similarities(sets[i], sets[j])) >= 0.8)


def test_blocks_of_repeating_texts_find_what_pairs_find(monkeypatch):
    monkeypatch.setattr(minhash, "OFTEN", 6)
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    monkeypatch.setattr(minhash, "MEETS", 50)
    r = random.Random(8)
    hot = story(9, 40)
    texts = [" ".join([changed(hot, k % 5, k)] + [" ".join(hot.split(" ")[3:12])] * r.randrange(6)) for k in range(40)]
    sets = minhash._sets(pa.array(texts))
    links = minhash.block_links(sets[:15], sets, 0.8)
    expected = [[max(minhash.similarities(a, b)) >= 0.8 for b in sets] for a in sets[:15]]
    assert 0.05 < np.mean(expected) < 0.9
    assert np.array_equal(links, expected)


def test_texts_that_link_share_a_shingle_of_their_prefixes():
    r = random.Random(4)
    hot = story(9, 60)
    texts = [" ".join([changed(hot, k % 9, k)] + [" ".join(hot.split(" ")[3:12])] * r.randrange(6)) for k in range(60)] + ["one", "two words", ""]
    owner, value, count = textscan.shingles(textscan.scan(pa.array(texts)), minhash.WORDS)
    sets = minhash._sets(pa.array(texts))
    for kinds in (1, 2, 7, 1 << 16):  # whatever the counters say
        often = value % np.uint64(kinds)
        held = minhash.prefixes(owner, value, minhash.weighed(count), often, len(texts), 0.8)
        heads = [set(value[held[owner[held] == i]].tolist()) for i in range(len(texts))]
        assert sum(map(len, heads)) < 0.7 * len(value)
        for i in range(len(texts)):
            for j in range(i):
                if max(minhash.similarities(sets[i], sets[j])) >= 0.8:
                    assert heads[i] & heads[j]


def test_shared_boilerplate_costs_no_comparisons(spark):
    shared = story(77, 300)
    texts = {k: f"{story(5000 + k, 120)} {shared}" for k in range(600)}
    texts |= {10_000 + k: changed(texts[k], 3, k) for k in range(0, 600, 20)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(rows).collect()}
    assert found == {k: k - 10_000 if k >= 10_000 else k for k in texts}
    # all of one bucket, of as many components: none meets another that shares the boilerplate only
    scratch = Scratch(spark, "test")
    mixed = spark.createDataFrame([(0, k, k) for k in texts], "main long, doc_id long, root long")
    meeting = minhash._meeting(mixed, rows, 0.8, scratch).collect()
    assert {r["doc_id"] for r in meeting} == {k for k in texts if k >= 10_000 or k % 20 == 0}
    links = {tuple(r) for r in minhash._across(mixed, rows, 0.8, scratch).collect()}
    assert links == {(k - 10_000, k) for k in texts if k >= 10_000}
    scratch.close()


def test_ids_of_any_kind_in_blocks(spark):
    hot = story(500, 150)
    texts = {f"d{k:03}": changed(hot, k % 9, 7000 + k) for k in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    mixed = spark.createDataFrame([("d000", k, k) for k in texts], "main string, doc_id string, root string")
    scratch = Scratch(spark, "test")
    links = {tuple(r) for r in minhash._across(mixed, rows, 0.8, scratch).collect()}
    names, sets = list(texts), minhash._sets(pa.array(list(texts.values())))
    near = {(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if a < b and max(minhash.similarities(sets[i], sets[j])) >= 0.8}
    assert links and links <= near
    joined = lambda pairs: {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(sorted(pairs), "a string, b string"), scratch).collect()}
    assert joined(links) == joined(near)
    scratch.close()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    found = {r["node"]: r["root"] for r in minhash.components(edges, Scratch(spark, "test")).collect()}
    assert found == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_a_line_repeated_often_hides_no_near_copy(spark):
    texts = {}
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(60)]
        texts[k] = " ".join(words)
        texts[100 + k] = " ".join(words + words[-12:] * 300)
        texts[200 + k] = " ".join(words + words[-12:] * 40)
    expected = brute.near_classes(texts)
    assert all(expected[100 + k] == k for k in range(30))
    sets = minhash._sets(pa.array([texts[0], texts[100]]))
    assert minhash.similarities(*sets)[0] < 0.6
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(rows).collect()} == expected


def test_plain_signatures_stand_for_texts_that_repeat_shingles(spark):
    words = [f"w{i}" for i in range(60)]
    rows = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words + words[:4])), (2, "")], "doc_id long, text string")
    found = {r["doc_id"]: r["buckets"] for r in minhash.signed(rows).collect()}
    assert len(found[0]) == len(found[2]) == minhash.BANDS
    twice = spark.createDataFrame([(1, " ".join(words * 3))], "doc_id long, text string")
    both = minhash.signed(twice).first()["buckets"]
    assert len(both) == 2 * minhash.BANDS and set(both[minhash.BANDS :]) & set(found[0])


def test_hot_groups_are_dealt_out(spark):
    from pyspark.sql import functions as F

    from sparkrank.llm.common import PARTS, dealt

    rows = spark.range(60_000).selectExpr("id AS doc_id", "if(id < 30000, 0, id) AS k")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    found = dealt(rows, groups, ["k"], 60_000, "doc_id")
    assert found.columns == ["k", "doc_id", "low"] and found.count() == 60_000
    assert found.where("low <> if(doc_id < 30000, 0, doc_id)").count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "_part" in plan
    largest = dealt(rows.limit(30_000), groups.where("k = 0"), ["k"], 30_000, "doc_id").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).count().agg(F.max("count")).first()[0]
    assert largest < 100


def test_dealing_out_joins_once(spark):
    """Rows of keys that have no group pass through no join beside the one with the groups, which drops them."""
    from pyspark.sql import functions as F

    from sparkrank.llm.common import dealt

    rows = spark.range(60_000).selectExpr("id AS doc_id", "if(id < 30000, 0, id) AS k")
    groups = spark.createDataFrame([(0, 30_000, 5), (40_000, 1, 6)], "k long, n long, low long")
    found = dealt(rows, groups, ["k"], 30_001, "doc_id")
    assert found.count() == 30_001 and found.groupBy("low").count().orderBy("low").collect() == [(5, 30_000), (6, 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    kept = dealt(rows, groups.drop("low").withColumn("low", F.lit(1)), ["k"], 30_001, "doc_id", "left")
    assert kept.count() == 60_000 and kept.where("low = 1").count() == 30_001
