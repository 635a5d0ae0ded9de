import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkrank.llm import bradley_terry, quality_rules, queries, textscan

TEXT = st.lists(st.sampled_from(["a", "b", "cc", " ", "\n", "\t", "\x0b", "é", "\xa0", "#", "&", "😀"]), max_size=60).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, min_size=1, max_size=5))
def test_statistics_by_brute_force(texts):
    found = textscan.statistics(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        expected = brute.statistics(text)
        assert {n: int(found[n][k]) for n in expected} == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_shingles_and_content_by_brute_force(texts):
    s = textscan.scan(pa.array(texts))
    owner, _, count = textscan.shingles(s)
    first, second = textscan.content(s)
    for k, text in enumerate(texts):
        assert (owner == k).sum() == len(brute.shingles(text))
        for j in range(k):
            assert ((first[k], second[k]) == (first[j], second[j])) == (brute.WORD.findall(text) == brute.WORD.findall(texts[j]))


def test_whole_table_by_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op4_quality_rules(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        expected = brute.statistics(texts[r["doc_id"]])
        assert {k: r[k] for k in expected} == expected


def labelled(spark, folder):
    return {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}


def test_forest_keeps_good_and_drops_bad(spark):
    folder = "/root/testdata/sf0.01"
    labels = labelled(spark, folder)
    found = {r["doc_id"]: r for r in queries.op4_quality_rules(spark, folder).collect()}
    passed = {k: q for k, q in labels.items() if not found[k]["base_failed"]}
    assert np.mean([found[k]["kept"] for k, q in passed.items() if q == 1]) >= 0.98
    assert np.mean([not found[k]["kept"] for k, q in passed.items() if q == 0]) >= 0.9


def test_forest_isolates_the_far_row():
    x = np.random.default_rng(1).normal(size=(500, 3))
    forest = quality_rules.Forest.fit(x, (x.min(0) - 9, x.max(0) + 9))
    assert forest.anomaly(np.array([[8.0, 8.0, 8.0]]))[0] > np.quantile(forest.anomaly(x), 0.99)
    assert np.allclose(quality_rules.usual_path([0, 1, 2]), [0, 0, 1])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = labelled(spark, folder)
    found = [r for r in queries.op5_quality_classifier(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(found) > 500
    good = [r["predicted"] for r in found if labels[r["doc_id"]] == 1]
    bad = [r["predicted"] for r in found if labels[r["doc_id"]] == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.03


def test_held_out_fold_is_crc32(spark):
    import zlib

    rows = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", bradley_terry.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_one_kind_of_label_rejects_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert {r["score"] for r in bradley_terry.quality_scores(docs, labels).collect()} == {0.5}
    assert bradley_terry.keep_good(docs, labels).count() == 20


def path_length(forest, tree, row):
    """A row's path in one tree by walking its nodes one by one."""
    at = 0
    while forest.column[tree, at] >= 0:
        at = forest.left[tree, at] + (row[forest.column[tree, at]] >= forest.value[tree, at])
    return forest.path[tree, at]


def test_anomaly_by_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    forest = quality_rules.Forest.fit(x, (x.min(0) - 1, x.max(0) + 1), trees=20, sample=64)
    rows = np.concatenate([x[:40], rng.normal(size=(10, 4)) * 5])
    expected = [2 ** (-np.mean([path_length(forest, t, row) for t in range(20)]) / (2 * (np.log(63) + np.euler_gamma) - 2 * 63 / 64)) for row in rows]
    assert np.allclose(forest.anomaly(rows), expected)


def test_paths_follow_the_sample():
    """Every leaf's path is its depth and what an unsplit rest of its sampled rows would add."""
    x = np.arange(16.0)[:, None]
    forest = quality_rules.Forest.fit(x, (x.min(0), x.max(0)), trees=5, sample=16)
    for t in range(5):
        depth, held = {0: 0}, {0: list(range(16))}
        for node in range(forest.column.shape[1]):
            if node not in depth:
                continue
            if forest.column[t, node] < 0:
                assert np.isclose(forest.path[t, node], depth[node] + quality_rules.usual_path(len(held[node])))
                continue
            left = forest.left[t, node]
            depth[left] = depth[left + 1] = depth[node] + 1
            held[left] = [i for i in held[node] if x[i, 0] < forest.value[t, node]]
            held[left + 1] = [i for i in held[node] if x[i, 0] >= forest.value[t, node]]


def test_kept_follows_anomaly_and_cut(spark, sf_dir):
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    forest = quality_rules.fit_forest(table("documents"), table("labels"))
    texts = {r["doc_id"]: r["text"] for r in table("documents").collect()}
    for r in queries.op4_quality_rules(spark, sf_dir).collect():
        row = quality_rules.forest_columns(textscan.statistics(pa.array([texts[r["doc_id"]]])))
        assert np.isclose(r["anomaly"], 2 ** (-np.mean([path_length(forest, t, row[0]) for t in range(len(forest.column))]) / quality_rules.usual_path(forest.sample)))
        assert r["kept"] == (not r["base_failed"] and r["anomaly"] <= forest.cut)


def test_strengths_minimise_the_pairwise_loss():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=(400, 3)), np.zeros((400, 2 * bradley_terry.BUCKETS))])
    good = x[:, 0] + rng.normal(size=400) > 0
    ranker = bradley_terry.Ranker.fit(x, good, pairs=4000)
    z = (ranker.bent(x, ranker.knots) - ranker.centre) / ranker.spread
    pick = np.random.default_rng(11)
    d = z[pick.choice(np.flatnonzero(good), 4000)] - z[pick.choice(np.flatnonzero(~good), 4000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 1e-3 / 2 * w @ w
    least = loss(ranker.weights)
    for step in rng.normal(size=(50, len(ranker.weights))) * 0.05:
        assert loss(ranker.weights + step) > least
    strength = z @ ranker.weights
    assert np.array_equal(np.argsort(ranker.score(x), kind="stable"), np.argsort(strength, kind="stable"))
    assert np.isclose((ranker.score(x) < 0.3).mean(), (~good).mean(), atol=0.01)


def test_a_cipher_is_told_from_language(spark):
    """Letters put in place of others leave every rate as it is, but not the grams."""
    import random
    import string

    folder = "/root/testdata/sf0.01"
    docs = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").where("length(text) > 200").limit(200).collect()]
    letters = list(string.ascii_lowercase)
    random.Random(1).shuffle(letters)
    cipher = str.maketrans(string.ascii_lowercase + string.ascii_uppercase, "".join(letters) + "".join(letters).upper())
    plain, hidden = (bradley_terry.features(pa.array(t)) for t in (docs, [d.translate(cipher) for d in docs]))
    rules = plain.shape[1] - 2 * bradley_terry.BUCKETS
    assert np.allclose(plain[:, :rules], hidden[:, :rules])
    assert (np.abs(plain[:, rules:] - hidden[:, rules:]).sum(1) > 1).all()
    x = np.concatenate([plain, hidden])
    ranker = bradley_terry.Ranker.fit(x, np.arange(len(x)) < len(docs))
    assert ranker.score(plain).mean() > 0.9 > 0.1 > ranker.score(hidden).mean()


@pytest.mark.parametrize("size", [1, 3, 1 << 18])
def test_grams_by_brute_force(monkeypatch, size):
    monkeypatch.setattr(textscan, "_SLICE", size)
    texts = ["", "ab", "Abcab abc", "é x", None, "z", "", "abcd"]
    found = textscan.grams(pa.array(texts), 8).reshape(len(texts), 2, 8)
    for k, text in enumerate(texts):
        raw = (text or "").lower().encode()
        expected = np.zeros(8)
        for i in range(len(raw) - 2):
            expected[(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16) % 8] += 1
        assert np.allclose(found[k, 0], expected / max(expected.sum(), 1))
        assert np.isclose(found[k, 1].sum(), 1 if brute.WORD.search(text or "") else 0)


def test_repeated_ids_are_collected_once(spark):
    docs = spark.range(100_000).selectExpr("7L AS doc_id", "concat('a text of number ', id % 3) AS text").unionAll(spark.createDataFrame([(8, "x!! " * 30)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1)] * 500 + [(7, 0)] * 500 + [(8, 0)], "doc_id long, quality int")
    found = quality_rules.labelled_statistics(docs, labels)
    assert found[["doc_id", "quality", "n_words"]].values.tolist() == [[7, 1, 5], [8, 0, 30]]
    assert quality_rules.quality_rules(docs, labels).count() == 100_001


def test_a_very_long_text_takes_a_bounded_multiple_of_memory():
    import subprocess
    import sys

    code = (
        "import resource, pyarrow as pa\n"
        "from sparkrank.llm import textscan\n"
        "text = ''.join(f'word{i} foo bar {i % 97}\\n' for i in range(400_000))\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "textscan.statistics(pa.array([text]))\n"
        "textscan.grams(pa.array([text]), 64)\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / len(text))\n"
    )
    assert float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 40


def test_every_labelled_row_sets_the_cut(spark):
    """The cut and the ranges are those of all labelled rows, more than 20,000 of them too."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3 = 0, array_join(transform(sequence(1, 12 + id % 7), i -> concat('w', i * id, repeat('!#', cast(id % 4 as int)))), ' '), concat('one two three four five six seven eight nine ten ', repeat('!', id % 11), ' ', id)) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 > 0 AS int) AS quality")
    forest = quality_rules.fit_forest(docs, labels, trees=20)
    rows = quality_rules.labelled_statistics(docs, labels)
    assert len(rows) == 30_000
    rows = rows[~quality_rules.base_failed(rows["n_words"].to_numpy(), rows["n_repeat_words"].to_numpy())]
    good = rows["quality"].to_numpy() == 1
    anomaly = forest.anomaly(quality_rules.forest_columns({k: rows[k].to_numpy() for k in quality_rules.STATISTICS}))
    assert (anomaly[good] <= forest.cut).mean() >= 0.995
    step = np.ceil(anomaly * quality_rules.STEPS) / quality_rules.STEPS
    value = lambda cut: (step[good] <= cut).mean() - (step[~good] <= cut).mean()
    assert (~good).sum() > 5_000
    assert value(forest.cut) >= max(value(c) for c in np.unique(step) if (step[good] <= c).mean() >= 0.995) - 1e-12
