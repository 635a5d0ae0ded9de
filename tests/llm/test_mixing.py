import random

import pytest

from sparkrank.llm import mixing, queries


def test_quotas_fill_up():
    assert mixing.quotas([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.quotas([10, 1000], [5, 2]) == [30, 980]
    assert mixing.quotas([0, 10], [5, 2]) == [0, 10] and mixing.quotas([], []) == []
    for seed in range(50):
        r = random.Random(seed)
        sizes = [r.randrange(0, 1000) for _ in range(r.randrange(1, 12))]
        weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
        found = mixing.quotas(sizes, weights)
        assert sum(found) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(found, sizes))


def least_cost(patterns, sizes, targets, most):
    """Greedy by exhaustive augmenting of single units: the optimum of a small instance."""
    best = None
    units = [(cost, p) for p, s in enumerate(sizes) for cost in range(most) for _ in range(s)]
    units.sort()
    match = {}

    def place(u, seen):
        for s in patterns[units[u][1]]:
            for slot in range(targets[s]):
                if (s, slot) not in seen:
                    seen.add((s, slot))
                    if (s, slot) not in match or place(match[s, slot], seen):
                        match[s, slot] = u
                        return True
        return False

    total = sum(units[u][0] for u in range(len(units)) if place(u, set()))
    return len(match), total if best is None else best


def test_flow_is_cheapest_and_largest():
    for seed in range(40):
        r = random.Random(seed)
        n = r.randrange(1, 4)
        patterns = [sorted(r.sample(range(n), r.randrange(1, n + 1))) for _ in range(r.randrange(1, 4))]
        sizes, targets = [r.randrange(0, 4) for _ in patterns], [r.randrange(0, 6) for _ in range(n)]
        flow = mixing.route(patterns, sizes, targets, 3)
        taken = [sum(f.values()) for f in flow]
        for s in range(n):
            assert sum(f.get(s, 0) for f in flow) <= targets[s]
        assert all(t <= 3 * s for t, s in zip(taken, sizes))
        cost = sum(sum(k for k in range(3) for u in range(s) if k * s + u < t) for t, s in zip(taken, sizes))
        assert (sum(taken), cost) == least_cost(patterns, sizes, targets, 3)


def test_overlapping_sources(spark):
    rows = [(i, 10, ["a"] if i < 50 else ["a", "b"] if i < 80 else ["b"]) for i in range(100)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, size long, memberships array<string>"), weights=(1.0, 1.0)).collect()
    assert abs(sum(r["passes"] * r["size"] for r in found) - 1000) <= 30
    assert {r["passes"] for r in found if r["memberships"] == ["a"]} <= {0, 1}


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    folder = "/root/testdata/sf0.1"
    found = queries.op8_source_mixing(spark, folder).toPandas()
    assert (found.taken <= 3 * found["size"]).all()
    sources = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").toPandas()
    by = found.merge(sources, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.largest / 2 + 1).all()
    again = queries.op8_source_mixing(spark, folder).toPandas()
    assert found.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_kept_rows_are_repeated(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 4 else "b", 20) for i in range(40)], "doc_id long, text string, source string, n_chars long")
    counts = mixing.keep_taken(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert (counts[counts.index < 4] == 3).all()


def test_texts_without_words_are_never_taken(spark):
    texts = ["w " * 10, None, "", " \n"]
    docs = spark.createDataFrame([(i, texts[i % 4], "a" if i < 8 else None if i < 12 else "b", 20) for i in range(80)], "doc_id long, text string, source string, n_chars long")
    kept = mixing.keep_taken(docs).collect()
    assert {r["text"] for r in kept} == {texts[0]} and {r["source"] for r in kept} == {"a", None, "b"}
    assert mixing.keep_taken(docs.where("text IS NULL")).count() == 0


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 3)
    rows = spark.range(8).selectExpr("id AS doc_id", "5L AS size", "array(cast(id % 4 AS string)) AS memberships")
    with pytest.raises(ValueError):
        mixing.mix(rows)
