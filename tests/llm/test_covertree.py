import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrank.llm import covertree


def test_tree_covers():
    points = np.floor(np.random.default_rng(1).normal(size=(700, 8)) * 50)
    points[100:300] = points[0]
    tree = covertree.CoverTree(points, 16)
    assert sorted(tree.order) == list(range(700))
    for node, (a, b) in enumerate(tree.rows):
        rows = tree.order[a:b]
        far = np.sqrt(((points[rows] - points[tree.centre[node]]) ** 2).sum(1))
        assert far.max() <= tree.radius[node] + 1e-9
        if tree.children[node]:
            assert [tree.rows[c] for c in tree.children[node]][0][0] == a and tree.rows[tree.children[node][-1]][1] == b


def share_scored(points, n_queries, k=6):
    """Which share of all pairs is scored, each row with one id of its own, and whether the results are right."""
    ids = np.full((len(points), k), covertree.NONE)
    ids[:, 0] = np.arange(len(points))
    search = covertree.Search(points[:n_queries], k)
    search.meet(covertree.CoverTree(points), ids)
    exact = points[:n_queries] @ points.T
    best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    assert np.array_equal(search.ids, best)
    return search.met / exact.size


def test_clustered_rows_are_pruned():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 64))
    centres *= 256 / np.linalg.norm(centres, axis=1)[:, None]
    points = np.floor(np.repeat(centres, 100, 0) + rng.normal(size=(4000, 64)) * 4)
    points = points[rng.permutation(4000)]
    assert share_scored(points, 200) < 0.2


def test_rows_of_few_dimensions_are_pruned():
    rng = np.random.default_rng(5)
    assert share_scored(np.floor(rng.normal(size=(4000, 3)) * 256), 200) < 0.5


def test_rows_without_structure_are_all_scored_and_right():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(1500, 64))
    points = np.floor(points * 256 / np.linalg.norm(points, axis=1)[:, None])
    assert share_scored(points, 100) <= 1


def test_limits_hold():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = (rng.normal(size=4) * 10 + rng.normal(size=(20, 4)) * rng.uniform(0, 8) for _ in range(2))
        trees = [covertree.CoverTree(np.floor(x * 8), 64) for x in (a, b)]
        p, q = trees
        bound = covertree.limits((p.points[p.middles[:1]] * q.points[q.middles[:1]]).sum(1), p.norm[:1], q.norm[:1], p.radii[:1], q.radii[:1], p.angle[:1] + q.angle[:1], p.largest[:1] * q.largest[:1])
        best = (p.points @ q.points.T).max()
        assert bound[0] + 1e-3 >= best or best < 0


@pytest.mark.parametrize("seed,dims,spread", [(1, 3, 1.0), (2, 16, 0.2), (3, 2, 0.01)])
def test_by_brute_force(spark, seed, dims, spread):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(900, dims)) * spread
    x[200:500] = x[7]  # a very common vector
    x[500:600] = x[rng.integers(0, 50, 100)]
    rows = spark.createDataFrame([(i, [float(v) for v in np.float32(x[i])]) for i in range(900)], "vec_id long, embedding array<float>")
    found = covertree.top_k(rows, F.col("vec_id") % 20 == 0, 5, pivots=8, block=64, group=16)
    vectors = {i: [int(np.floor(256 * float(np.float32(v)))) for v in x[i]] for i in range(900)}
    assert sorted(map(tuple, found.collect())) == sorted(brute.top_k(vectors, range(0, 900, 20)))
