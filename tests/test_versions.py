"""Published tables and models: what is built again, what a writer that died leaves, broken versions."""

import json
import os

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from sparkrank.operators import model, model_store, panel
from sparkrank.sources.versions import PublishedTable, Versions, fingerprint


@pytest.fixture
def source(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    return lambda: spark.read.parquet(f"{tmp_path}/in")


def kept(spark, tmp_path, **options):
    table, built = PublishedTable(spark, f"{tmp_path}/kept", **options), []

    def read(source):
        def build():
            built.append(1)
            return source().selectExpr("id * 2 AS twice")

        return sorted(r[0] for r in table.read([source()], build).collect())

    return table, read, built


def test_second_read_builds_nothing_and_change_does(spark, tmp_path, source):
    _, read, built = kept(spark, tmp_path)
    assert read(source) == read(source) == [0, 2, 4, 6, 8] and len(built) == 1
    _, other_session, built_there = kept(spark, tmp_path)
    assert other_session(source) == [0, 2, 4, 6, 8] and not built_there
    spark.range(5, 7).write.mode("append").parquet(f"{tmp_path}/in")
    assert read(source) == [0, 2, 4, 6, 8, 10, 12] and len(built) == 2


def test_expiry_and_refresh(spark, tmp_path, source):
    now = [100.0]
    table, read, built = kept(spark, tmp_path, ttl=10, clock=lambda: now[0])
    read(source)
    now[0] = 109.9
    read(source)
    assert len(built) == 1
    now[0] = 110.0
    read(source)
    assert len(built) == 2
    table.refresh()
    read(source)
    assert len(built) == 3
    for _ in range(3):
        now[0] += 20
        read(source)
    names = os.listdir(f"{tmp_path}/kept")
    assert sum(n.startswith("manifest-") for n in names) == sum(n.startswith("data-") for n in names) == 2


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, source):
    table, read, built = kept(spark, tmp_path)
    read(source)

    def dies(path):
        spark.range(3).write.parquet(path)
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        table.versions.publish(dies)
    assert read(source) == [0, 2, 4, 6, 8] and len(built) == 1
    open(f"{tmp_path}/kept/manifest-000000000009.json", "w").write('{"data": ')
    assert read(source) == [0, 2, 4, 6, 8] and len(built) == 1


def test_two_writers_take_two_numbers(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/v", keep=5)
    write = lambda path: spark.range(1).write.parquet(path)
    first = v.publish(write)
    taken = v.folder.write_new("manifest-000000000002.json", json.dumps({"data": "x"}))
    assert taken and not v.folder.write_new("manifest-000000000002.json", "other")
    assert (first["number"], v.publish(write)["number"]) == (1, 3)
    assert [m["number"] for m in v.manifests()] == [3, 2, 1]


def test_fingerprint_is_of_files(spark, tmp_path, source):
    before = fingerprint(source())
    assert before == fingerprint(source()) == fingerprint(source().where("id > 2"), source())
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert fingerprint(source()) != before


@pytest.fixture
def store(spark, tmp_path):
    rows = spark.range(3).selectExpr("double(id) AS a", "double(id) AS b")
    for columns in (["a"], ["a", "b"]):
        fitted = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="f")]).fit(rows)
        model_store.publish(spark, f"{tmp_path}/models", fitted, columns, made_of="x")
    return f"{tmp_path}/models"


def test_newest_model_and_its_features(spark, store):
    found = model_store.load(spark, store)
    assert found and found.number == 2 and found.features == ["a", "b"] and not found.problems
    assert model_store.load(spark, store, ["a"]).problems == ["version 2 has other features"]
    assert model_store.load(spark, store, ["a"]).number == 1


def test_broken_versions_are_told_and_passed_over(spark, store):
    data = json.load(open(f"{store}/manifest-000000000002.json"))["data"]
    os.rename(f"{store}/{data}/metadata", f"{store}/{data}/gone")
    found = model_store.load(spark, store)
    assert found.number == 1 and found.features == ["a"] and len(found.problems) == 1 and "version 2" in found.problems[0]
    none = model_store.load(spark, store, made_of="y")
    assert not none and none.model is None and len(none.problems) == 2
    assert not model_store.load(spark, f"{store}-none")


def test_time_folds(spark):
    weeks = spark.range(3, 20).selectExpr("cast(id AS int) AS gameweek")
    rows = panel.time_folds(weeks, 5).collect()
    for fold in range(1, 6):
        train = [r["gameweek"] for r in rows if r["fold"] == fold and r["train"]]
        test = [r["gameweek"] for r in rows if r["fold"] == fold and not r["train"]]
        assert train == list(range(3, 20 - 2 * (6 - fold))) and test == list(range(20 - 2 * (6 - fold), 20 - 2 * (5 - fold)))
    with pytest.raises(ValueError):
        panel.time_folds(weeks.where("gameweek < 8"), 5)


def test_metrics_of_folds(spark):
    rows = spark.range(40 * 14).selectExpr("id % 40 AS player_id", "cast(id div 40 AS int) AS gameweek", "double(id % 40 + id div 40) AS points", "double(id % 7) AS minutes")
    found = model.fold_metrics(rows, folds=3, trees=5, depth=4).collect()
    assert [(r["fold"], r["first_test"], r["last_test"], r["n_train"], r["n_test"]) for r in sorted(found)] == [(1, 4, 6, 160, 120), (2, 7, 9, 280, 120), (3, 10, 12, 400, 120)]
    assert all(r["rmse"] == pytest.approx(r["mse"] ** 0.5) and r["mse"] < 40 for r in found)
