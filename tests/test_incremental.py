"""The incremental panel: increments equal one build, folders of old weeks stay, runs can be repeated."""

import os
import random

import pytest

from sparkrank.operators import incremental
from sparkrank.operators.features import time_features


@pytest.fixture
def rows(spark):
    r = random.Random(4)
    made = [(p, w, float(r.randint(0, 12)), float(r.randint(0, 90)), float(r.randint(0, 3)), 0.0, r.random(), r.random(), r.random(), 4.0 + w / 10, r.random()) for p in range(8) for w in range(1, 31) if p or w % 3]
    made = [m for m in made if not (m[0] == 3 and 5 < m[1] < 25)]  # one who was away for long
    names = "player_id long, gameweek int, points double, minutes double, goals_scored double, assists double, ict_index double, expected_goals double, expected_assists double, price double, selected_by_percent double"
    return spark.createDataFrame(made, names)


def collected(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect())


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


def test_increments_equal_one_build(spark, rows, tmp_path):
    path, old = str(tmp_path / "panel"), {}
    for low, high in ((1, 10), (11, 11), (12, 24), (25, 30)):
        assert incremental.add_weeks(rows.where(f"gameweek BETWEEN {low} AND {high}"), path) == (low, high)
        now = {f: t for f, t in files(f"{path}/features").items() if "gameweek=" in f}
        assert {f: now.get(f) for f in old} == old  # nothing older was written again
        old = now
    assert collected(incremental.read_features(spark, path)) == collected(time_features(rows))
    assert collected(incremental.read_features(spark, path, 12, 13)) == collected(time_features(rows).where("gameweek IN (12, 13)"))
    assert incremental.add_weeks(rows.where("gameweek > 99"), path) is None


def test_repeated_and_corrected_weeks(spark, rows, tmp_path):
    path = str(tmp_path / "panel")
    incremental.add_weeks(rows.where("gameweek <= 10"), path)
    wrong = rows.where("gameweek BETWEEN 11 AND 20").withColumn("points", rows.points + 100)
    incremental.add_weeks(wrong, path)
    incremental.add_weeks(rows.where("gameweek BETWEEN 11 AND 20"), path)
    incremental.add_weeks(rows.where("gameweek > 20"), path)
    assert collected(incremental.read_features(spark, path)) == collected(time_features(rows))
    with pytest.raises(ValueError, match="later|need"):
        incremental.add_weeks(wrong, path)
    with pytest.raises(ValueError, match="no tail"):
        incremental.add_weeks(rows.where("gameweek BETWEEN 15 AND 30"), path)


def test_tails_hold_nine_rows_and_old_ones_go(spark, rows, tmp_path):
    path = str(tmp_path / "panel")
    for week in range(1, 13):
        incremental.add_weeks(rows.where(f"gameweek = {week}"), path)
    assert len(incremental._numbers(spark, f"{path}/tail", "upto=")) == incremental.KEPT_TAILS
    tail = spark.read.parquet(f"{path}/tail/upto=12").groupBy("player_id").count().collect()
    assert max(r["count"] for r in tail) == 9
    assert collected(incremental.read_features(spark, path)) == collected(time_features(rows.where("gameweek <= 12")))


def test_the_panel_is_made_once_for_its_weeks_and_once_for_its_rows(spark, rows, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    path, part = str(tmp_path / "panel"), rows.where("gameweek <= 10")
    incremental.add_weeks(part.mapInArrow(counted, rows.schema), path)
    assert made.value == 2 * part.count()
    last = {}
    for r in sorted(part.collect(), key=lambda r: (r["player_id"], -r["gameweek"])):
        last.setdefault(r["player_id"], []).append(r)
    expected = spark.createDataFrame([r for of in last.values() for r in of[:9]], rows.schema)
    assert collected(spark.read.schema(rows.schema).parquet(f"{path}/tail/upto=10")) == collected(expected)


def test_features_of_the_panel_shuffle_lineitem_once(spark, sf_dir):
    from sparkrank.plans import domain

    plan = time_features(domain.panel(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.split("\n") if "Exchange hashpartitioning(l_partkey" in line or "Exchange hashpartitioning(player_id" in line]) == 1
    assert "SortAggregate" not in plan


def test_partitions_by_player_follow_the_rows(spark, sf_dir, monkeypatch):
    from sparkrank.plans import domain

    monkeypatch.setattr(domain, "LINES", 1000)
    n = domain.table(spark, sf_dir, "lineitem").count()
    assert domain.live(spark, sf_dir).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-n // 1000)) > 4
