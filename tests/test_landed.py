"""Landed documents and the gameweek source: pages, odd documents, which files are opened, tries."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, Not, StringContains

from sparkrank.sources import gameweeks, landed


def write(folder, name, *documents):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join((d if isinstance(d, str) else json.dumps(d)) + "\n" for d in documents))


def test_pages_keep_rows_and_order(spark, tmp_path):
    rows = spark.range(95).selectExpr("id", "concat('n', id) AS first_name", "cast(id % 7 AS int) AS team", "cast(NULL AS string) AS status")
    landed.write_pages(rows, f"{tmp_path}/p", "elements", F.expr("id div 10"), total=F.count("*"))
    documents = landed.documents(spark, f"{tmp_path}/p")
    assert documents.count() == 10
    assert max(r[0] for r in documents.select(F.variant_get("doc", "$.total", "int")).collect()) == 10
    found = landed.players(documents).orderBy("ord").select("id", "first_name", "team", "status", "form").collect()
    assert [tuple(r) for r in found] == [(i, f"n{i}", i % 7, None, None) for i in range(95)]


def test_odd_documents(spark, tmp_path):
    write(tmp_path / "d", "a.json", {"page": 1, "elements": [{"id": 1, "form": "3.5", "team": "x"}, {"id": "2", "now_cost": 55.0}, None, 5]}, "no json", {"elements": {"id": 9}}, {"teams": []}, {"elements": None}, [])
    found = landed.players(landed.documents(spark, f"{tmp_path}/d")).select("id", "form", "team", "now_cost").orderBy("ord").collect()
    assert [tuple(r) for r in found] == [(1, "3.5", None, None), (2, None, None, 55), (None, None, None, None), (None, None, None, None)]
    write(tmp_path / "w", "a.json", '[{"id": 4, "team_h": 1,\n "event": null},\n {"id": 3}]')
    whole = landed.documents(spark, f"{tmp_path}/w", whole_files=True)
    assert [tuple(r) for r in landed.rows_of(whole, "$", "id long, team_h int, event int").orderBy("ord").collect()] == [(0, 4, 1, None), (1, 3, None, None)]


def test_current_event_is_the_first_pages(spark, tmp_path):
    write(tmp_path / "e", "a.json", {"page": 2, "current_event": 7}, {"page": 1, "current_event": 9}, {"page": 0})
    assert landed.current_event(landed.documents(spark, f"{tmp_path}/e")).first()[0] == 9
    write(tmp_path / "n", "a.json", {"page": 2})
    assert landed.current_event(landed.documents(spark, f"{tmp_path}/n")).first()[0] == 1


@pytest.fixture
def weeks(tmp_path):
    for week in range(1, 7):
        for part in range(2):
            elements = [{"id": 10 * part + k, "stats": {"total_points": week * k, "minutes": 90, "influence": "1.5"}} for k in range(3)]
            write(tmp_path / f"live/gameweek={week}", f"part-{part}.txt", {"page": part, "elements": elements[:2]}, {"elements": elements[2:]})
    write(tmp_path / "live/gameweek=1", "_SUCCESS")
    return f"file://{tmp_path}/live"


def test_all_columns_of_all_weeks(spark, weeks):
    found = gameweeks.read_weeks(spark, weeks)
    assert len(found.columns) == 25 and found.count() == 36
    row = found.where("gameweek = 3 AND player_id = 12").first()
    assert (row["points"], row["minutes"], row["influence"], row["saves"]) == (6.0, 90.0, 1.5, None)


def test_a_filter_opens_its_weeks_only(spark, weeks, tmp_path):
    for week in (1, 2, 5, 6):  # whoever opens them fails
        write(tmp_path / f"live/gameweek={week}", "part-0.txt", "broken")
    found = gameweeks.read_weeks(spark, weeks, "gameweek BETWEEN 3 AND 4 AND gameweek IS NOT NULL", tries="1")
    assert found.count() == 12 and found.rdd.getNumPartitions() == 4  # a partition for each file
    assert gameweeks.read_weeks(spark, weeks, F.col("gameweek").isin(3, 99), tries="1").where("points > 3").count() == 2
    assert gameweeks.read_weeks(spark, weeks, "gameweek > 98").count() == 0


def test_later_filters_of_one_frame_dont_mix(spark, weeks):
    rows = gameweeks.read_weeks(spark, weeks, "gameweek >= 2")
    both = rows.where("gameweek = 2").unionByName(rows.where("gameweek IN (4, 5)"))
    assert {tuple(r) for r in both.groupBy("gameweek").count().collect()} == {(2, 6), (4, 6), (5, 6)}


def test_filters_taken_and_given_back():
    reader = gameweeks.GameweekReader({"path": "/x"})
    week = ("gameweek",)
    other = [EqualTo(("points",), 3), StringContains(week, "1"), EqualTo(week, None), Not(EqualTo(("points",), 1))]
    assert list(reader.pushFilters([IsNotNull(week), GreaterThan(week, 2), Not(In(week, (5,))), LessThanOrEqual(week, 6), *other])) == other
    assert [w for w in range(10) if all(t(w) for t in reader.tests)] == [3, 4, 6]


def test_a_failed_try_is_repeated(weeks, monkeypatch):
    reader = gameweeks.GameweekReader({"path": weeks, "wait": "0.01"})
    part, real, calls = reader.partitions()[0], reader.content, []

    def flaky(path):
        calls.append(path)
        if len(calls) < 3:
            raise OSError("not now")
        return real(path)

    pauses = []
    monkeypatch.setattr(gameweeks.time, "sleep", pauses.append)
    reader.content = flaky
    assert sum(b.num_rows for b in reader.read(part)) == 3 and len(calls) == 3 and pauses == [0.01, 0.02]
    calls.clear()
    reader.tries = 2
    with pytest.raises(OSError, match="not now"):
        list(reader.read(part))
    calls.clear()
    reader.skip = True
    assert list(reader.read(part)) == []


def test_pages_are_compressed(spark, tmp_path):
    rows = spark.range(3_000).selectExpr("id", "named_struct('goals_scored', id % 3, 'expected_goals', id / 7.0D) AS stats")
    landed.write_pages(rows, str(tmp_path / "pages"), "elements", F.expr("id div 500"))
    files = [f for f in (tmp_path / "pages").iterdir() if f.name.startswith("part-")]
    raw = landed.documents(spark, str(tmp_path / "pages")).selectExpr("sum(length(to_json(doc))) AS n").first()["n"]
    assert files and sum(f.stat().st_size for f in files) < raw / 3
