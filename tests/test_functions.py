"""Formulas with values worked out by hand."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkrank.functions import formatting, rounding, scoring, text
from sparkrank.operators import features, filters, model, search, squad
from sparkrank.operators.constants import DEFAULT_WEIGHTS, PRESETS, STRATEGIES
from sparkrank.plans import domain, queries
from sparkrank.sources import readers


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return frame.select(column).first()[0]


def test_weights_sum_to_one():
    for w in [DEFAULT_WEIGHTS, *PRESETS.values(), *STRATEGIES.values()]:
        assert sum(w.values()) == pytest.approx(1)
    assert scoring.normalised_weights({"form": 0})["form"] == 0


def test_score_and_label(spark):
    values = {"form": 3.0, "xg90": 0.25, "xa90": 0.2, "exp_min": 90.0, "next3_ease": 3.0, "avg_points": 10.0, "value": 1.0, "ownership": 50.0}
    assert one(spark, scoring.score(DEFAULT_WEIGHTS), **values) == 5.9
    for score, status, label in [(8.0, "a", "perfect"), (7.99, "a", "good"), (4.0, "a", "poor"), (3.99, "a", "urgent"), (9.0, "i", "not-playing"), (9.0, "d", "not-playing")]:
        assert one(spark, scoring.label(F.col("s"), F.col("t")), s=score, t=status) == label


@pytest.mark.parametrize("x,digits,expected", [(-2.5, 0, -2.0), (2.5, 0, 3.0), (1.005, 2, 1.0), (-0.125, 2, -0.12)])
def test_half_up(spark, x, digits, expected):
    assert one(spark, rounding.half_up(F.col("x"), digits), x=x) == expected


@pytest.mark.parametrize("s,expected", [("5.2", 5.2), ("5.2x", 5.2), ("x", 0.0), ("", 0.0), (" -1e2 ", -100.0), (".5", 0.5)])
def test_number(spark, s, expected):
    assert one(spark, rounding.number(F.col("s")), s=s) == expected


@pytest.mark.parametrize("x,expected", [(float("nan"), 0.0), (float("inf"), 0.0), (float("-inf"), 0.0), (2.0, 2.0)])
def test_finite(spark, x, expected):
    assert one(spark, rounding.finite(F.col("x")), x=x) == expected


@pytest.mark.parametrize("name,expected", [("Ødegaard", "degaard"), ("  João   Félix ", "joao felix"), ("O'Neil!", "oneil"), ("!! a", " a"), ("Ấn", "an"), ("???", "")])
def test_normalise(spark, name, expected):
    assert one(spark, text.normalise(F.col("s")), s=name) == expected


@pytest.mark.parametrize("query,name,expected", [("ann lee", "ann lee", 100), ("ann", "joanna", 80), ("", "x", 80), ("lee zz", "ann lee", 30), ("anm", "ann", pytest.approx(80 / 3)), ("zzz", "ann", 0)])
def test_similarity(spark, query, name, expected):
    assert one(spark, text.similarity(F.col("q"), F.col("n")), q=query, n=name) == expected


def test_formats(spark):
    assert one(spark, formatting.price(F.col("x")), x=5.0) == "£5m" and one(spark, formatting.price(F.col("x")), x=5.55) == "£5.6m"
    assert one(spark, formatting.delta(F.col("x")), x=-1.25) == "-1.2" and one(spark, formatting.delta(F.col("x")), x=0.0) == "+0"
    assert one(spark, formatting.difficulty(F.col("x")), x=3) == "Medium"


def test_arguments_are_checked(spark):
    for wrong in (lambda: filters.by_id(None, "x"), lambda: filters.by_position(None, "CB"), lambda: filters.by_gameweek(None, 0), lambda: filters.by_team(None, 21), lambda: search.search(None, "")):
        with pytest.raises(ValueError):
            wrong()


def test_validation_lists_all_errors(spark):
    slots = spark.createDataFrame([(1, "xi", 1, 7, "GK", 60.0, 50.0), (1, "xi", 2, 7, "GK", 5.0, 50.0)], "squad_id long, section string, slot_no int, id long, pos string, price double, bank double")
    found = squad.validate(slots).first()
    assert not found["valid"] and len(found["errors"]) == 5
    assert squad.add_slot(slots, 1, "xi", 7, "GK", 5.0).count() == 2 and squad.add_slot(slots, 1, "bench", 8, "MID", 5.0).count() == 3
    assert squad.remove_slot(slots, 1, 7).count() == 0


def test_windows_equal_pandas(spark):
    rows = [(p, g, float((p * 7 + g * g * 3) % 11), float((g * p) % 90)) for p in range(6) for g in range(1, 15) if (p + g) % 4 or p == 0][:-1] + [(99, 3, 5.0, 10.0)]
    pdf = pd.DataFrame(rows, columns=["player_id", "gameweek", "points", "minutes"]).sort_values(["player_id", "gameweek"])
    g = pdf.groupby("player_id")["points"]
    pdf["m"] = g.rolling(5, min_periods=1).mean().reset_index(0, drop=True)
    pdf["s"] = g.rolling(5, min_periods=2).std().reset_index(0, drop=True).fillna(0)

    def slope(y):
        x = range(len(y))
        mx, my = sum(x) / len(y), y.mean()
        return sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)

    pdf["t"] = g.rolling(3, min_periods=2).apply(slope).reset_index(0, drop=True).fillna(0)
    found = features.time_features(spark.createDataFrame(rows, "player_id long, gameweek int, points double, minutes double")).toPandas().sort_values(["player_id", "gameweek"])
    for ours, theirs in (("points_avg_5", "m"), ("points_std_5", "s"), ("points_trend", "t")):
        assert found[ours].to_numpy() == pytest.approx(pdf[theirs].to_numpy())


def test_fixture_ease_and_panel_take_source_order(spark):
    from sparkrank.operators import enrich, panel

    fixtures = spark.createDataFrame([(0, 5, 1, 2, 4, 2), (1, 9, 3, 1, 1, 5), (2, 5, 1, 3, 1, 1), (3, 6, 1, 2, 5, 5)], "ord long, event int, team_h int, team_a int, team_h_difficulty int, team_a_difficulty int")
    ease = {r["team"]: r["next3_ease"] for r in enrich.next3_ease(fixtures, 5).collect()}
    assert ease[1] == (4 + 5 + 1) / 3 and ease[2] == (2 + 5) / 2
    live = spark.createDataFrame([(7, 5, 2.0), (7, 8, 1.0), (8, 5, 1.0)], "player_id long, gameweek int, points double")
    static = spark.createDataFrame([(7, "x", 1)], "player_id long, name string, team int")
    rows = {r["gameweek"]: r for r in panel.panel(live, static, fixtures).collect()}
    assert len(rows) == 2 and rows[5]["fixture_difficulty"] == 1 and rows[8]["fixture_difficulty"] == 3 and rows[8]["is_home"]


def test_fixtures_and_live_documents(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"id": 3, "team_h": 1, "team_a": 2, "team_h_difficulty": 2, "team_a_difficulty": 4, "event": null}, {"id": 1, "team_h": 2, "team_a": 1}]')
    found = readers.fixtures(spark, str(tmp_path / "f.json")).orderBy("ord").collect()
    assert [(r["ord"], r["id"], r["event"]) for r in found] == [(0, 3, None), (1, 1, None)]
    for week in (1, 2):
        (tmp_path / f"live/gameweek={week}").mkdir(parents=True)
        (tmp_path / f"live/gameweek={week}/a.json").write_text('{"elements": [{"id": 9, "stats": {"total_points": %d, "minutes": 90}}]}' % week)
    rows = readers.live(spark, str(tmp_path / "live")).where("gameweek = 2").collect()
    assert [(r["player_id"], r["points"], r["minutes"]) for r in rows] == [(9, 2.0, 90.0)]


def test_current_gameweek_defaults(spark):
    schema = "id int, is_current boolean, ord long"
    week = lambda rows: readers.current_gameweek(spark.createDataFrame(rows, schema)).first()[0]
    assert week([(3, False, 0), (5, True, 1), (4, True, 2)]) == 5 and week([(3, False, 0), (7, None, 1)]) == 7 and week([]) == 1


def test_squad_json_problems(spark):
    rows = spark.createDataFrame([(1, '{"startingXI": [], "bench": [], "bank": 1.5}'), (2, "{"), (3, '{"bench": []}')], "squad_id long, json string")
    assert {r["squad_id"]: r["problem"] is None for r in readers.parse_squads(rows).collect()} == {1: True, 2: False, 3: False}


def test_model_round_trip(spark, sf_dir, tmp_path):
    panel = domain.panel(spark, sf_dir)
    fitted, tested = model.train(panel, trees=5, depth=4)
    model.save(fitted, str(tmp_path / "m"))
    again = model.load(str(tmp_path / "m"))
    key = lambda df: sorted((r["player_id"], r["predicted_points"]) for r in df.collect())
    assert key(model.predict(fitted, panel, 20)) == key(model.predict(again, panel, 20))
    assert model.metrics(tested).first()["rmse"] > 0


def test_requests_are_checked():
    from sparkrank.operators import requests

    slot = {"id": 1, "pos": "GK", "price": 5.0}
    good = {"startingXI": [slot] * 11, "bench": [slot] * 4, "bank": 0}
    assert requests.squad(good) == good and requests.weights({"form": 1})["value"] == 0
    requests.suggestion("MID", 15, 10)
    requests.generation("ai", 80)
    wrong = [lambda: requests.squad(good | {"bank": 101}), lambda: requests.squad(good | {"bench": []}), lambda: requests.squad(good | {"bench": [slot | {"price": 0}] * 4}), lambda: requests.squad(good | {"bench": [slot | {"pos": "X"}] * 4})]
    wrong += [lambda: requests.weights({"form": 1.1}), lambda: requests.weights({"x": 0}), lambda: requests.suggestion("X", 5), lambda: requests.suggestion("GK", 16), lambda: requests.suggestion("GK", 5, 11), lambda: requests.generation("x"), lambda: requests.generation("form", 79)]
    for call in wrong:
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("name", ["rf_predict", "rf_metrics", "rf_importance"])
def test_registered_forests_have_the_full_size(spark, sf_dir, monkeypatch, name, tmp_path):
    asked, own = [], model.pipeline
    monkeypatch.setattr(model, "pipeline", lambda columns, trees, depth: asked.append((trees, depth)) or own(columns, 2, 2))
    monkeypatch.setattr(queries, "_shared", lambda spark: str(tmp_path))  # a store of its own
    queries.QUERIES[name](spark, sf_dir)
    queries.QUERIES[name](spark, sf_dir)  # trained once
    assert asked == [(200, 10)]


def test_entry_without_a_library_keeps_the_other_queries():
    import os
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None\nimport __spark_entry__ as e\nfrom sparkrank.plans import queries as q\nassert set(e.queries()) == set(q.QUERIES) and set(e.oracle_sql()) == set(q.SQL)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_ids_are_read_as_far_as_they_are_numbers(spark):
    rows = spark.createDataFrame([(12,), (3,)], "id long")
    assert [r.id for r in filters.by_id(rows, " 12abc").collect()] == [12]
    assert [filters.whole_number(x) for x in ("7", "-7.9", "+3x", "", "x1", None)] == [7, -7, 3, None, None, None]


def test_an_empty_gameweek_is_an_error(spark, sf_dir):
    with pytest.raises(ValueError):
        model.predict(None, domain.panel(spark, sf_dir), 999)


def test_adding_removing_and_moving(spark):
    def squad_of(n_xi, n_bench):
        rows = [(1, "xi", k + 1, 100 + k, "MID", 5.0, 1.0) for k in range(n_xi)] + [(1, "bench", k + 1, 200 + k, "GK", 5.0, 1.0) for k in range(n_bench)]
        return spark.createDataFrame(rows, "squad_id long, section string, slot_no int, id long, pos string, price double, bank double")

    ids = lambda df, section: [r.id for r in df.where(f"section = '{section}'").orderBy("slot_no").collect()]
    slots = squad_of(10, 3)
    assert ids(squad.add_slot(slots, 1, "xi", 7, "FWD", 6.0), "xi")[-1] == 7
    assert squad.add_slot(slots, 1, "bench", 100, "MID", 5.0).count() == 13  # in already
    assert squad.add_slot(squad_of(11, 4), 1, "xi", 7, "FWD", 6.0).count() == 15  # full
    assert ids(squad.remove_slot(slots, 1, 201), "bench") == [200, 202]
    move = lambda id_, start: spark.createDataFrame([(1, id_, start)], "squad_id long, id long, from_starting boolean")
    moved = squad.move_slots(slots, move(104, True))
    assert 104 not in ids(moved, "xi") and ids(moved, "bench") == [200, 201, 202, 104]
    assert ids(squad.move_slots(slots, move(200, False)), "xi")[0] == 200  # goalkeepers first
    assert ids(squad.move_slots(squad_of(11, 4), move(104, True)), "bench") == [200, 201, 202, 203]
    assert ids(squad.move_slots(slots, move(104, False)), "bench") == [200, 201, 202]


def test_panels_are_saved_under_names_that_sort_by_time(spark, tmp_path):
    from datetime import datetime

    path = readers.save_panel(spark.range(3), str(tmp_path), when=datetime(2024, 1, 31, 12, 5))
    assert path.endswith("panel_20240131_120500.csv") and spark.read.option("header", True).csv(path).count() == 3


def test_report_files_keep_the_order(spark, tmp_path):
    rows = [("position 2", 1, "c"), ("all", 2, "b"), ("all", 1, "a"), ("position 2", 2, "d")]
    readers.save_report(spark.createDataFrame(rows, "section string, rank int, line string").repartition(4), f"{tmp_path}/r")
    (file,) = [f for f in (tmp_path / "r").iterdir() if f.name.startswith("part-")]
    assert file.read_text() == "a\nb\nc\nd\n"


def test_no_snapshot_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.latest_snapshot(spark, str(tmp_path), "teams_")
