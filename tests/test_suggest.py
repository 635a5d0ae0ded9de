"""Slot suggestions by the index against every pair of a slot and a candidate."""

import random

import pytest

from sparkrank.operators import suggest
from sparkrank.functions import scoring


def players_of(spark, rows):
    """Players with the columns that scores need; only form differs, so scores are 0.4 times it at most."""
    names = "id long, ord long, name string, team_short string, pos string, price double, form double, status string"
    zero = ["0.0D AS xg90", "0.0D AS xa90", "0.0D AS exp_min", "6.0D AS next3_ease", "0.0D AS avg_points", "0.0D AS value", "0.0D AS ownership"]
    return spark.createDataFrame(rows, names).selectExpr("*", *zero)


def every_pair(slots, scored, band, limit):
    out = {}
    by_id = {p["id"]: p for p in scored}
    own = {}
    for s in slots:
        own.setdefault(s[0], set()).add(s[3])
    for squad, section, slot_no, id_, _, price, bank in slots:
        now = by_id.get(id_)
        if section != "xi" or now is None:
            continue
        fits = [p for p in scored if p["pos"] == now["pos"] and round(p["price"] * 10) <= round(price * 10) + round(bank * 10) and p["status"] == "a" and p["id"] not in own[squad] and abs(p["score"] - now["score"]) <= band]
        fits.sort(key=lambda p: (-abs(p["score"] - now["score"]), p["ord"], p["id"]))
        out[squad, slot_no] = [p["id"] for p in fits[:limit]]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("seed", range(3))
def test_equals_every_pair(spark, seed):
    r = random.Random(seed)
    weights = {"form": 1.0}
    forms = [r.randrange(0, 60) / 10 for _ in range(12)]
    rows = [(i, r.randrange(50), f"p{i}", "T", r.choice(["GK", "DEF"]), r.choice([0.0, 4.0, 4.5, 5.1, 7.9, 12.7, 12.8]), r.choice(forms), r.choice("aaai")) for i in range(160)]
    players = players_of(spark, rows)
    scored = [p.asDict() for p in players.withColumn("score", scoring.score(weights)).collect()]
    slots = [(q, r.choice(["xi", "xi", "bench"]), k, r.randrange(165), "GK", r.choice([0.0, 4.4, 5.0, 8.0, 20.0]), r.choice([0.0, 0.1, 3.0, 90.0])) for q in range(25) for k in range(6)]
    slots_df = spark.createDataFrame(slots, "squad_id long, section string, slot_no int, id long, pos string, price double, bank double")
    found = {}
    for row in sorted(suggest.slot_suggestions(slots_df, players, weights, limit=4).collect(), key=lambda x: x["rank"]):
        found.setdefault((row["squad_id"], row["slot_no"]), []).append(row["id"])
        assert row["rank"] == len(found[row["squad_id"], row["slot_no"]])
    assert found == every_pair(slots, scored, 1.5, 4)


def test_more_squads_ask_no_more(spark):
    """Squads that ask for the same positions, limits and scores share the lists."""
    players = players_of(spark, [(i, i, f"p{i}", "T", "DEF", 4.0 + i % 5, i % 7 / 2, "a") for i in range(60)]).withColumn("cents", (scoring.score({"form": 1.0}) * 100).cast("int"))
    keys = spark.createDataFrame([("DEF", limit, cents) for limit in (40, 62) for cents in (0, 300)], "now_pos string, limit int, now_cents int")
    lists = suggest.farthest(keys, players, 1.5, 6).collect()
    assert len(lists) == 4 and {len(x["found"]) for x in lists if x["limit"] == 62} == {6}
    assert all(abs(c["cents"] - x["now_cents"]) <= 150 and c["price"] * 10 <= x["limit"] for x in lists for c in x["found"])
    assert suggest.farthest(keys.where("limit < 0"), players, 1.5, 6).count() == 0


def test_edge_of_the_band_by_doubles(spark):
    """2.8 - 1.3 is over 1.5 in doubles, 3.0 - 1.5 isn't: as where scores are subtracted directly."""
    rows = [(1, 1, "a", "T", "GK", 4.0, 1.3 / 2, "a"), (2, 2, "b", "T", "GK", 4.0, 2.8 / 2, "a"), (3, 3, "c", "T", "GK", 4.0, 1.5 / 2, "a"), (4, 4, "d", "T", "GK", 4.0, 3.0 / 2, "a")]
    players = players_of(spark, rows)
    scored = [p.asDict() for p in players.withColumn("score", scoring.score({"form": 1.0})).collect()]
    slots = [(k, "xi", 1, k, "GK", 5.0, 0.0) for k in (1, 2, 3, 4)]
    df = spark.createDataFrame(slots, "squad_id long, section string, slot_no int, id long, pos string, price double, bank double")
    found = {}
    for row in sorted(suggest.slot_suggestions(df, players, {"form": 1.0}).collect(), key=lambda x: x["rank"]):
        found.setdefault((row["squad_id"], 1), []).append(row["id"])
    assert found == every_pair(slots, scored, 1.5, 5)


@pytest.mark.parametrize("limit", [1, 4, 10])
def test_requests_equal_every_pair(spark, limit):
    """Requests that share a list, with excluded players at its head, ties, unknown players and null lists."""
    r = random.Random(limit)
    weights = {"form": 1.0}
    rows = [(i, r.randrange(20), f"p{i}", "T", r.choice(["GK", "DEF"]), r.choice([4.0, 4.5, 5.1, 9.9]), r.randrange(0, 9) / 2, r.choice("aaai")) for i in range(120)]
    players = players_of(spark, rows)
    scored = [p.asDict() for p in players.withColumn("score", scoring.score(weights)).collect()]
    asked = [(q, r.randrange(125), r.choice(["GK", "DEF", "FWD"]), r.choice([3.9, 4.5, 5.0, 10.0]), r.choice([None, [], r.sample(range(120), 12)])) for q in range(80)]
    found = {}
    for x in sorted(suggest.suggest(players, spark.createDataFrame(asked, suggest.REQUEST), weights, limit).collect(), key=lambda x: x["rank"]):
        found.setdefault(x["request_id"], []).append((x["rank"], x["id"], x["delta"]))
    expected = {}
    for q, player, pos, price, excluded in asked:
        now = next((p for p in scored if p["id"] == player), None)
        fits = [p for p in scored if now and p["pos"] == pos and p["price"] <= price and p["status"] == "a" and p["id"] != player and p["id"] not in (excluded or [])]
        fits.sort(key=lambda p: (-p["score"], p["ord"], p["id"]))
        if fits:
            expected[q] = [(n, p["id"], pytest.approx(p["score"] - now["score"])) for n, p in enumerate(fits[:limit], 1)]
    assert found == expected
    with pytest.raises(ValueError):
        suggest.suggest(players, spark.createDataFrame(asked, suggest.REQUEST), weights, 11)
