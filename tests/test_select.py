"""Selections against restatements in plain Python, on random pools with ties."""

import random

import pytest

from sparkrank.operators import select, stats
from sparkrank.operators.constants import FORMATIONS, SQUAD_PLACES, STRATEGIES


def pick(pool, used, bank, strategy):
    open_ = [p for p in pool if p["id"] not in used and p["tenths"] <= bank]
    if not open_:
        return None
    price = lambda p: p["tenths"] / 10
    key = {"premium": lambda p: p["score"] * (1 + price(p) * 0.1), "value": lambda p: p["score"] / price(p)}.get(strategy, lambda p: p["score"])
    return max(open_, key=key)  # the first of equal ones, as pools are in order


def squad(players, strategy, budget):
    pools = {pos: sorted((p for p in players if p["pos"] == pos), key=lambda p: (-p["score"], p["ord"])) for pos in ("GK", "DEF", "MID", "FWD")}
    xi, bench, bank = [], [], budget

    def take(place, p):
        nonlocal bank
        place.append(p)
        bank -= p["tenths"]

    ids = lambda: {p["id"] for p in xi + bench}
    for pos, n in (("GK", 1), ("DEF", 3), ("MID", 3), ("FWD", 1)):
        for _ in range(n):
            if p := pick(pools[pos], ids(), bank, strategy):
                take(xi, p)
    for _ in range(11 - len(xi)):
        found = [p for pos in ("DEF", "MID", "FWD") if (p := pick(pools[pos], ids(), bank, strategy))]
        if found:
            take(xi, max(found, key=lambda p: p["score"]))
    for pos in pools:
        if p := pick(pools[pos], ids(), bank, strategy):
            take(bench, p)
    if bank > 20:
        used = ids()
        for k, now in enumerate(xi):
            better = [p for p in pools[now["pos"]] if p["id"] not in used and now["tenths"] < p["tenths"] <= bank + now["tenths"]]
            best = pick(better, set(), 10**9, strategy if strategy == "premium" else "")
            if best and best["score"] > now["score"]:
                bank += now["tenths"] - best["tenths"]
                used = used - {now["id"]} | {best["id"]}
                xi[k] = best
    return xi, bench, bank


@pytest.mark.parametrize("seed,sizes,prices", [(1, (10, 40, 40, 20), (40, 60)), (2, (2, 5, 5, 3), (60, 90)), (3, (1, 2, 9, 0), (40, 120)), (4, (30, 200, 200, 100), (45, 50)), (5, (5, 30, 30, 12), (40, 140))])
def test_generate_equals_plain_python(spark, seed, sizes, prices):
    r = random.Random(seed)
    rows = []
    for pos, n in zip(("GK", "DEF", "MID", "FWD"), sizes, strict=True):
        for _ in range(n):
            i = len(rows)
            rows.append((i, i, f"p{i}", 1, "T", pos, r.randrange(*prices) / 10, float(r.randrange(6)), r.choice("aaaad"), r.randrange(4) / 10, r.randrange(4) / 10, float(r.randrange(0, 91, 30)), 3.0, float(r.randrange(12)), 1.0, 10.0))
    frame = spark.createDataFrame(rows, "id long, ord long, name string, team_id int, team_short string, pos string, price double, form double, status string, xg90 double, xa90 double, exp_min double, next3_ease double, avg_points double, value double, ownership double")
    found = {}
    for row in select.generate(frame, 90.0).collect():
        found.setdefault(row["strategy"], []).append(row)
    scored = {}
    for row in stats.scored_by_sets(frame.where("status = 'a'"), STRATEGIES).collect():
        scored.setdefault(row["strategy"], []).append({"id": row["id"], "ord": row["ord"], "pos": row["pos"], "tenths": round(row["price"] * 10), "score": row["score"]})
    for strategy in STRATEGIES:
        xi, bench, bank = squad(scored[strategy], strategy, 900)
        got = sorted(found.get(strategy, []), key=lambda x: (x["section"] != "xi", x["slot_no"]))
        assert [x["id"] for x in got] == [p["id"] for p in xi + bench], strategy
        assert round(got[0]["bank"] * 10) == bank
        assert len({x["id"] for x in got}) == len(got)


@pytest.mark.parametrize("formation", sorted(FORMATIONS))
def test_formation_equals_the_walk(spark, formation):
    r = random.Random(hash(formation) % 1000)
    rows = [(i, r.choice(["GK", "DEF", "MID", "FWD"]), 5.0, float(r.randrange(8))) for i in range(70)]
    frame = spark.createDataFrame(rows, "player_id long, pos string, price double, predicted_points double")
    start, total = (dict(zip(("GK", "DEF", "MID", "FWD"), x, strict=True)) for x in (FORMATIONS[formation], SQUAD_PLACES))
    counts, xi, bench = dict.fromkeys(start, 0), [], []
    ordered = sorted(rows, key=lambda x: (-x[3], x[0]))
    for row in ordered:
        if counts[row[1]] < start[row[1]]:
            counts[row[1]] += 1
            xi.append(row[0])
    for row in ordered:
        if row[0] not in xi and counts[row[1]] < total[row[1]]:
            counts[row[1]] += 1
            bench.append(row[0])
    found = select.by_formation(frame, formation).collect()
    assert sorted(x["player_id"] for x in found if x["section"] == "xi") == sorted(xi)
    assert sorted(x["player_id"] for x in found if x["section"] == "bench") == sorted(bench)


def test_budget_is_checked(spark):
    with pytest.raises(ValueError):
        select.generate(None, 10.0)


def test_too_few_predictions_fall_back(spark, sf_dir):
    from sparkrank.plans import domain

    players = domain.enriched(spark, sf_dir)
    found = select.ai_or_balanced(domain.predictions(spark, sf_dir).limit(4), players).collect()
    assert found and all(r["fallback"] for r in found)
