"""Edit logs against a walk in plain Python."""

import random

import pytest

from sparkrank.operators import edits

ORDER = ["GK", "DEF", "MID", "FWD"]
POS = lambda i: ORDER[i % 4]


def walked(logs, squads):
    outcomes, left = {}, {}
    for squad in {*logs, *squads}:
        state = {"xi": [], "bench": []} | {k: list(v) for k, v in squads.get(squad, {}).items()}
        for edit, kind, player in sorted(logs.get(squad, [])):
            inside = player in state["xi"] + state["bench"]
            source, target = {"to_bench": ("xi", "bench"), "to_xi": ("bench", "xi"), "add_xi": (None, "xi"), "add_bench": (None, "bench")}.get(kind, (None, None))
            full = target and len(state[target]) >= edits.MOST[target]
            if player is None or (target is None and kind != "remove"):
                said = "unknown"
            elif kind.startswith("add"):
                said = "full" if full else "already in" if inside else "done"
            elif kind == "remove":
                said = "done" if inside else "not there"
            else:
                said = "not there" if player not in state[source] else "full" if full else "done"
            outcomes[squad, edit] = said
            if said == "done":
                for s in state.values():
                    if player in s and not kind.startswith("add"):
                        s.remove(player)
                if target:
                    state[target].append(player)
        for section, ids in state.items():
            for n, player in enumerate(sorted(ids, key=lambda i: i % 4), 1):
                left[squad, section, n] = player
    return outcomes, left


def tables(spark, logs, squads):
    rows = [(s, e, k, p, POS(p or 0), 5.0) for s, log in logs.items() for e, k, p in log]
    slots = [(s, section, n, p, POS(p), 4.0, 0.5) for s, sections in squads.items() for section, ids in sections.items() for n, p in enumerate(ids, 1)]
    return (
        spark.createDataFrame(rows, "squad_id long, edit_id long, kind string, id long, pos string, price double"),
        spark.createDataFrame(slots, "squad_id long, section string, slot_no int, id long, pos string, price double, bank double"),
    )


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_walk(spark, seed):
    r = random.Random(seed)
    kinds = ["add_xi"] * 4 + ["add_bench"] * 2 + ["to_xi", "to_bench", "remove", "swap"]
    logs = {s: [(e, r.choice(kinds), r.choice([None, *range(1, 20)])) for e in r.sample(range(1000), r.randint(1, 90))] for s in range(12)}
    squads = {s: {"xi": r.sample(range(1, 20), 8)} for s in (0, 3, 50)}
    squads[0]["bench"] = [p for p in range(1, 20) if p not in squads[0]["xi"]][:3]
    log_rows, slots = tables(spark, logs, squads)
    outcomes, left = edits.apply_edits(log_rows, slots)
    expected_outcomes, expected = walked(logs, squads)
    assert {(x["squad_id"], x["edit_id"]): x["outcome"] for x in outcomes.collect()} == expected_outcomes
    # those who start are in the order of positions already
    assert {(x["squad_id"], x["section"], x["slot_no"]): x["id"] for x in left.collect()} == expected
    assert set(expected_outcomes.values()) == set(edits.OUTCOMES.values())


def test_no_squads_before(spark):
    logs = {1: [(1, "add_xi", 8), (2, "add_xi", 5), (3, "add_bench", 8), (4, "to_bench", 8), (5, "remove", 5)]}
    log_rows, _ = tables(spark, logs, {})
    outcomes, left = edits.apply_edits(log_rows)
    assert {x["edit_id"]: x["outcome"] for x in outcomes.collect()} == {1: "done", 2: "done", 3: "already in", 4: "done", 5: "done"}
    assert [tuple(x) for x in left.select("squad_id", "section", "slot_no", "id", "pos", "price").collect()] == [(1, "bench", 1, 8, "GK", 5.0)]
    assert edits.apply_edits(log_rows.limit(0))[0].count() == 0
