"""Request tables: every rule of each kind, several errors of one body, types that JSON tells apart."""

import json

import pytest

from sparkrank.operators import requests

SLOT = {"id": 1, "pos": "GK", "price": 4.5}
SQUAD = {"startingXI": [SLOT] * 11, "bench": [SLOT] * 4, "bank": 0}
WISH = {"playerId": 3, "position": "MID", "maxPrice": 15}


def squad(**changes):
    return {"squad": SQUAD | changes}


def xi(**slot):
    return squad(startingXI=[SLOT] * 10 + [SLOT | slot])


CASES = [
    ("analyze", squad(), []),
    ("analyze", squad() | {"weights": {"form": 0, "ownership": 1.0, "other": 7}}, []),
    ("analyze", squad() | {"weights": None}, ["weights not an object"]),
    ("analyze", squad() | {"weights": {"form": -0.1, "expMin": 1.1, "value": "1", "xg90": None}}, ["weights.form under 0", "weights.xg90 not a number", "weights.expMin over 1", "weights.value not a number"]),
    ("analyze", {}, ["squad required"]),
    ("analyze", {"squad": []}, ["squad not an object"]),
    ("analyze", squad(bench=[SLOT] * 3, bank=101), ["squad.bench not 4 entries", "squad.bank over 100"]),
    ("analyze", {"squad": {"bench": {}, "bank": "5"}}, ["squad.startingXI required", "squad.bench not a list", "squad.bank not a number"]),
    ("analyze", xi(id=-1.5, pos="gk", price=0), ["squad.startingXI.10.id not whole", "squad.startingXI.10.id not over 0", "squad.startingXI.10.pos unknown", "squad.startingXI.10.price not over 0"]),
    ("analyze", xi(price=15.1, pos=4), ["squad.startingXI.10.pos not a text", "squad.startingXI.10.price over 15"]),
    ("analyze", squad(startingXI=[5] + [SLOT] * 9), ["squad.startingXI not 11 entries", "squad.startingXI.0 not an object"]),
    ("suggestion", WISH, []),
    ("suggestion", WISH | {"excludeIds": [1, 2.0], "limit": 10}, []),
    ("suggestion", WISH | {"excludeIds": [0, "2", 1.5], "limit": 10.5}, ["excludeIds.0 not over 0", "excludeIds.1 not a number", "excludeIds.2 not whole", "limit not whole", "limit over 10"]),
    ("suggestion", {"position": None, "maxPrice": True, "limit": None}, ["playerId required", "position required", "maxPrice not a number", "limit not a number"]),
    ("bulk", {"players": []}, []),
    ("bulk", {"players": [{"id": 1, "position": "FWD", "maxPrice": 0.1}, {"id": 0}], "weights": {"avgPoints": 9, "form": 2}}, ["players.1.id not over 0", "players.1.position required", "players.1.maxPrice required", "weights.form over 1"]),
    ("generate", {"strategy": "ai"}, []),
    ("generate", {"strategy": "best", "budget": 79.9}, ["strategy unknown", "budget under 80"]),
    ("search", {"name": "é" * 100}, []),
    ("search", {"name": ""}, ["name under 1 characters"]),
    ("search", {"name": "x" * 101}, ["name over 100 characters"]),
    ("other", {}, ["kind unknown"]),
    ("search", [], [" not an object"]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, kind, json.dumps(body)) for i, (kind, body, _) in enumerate(CASES)] + [(100, "search", "{no json"), (101, "search", None), (102, None, "{}")]
    checked = requests.request_errors(spark.createDataFrame(rows, "id int, kind string, body string"))
    return {r["id"]: [f"{e['path']} {e['error']}" for e in r["errors"]] for r in checked.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_errors_of_a_body(found, i):
    assert found[i] == CASES[i][2]


def test_bodies_that_are_none(found):
    assert found[100] == found[101] == [" not an object"] and found[102] == ["kind unknown"]


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_checks_of_events_are_made_once_and_in_many_tasks(spark, sf_dir):
    from sparkrank.plans import queries

    nodes = [str(node).split("\n")[0] for node in _nodes(queries.QUERIES["request_errors"](spark, sf_dir)._jdf.queryExecution().optimizedPlan())]
    checking = [i for i, node in enumerate(nodes) if "try_variant_get" in node]
    assert len(checking) == 1 and nodes[checking[0]].startswith("Project")
    assert [node for node in nodes[checking[0] :] if node.startswith("Repartition")]
