"""Logs of squad edits: each edit is accepted or refused by what the edits before it left.

An edit adds a player to the starting eleven (add_xi) or the bench (add_bench), removes one (remove), or moves one to the bench (to_bench) or
back (to_xi). Edits of a squad follow each other by edit_id. An eleven holds 11 and a bench 4 slots, and no player is in a squad
twice. What becomes of an edit: `done`; `full` where the section it adds to is (told before anything else of an add);
`already in` for an add of a player of the squad; `not there` for a move or removal of one who isn't where it should be; `unknown`
for another kind, or without a player.

A log is folded by aggregate() in its order. The fold's state are the two sections, 15 slots at most, and one character for each
edit so far, which are copied at each step: a log of n edits costs n^2 / 2 bytes of copying, so logs of up to some ten thousand edits
(50 MB) are meant; longer ones are right but slow. Logs are spread over tasks, each is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .squad import in_order

MOST = {"xi": 11, "bench": 4}
OUTCOMES = {"d": "done", "f": "full", "a": "already in", "n": "not there", "u": "unknown"}
SLOT = "array<struct<id:bigint,pos:string,price:double>>"


def _has(section: Column, player: Column) -> Column:
    return F.exists(section, lambda s: s["id"] == player)


def _outcome(state: Column, edit: Column) -> Column:
    """The letter of what becomes of an edit."""
    kind, player, xi, bench = edit["kind"], edit["id"], state["xi"], state["bench"]
    full = lambda section: F.size(state[section]) >= MOST[section]
    inside = _has(xi, player) | _has(bench, player)
    adds = F.when(F.when(kind == "add_xi", full("xi")).otherwise(full("bench")), "f").when(inside, "a").otherwise("d")
    moves = F.when(~F.when(kind == "to_bench", _has(xi, player)).otherwise(_has(bench, player)), "n").when(F.when(kind == "to_bench", full("bench")).otherwise(full("xi")), "f").otherwise("d")
    removes = F.when(inside, "d").otherwise("n")
    known = F.when(kind.isin("add_xi", "add_bench"), adds).when(kind.isin("to_xi", "to_bench"), moves).when(kind == "remove", removes)
    return F.when(player.isNull(), "u").otherwise(F.coalesce(known, F.lit("u")))


def _after(state: Column, edit: Column, outcome: Column) -> Column:
    """The state after an edit."""
    kind, player = edit["kind"], edit["id"]
    without = lambda section: F.filter(state[section], lambda s: s["id"] != player)
    new = F.array(F.struct(player.alias("id"), edit["pos"].alias("pos"), edit["price"].alias("price")))
    taken = lambda section: F.filter(state[section], lambda s: s["id"] == player)
    xi = F.when(kind == "add_xi", F.concat(state["xi"], new)).when(kind == "to_xi", F.concat(state["xi"], taken("bench"))).when(kind.isin("remove", "to_bench"), without("xi")).otherwise(state["xi"])
    bench = F.when(kind == "add_bench", F.concat(state["bench"], new)).when(kind == "to_bench", F.concat(state["bench"], taken("xi"))).when(kind.isin("remove", "to_xi"), without("bench")).otherwise(state["bench"])
    done = outcome == "d"
    return F.struct(F.when(done, xi).otherwise(state["xi"]).alias("xi"), F.when(done, bench).otherwise(state["bench"]).alias("bench"), F.concat(state["said"], outcome).alias("said"))


def apply_edits(edits: DataFrame, squads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(squad_id, edit_id, outcome) of every edit, and the slots (squad_id, section, slot_no, id, pos, price) that are left, in order.

    edits: squad_id, edit_id, kind, id, pos and price. squads: slots before the first edit (no squad has any by default); squads
    without edits stay as they are.
    """
    log = F.array_sort(F.collect_list(F.struct("edit_id", "kind", F.col("id").cast("long").alias("id"), "pos", F.col("price").cast("double").alias("price"))))
    logs = edits.groupBy("squad_id").agg(log.alias("log"))
    empty = F.array().cast(SLOT)
    if squads is None:
        rows = logs.select("squad_id", "log", empty.alias("xi"), empty.alias("bench"))
    else:
        entry = F.struct("slot_no", F.col("id").cast("long").alias("id"), "pos", F.col("price").cast("double").alias("price"))
        held = [F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, entry))), lambda x: F.struct(x["id"].alias("id"), x["pos"].alias("pos"), x["price"].alias("price"))).alias(s) for s in MOST]
        no_log = F.array().cast("array<struct<edit_id:bigint,kind:string,id:bigint,pos:string,price:double>>")
        rows = logs.join(squads.groupBy("squad_id").agg(*held), "squad_id", "full")
        rows = rows.select("squad_id", F.coalesce("log", no_log).alias("log"), *[F.coalesce(s, empty).alias(s) for s in MOST])
    start = F.struct(F.col("xi").cast(SLOT).alias("xi"), F.col("bench").cast(SLOT).alias("bench"), F.lit("").alias("said"))

    def step(state: Column, edit: Column) -> Column:
        return F.element_at(F.transform(F.array(_outcome(state, edit)), lambda o: _after(state, edit, o)), 1)

    folded = rows.select("squad_id", F.transform("log", lambda e: e["edit_id"]).alias("edits"), F.aggregate("log", start, step).alias("end"))
    names = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    told = folded.select("squad_id", F.posexplode("edits").alias("at", "edit_id"), F.col("end.said").alias("said"))
    outcomes = told.select("squad_id", "edit_id", F.element_at(names, F.substring("said", F.col("at") + 1, F.lit(1))).alias("outcome"))
    sections = [folded.select("squad_id", F.lit(s).alias("section"), F.posexplode(f"end.{s}").alias("at", "slot")) for s in MOST]
    left = sections[0].unionByName(sections[1]).select("squad_id", "section", (F.col("at") + 1).alias("slot_no"), "slot.*")
    return outcomes, in_order(left)
