"""Squads: validation, totals and analysis. Slots are rows: squad_id, section (xi, bench), slot_no, id, pos, price, bank."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formatting, scoring
from ..functions.rounding import half_up
from .constants import DEFAULT_WEIGHTS, FORMATIONS
from .suggest import slot_suggestions


def slots_of(squads: DataFrame) -> DataFrame:
    """Slots of squads in nested form: squad_id and squad (startingXI, bench, bank)."""
    part = lambda field, section: squads.select("squad_id", F.lit(section).alias("section"), F.posexplode(f"squad.{field}").alias("slot_no", "slot"), F.col("squad.bank").alias("bank"))
    both = part("startingXI", "xi").unionByName(part("bench", "bench"))
    return both.select("squad_id", "section", (F.col("slot_no") + 1).alias("slot_no"), "slot.*", "bank")


def nested(slots: DataFrame) -> DataFrame:
    """The opposite of slots_of; slots in their order."""
    pick = lambda section: F.transform(F.sort_array(F.collect_list(F.when(F.col("section") == section, F.struct("slot_no", "id", "pos", "price")))), lambda s: F.struct(s["id"], s["pos"], s["price"]))
    return slots.groupBy("squad_id").agg(pick("xi").alias("startingXI"), pick("bench").alias("bench"), F.max("bank").alias("bank")).select("squad_id", F.struct("startingXI", "bench", "bank").alias("squad"))


def _count(section: str, pos: str | None = None) -> Column:
    holds = F.col("section") == section
    return F.count_if(holds & (F.col("pos") == pos) if pos else holds)


def position_counts(slots: DataFrame) -> DataFrame:
    """Per squad: n_xi, n_bench and the starting players of each position."""
    return slots.groupBy("squad_id").agg(_count("xi").alias("n_xi"), _count("bench").alias("n_bench"), *[_count("xi", p).alias(f"n_{p.lower()}") for p in ("GK", "DEF", "MID", "FWD")])


def formations(slots: DataFrame) -> DataFrame:
    counts = position_counts(slots)
    return counts.select("squad_id", formatting.formation(F.col("n_xi"), F.col("n_gk"), F.col("n_def"), F.col("n_mid"), F.col("n_fwd")).alias("formation"))


def validate(slots: DataFrame, most: float = 100.0) -> DataFrame:
    """valid and all errors of each squad, in the order of the rules. Money is compared in tenths."""
    tenths = lambda c: F.round(F.col(c) * 10).cast("long")
    counts = slots.groupBy("squad_id").agg(
        _count("xi").alias("n_xi"), _count("bench").alias("n_bench"), *[_count("xi", p).alias(f"n_{p.lower()}") for p in ("GK", "DEF", "MID", "FWD")],
        F.sum(tenths("price")).alias("cost"), F.max(tenths("bank")).alias("bank"), F.count("id").alias("n_ids"), F.countDistinct("id").alias("n_distinct"),
    )
    legal = F.lit(False)
    for gk, d, m, f in FORMATIONS.values():
        legal |= (F.col("n_gk") == gk) & (F.col("n_def") == d) & (F.col("n_mid") == m) & (F.col("n_fwd") == f)
    # fixed values: the texts of the errors
    rules = [
        (F.col("n_xi") != 11, "Starting XI must have exactly 11 players"),
        (F.col("n_bench") != 4, "Bench must have exactly 4 players"),
        (~legal, "Invalid formation - must have 1 GK and valid DEF/MID/FWD distribution"),
        (F.col("cost") + F.col("bank") > round(most * 10), f"Total squad value cannot exceed {most}"),
        (F.col("n_distinct") != F.col("n_ids"), "Cannot have duplicate players in squad"),
    ]
    errors = F.filter(F.array(*[F.when(broken, text) for broken, text in rules]), lambda e: e.isNotNull())
    return counts.select("squad_id", errors.alias("errors")).select("squad_id", (F.size("errors") == 0).alias("valid"), "errors")


def values(slots: DataFrame) -> DataFrame:
    """Worth of each squad without and with its bank, the share of the budget in use, money spent, teams if known."""
    aggregated = slots.groupBy("squad_id").agg((F.sum(F.round(F.col("price") * 10)) / 10).alias("value_ex_bank"), F.max("bank").alias("bank"))
    return aggregated.select("squad_id", "value_ex_bank", (F.round((F.col("value_ex_bank") + F.col("bank")) * 10) / 10).alias("value_inc_bank"), F.col("value_ex_bank").alias("budget_used_percent"), (F.lit(100.0) - F.col("bank")).alias("spent"))


def team_counts(slots: DataFrame, players: DataFrame) -> DataFrame:
    return slots.join(players.select("id", "team_id"), "id").groupBy("squad_id").agg(F.countDistinct("team_id").alias("n_teams"))


def scored_slots(slots: DataFrame, players: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Known slots with the player's name, score and label; unknown ids are left out."""
    scored = players.withColumn("score", scoring.score(weights)).select("id", "name", "team_short", "status", "score")
    rows = slots.select("squad_id", "section", "slot_no", "id", "pos", "price", "bank").join(scored, "id")
    return rows.withColumn("label", scoring.label(F.col("score"), F.col("status"))).drop("status")


def _sums() -> list[Column]:
    """Aggregates of a squad's scored slots: cents (whole hundredths have no rounding noise), flagged, n and bank_left."""
    starting = F.col("section") == "xi"
    cents = F.round(F.col("score") * 100).cast("long")
    return [F.sum(F.when(starting, cents).otherwise(0)).alias("cents"), F.count_if(starting & (F.col("label") != "perfect")).alias("flagged"), F.count("*").alias("n"), F.max("bank").alias("bank_left")]


def _totals() -> list[Column | str]:
    total = F.col("cents") / 100
    return ["squad_id", total.alias("total_score"), half_up(total / F.col("n")).alias("average_score"), "flagged", "bank_left"]


def totals(slots: DataFrame, players: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Per squad the starting players' total score and flagged players; their total over all known slots as mean."""
    return scored_slots(slots, players, weights).groupBy("squad_id").agg(*_sums()).select(*_totals())


def analyse(slots: DataFrame, players: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """One nested row per squad: totals, and results with each slot's score, label and suggestions."""
    found = slot_suggestions(slots, players, weights).groupBy("squad_id", "slot_no").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "name", "price", "delta"))).alias("suggestions"))
    rows = scored_slots(slots, players, weights)
    some = rows.join(found.withColumn("section", F.lit("xi")), ["squad_id", "section", "slot_no"], "left")
    none = F.array().cast("array<struct<rank:int,id:bigint,name:string,price:double,delta:double>>")
    entry = F.struct(F.when(F.col("section") == "xi", 0).otherwise(1).alias("part"), "slot_no", "section", "id", "name", "pos", "price", "score", "label", F.coalesce("suggestions", none).alias("suggestions"))
    return some.groupBy("squad_id").agg(*_sums(), F.sort_array(F.collect_list(entry)).alias("results")).select(*_totals(), "results")


# Editing keeps at most 11 starting and 4 bench slots, and no player twice.


def add_slot(slots: DataFrame, squad_id: int, section: str, id_: int, pos: str, price: float) -> DataFrame:
    """slots with one more, at the end of its section; unchanged where there is no room or the player is in already."""
    if section not in ("xi", "bench"):
        raise ValueError(f"{section!r} is no section")
    most = 11 if section == "xi" else 4
    mine = slots.where(F.col("squad_id") == squad_id)
    state = mine.agg(F.count_if(F.col("section") == section).alias("n"), F.count_if(F.col("id") == id_).alias("there"), F.max("bank").alias("bank"))
    new = state.where((F.col("n") < most) & (F.col("there") == 0)).select(F.lit(squad_id).cast("long").alias("squad_id"), F.lit(section).alias("section"), (F.col("n") + 1).cast("int").alias("slot_no"), F.lit(id_).cast("long").alias("id"), F.lit(pos).alias("pos"), F.lit(float(price)).alias("price"), "bank")
    return slots.select(*new.columns).unionByName(new)


def remove_slot(slots: DataFrame, squad_id: int, id_: int) -> DataFrame:
    return slots.where(~((F.col("squad_id") == squad_id) & (F.col("id") == id_)))


def move_slots(slots: DataFrame, moves: DataFrame) -> DataFrame:
    """slots after one move for each squad: the player goes to the end of the other section, then slots are put in order.

    moves: squad_id, id, from_starting. A squad stays as it is where the player isn't in the section it should leave or the
    other one is full.
    """
    state = slots.groupBy("squad_id").agg(_count("xi").alias("n_xi"), _count("bench").alias("n_bench"))
    source, target = F.when(F.col("from_starting"), "xi").otherwise("bench"), F.when(F.col("from_starting"), "bench").otherwise("xi")
    room = F.when(F.col("from_starting"), F.col("n_bench") < 4).otherwise(F.col("n_xi") < 11)
    wanted = moves.join(state, "squad_id").where(room).select("squad_id", "id", source.alias("section"), target.alias("_to"))
    moved = slots.join(wanted, ["squad_id", "id", "section"], "left")
    changed = moved.withColumn("section", F.coalesce("_to", "section")).withColumn("slot_no", F.when(F.col("_to").isNotNull(), 100).otherwise(F.col("slot_no")))
    return in_order(changed.select(*slots.columns))


def split_by_index(picks: DataFrame, starting: int = 11) -> DataFrame:
    """Slots of squads given as lists: squad_id and picks (array<struct<id, pos, price>>); the first `starting` ones start."""
    rows = picks.select("squad_id", F.posexplode("picks").alias("k", "pick"))
    xi = F.col("k") < starting
    return rows.select("squad_id", F.when(xi, "xi").otherwise("bench").alias("section"), (F.when(xi, F.col("k")).otherwise(F.col("k") - starting) + 1).cast("int").alias("slot_no"), "pick.*")


def in_order(slots: DataFrame) -> DataFrame:
    """Slots numbered anew by position, GK first, then as they were."""
    place = F.array_position(F.array(*[F.lit(p) for p in ("GK", "DEF", "MID", "FWD")]), F.col("pos"))
    return slots.withColumn("slot_no", F.row_number().over(Window.partitionBy("squad_id", "section").orderBy(place, "slot_no")))
