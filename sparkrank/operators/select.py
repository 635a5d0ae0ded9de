"""Selecting teams: by formation from predictions, and greedily under a budget."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import confidence
from . import filters
from .constants import FORMATIONS, POSITIONS, SQUAD_PLACES, STRATEGIES
from .stats import scored_by_sets

#: Players of one position and price that can matter at most: one more than a squad has used at any time.
PER_PRICE = 16
PICK = "struct<section:string,slot_no:int,id:bigint,pos:string,tenths:int,score:double>"
CANDIDATE = ["pos", "id", "ord", "tenths", "score"]


def top_by_position(predictions: DataFrame, k: int = 5) -> DataFrame:
    """The k players of each position with the highest predicted points, and how far to trust each."""
    rank = F.row_number().over(Window.partitionBy("position").orderBy(F.desc("predicted_points"), "player_id"))
    return predictions.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("confidence", confidence(F.col("predicted_points")))


def merged(tops: DataFrame) -> DataFrame:
    """The positions' best, at most a few rows each, in one list by predicted points."""
    return tops.withColumn("place", F.row_number().over(Window.orderBy(F.desc("predicted_points"), "player_id")))


def top_overall(predictions: DataFrame, k: int = 10) -> DataFrame:
    return predictions.orderBy(F.desc("predicted_points"), "player_id").limit(k)


def report(predictions: DataFrame) -> DataFrame:
    """Lines of a report: the best five of each position, then the best ten of all."""
    line = lambda df, section, rank: df.select(section.alias("section"), rank.alias("rank"), F.format_string("%d. player %d, %.2f points", rank, F.col("player_id"), F.col("predicted_points")).alias("line"))
    tops = top_by_position(predictions)
    return line(tops, F.concat(F.lit("position "), F.col("position").cast("string")), F.col("rank")).unionByName(line(merged(top_overall(predictions)), F.lit("all"), F.col("place")))


def name_predictions(predictions: DataFrame, players: DataFrame) -> DataFrame:
    """Predictions with name and team_name of the current players; unknown ones get a made-up name."""
    known = players.select(F.col("id").alias("player_id"), F.col("name").alias("known_name"), F.col("team_name").alias("known_team"))
    rows = predictions.join(known, "player_id", "left")
    return rows.select(*predictions.columns, F.coalesce("known_name", F.concat(F.lit("Player "), F.col("player_id").cast("string"))).alias("name"), F.coalesce("known_team", F.lit("Unknown")).alias("team_name"))


def by_formation(predictions: DataFrame, formation: str = "3-4-3") -> DataFrame:
    """The best predicted players that the formation's starting places and the squad's places hold: section xi or bench.

    Taking players in order of points while their position has room is a rank within the position, so the cut
    is known before any global order. Unknown formations count as 3-4-3.
    """
    starting = FORMATIONS.get(formation, FORMATIONS["3-4-3"])
    places = F.create_map(*[F.lit(x) for i, p in POSITIONS.items() for x in (p, starting[i - 1])])
    totals = F.create_map(*[F.lit(x) for i, p in POSITIONS.items() for x in (p, SQUAD_PLACES[i - 1])])
    rank = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("predicted_points"), "player_id"))
    ranked = predictions.withColumn("rank", rank).where(F.col("rank") <= max(SQUAD_PLACES)).where(F.col("rank") <= totals[F.col("pos")])
    return ranked.withColumn("section", F.when(F.col("rank") <= places[F.col("pos")], "xi").otherwise("bench"))


def formation_totals(team: DataFrame) -> DataFrame:
    return team.agg((F.sum(F.round(F.col("price") * 10)) / 10).alias("total_cost"), F.sum("predicted_points").alias("expected_points"), F.count("*").alias("n_players"))


def _key(strategy: Column, score: Column, tenths: Column, value_by_price: bool) -> Column:
    price = tenths / 10
    key = F.when(strategy == "premium", score * (F.lit(1.0) + price * F.lit(0.1)))
    if value_by_price:
        key = key.when(strategy == "value", score / price)
    return key.otherwise(score)


def _first(pool: Column, holds) -> Column:
    return F.try_element_at(F.filter(pool, holds), F.lit(1))


def _places() -> Column:
    """The places in the order they are filled; a flexible one is open while the eleven isn't full."""
    fixed = [("xi", [p], -1) for p, n in (("GK", 1), ("DEF", 3), ("MID", 3), ("FWD", 1)) for _ in range(n)]
    free = [("xi", ["DEF", "MID", "FWD"], k) for k in range(11)]
    bench = [("bench", [p], -1) for p in ("GK", "DEF", "MID", "FWD")]
    return F.array(*[F.struct(F.lit(s).alias("section"), F.array(*[F.lit(p) for p in ps]).alias("pos"), F.lit(k).alias("free")) for s, ps, k in [*fixed, *free, *bench]])


def _fill(pool: Column, budget: Column) -> Column:
    """Folds the places: each takes the best affordable unused candidate of its positions by the pool's order.

    Of a flexible place's positions the one whose candidate has the highest raw score wins, the earlier one in a tie.
    """
    start = F.struct(budget.cast("int").alias("bank"), F.array().cast("array<bigint>").alias("used"), F.array().cast(f"array<{PICK}>").alias("picks"), F.lit(0).alias("required"))

    def step(acc: Column, place: Column) -> Column:
        best = F.transform(place["pos"], lambda p, i: F.struct(_first(pool, lambda c: (c["pos"] == p) & (c["tenths"] <= acc["bank"]) & ~F.array_contains(acc["used"], c["id"])).alias("c"), i.alias("i")))
        able = F.filter(best, lambda b: b["c"].isNotNull() & ((place["free"] < 0) | (b["c"]["score"] > -1)))
        open_ = (place["free"] < 0) | (place["free"] < F.lit(11) - acc["required"])
        top = F.array_max(F.transform(able, lambda b: F.struct(b["c"]["score"].alias("score"), (-b["i"]).alias("early"), b["c"].alias("c"))))["c"]
        slot_no = F.size(F.filter(acc["picks"], lambda x: x["section"] == place["section"])) + 1
        pick = F.struct(place["section"].alias("section"), slot_no.cast("int").alias("slot_no"), top["id"].alias("id"), top["pos"].alias("pos"), top["tenths"].alias("tenths"), top["score"].alias("score"))
        taken = F.struct(
            (acc["bank"] - top["tenths"]).cast("int").alias("bank"), F.concat(acc["used"], F.array(top["id"])).alias("used"), F.concat(acc["picks"], F.array(pick.cast(PICK))).alias("picks"),
            F.when((place["free"] < 0) & (place["section"] == "xi"), acc["required"] + 1).otherwise(acc["required"]).alias("required"),
        )
        return F.when(open_ & top.isNotNull(), taken).otherwise(acc)

    return F.aggregate(_places(), start, step)


def _upgrade(pool: Column, team: Column) -> Column:
    """Folds the eleven once: each may give way to a dearer, unused candidate of its position with a better score."""
    start = F.struct(team["bank"].alias("bank"), team["used"].alias("used"), F.array().cast(f"array<{PICK}>").alias("picks"))

    def step(acc: Column, pick: Column) -> Column:
        best = _first(pool, lambda c: (c["pos"] == pick["pos"]) & (c["tenths"] <= acc["bank"] + pick["tenths"]) & (c["tenths"] > pick["tenths"]) & ~F.array_contains(acc["used"], c["id"]))
        new = F.struct(pick["section"].alias("section"), pick["slot_no"].alias("slot_no"), best["id"].alias("id"), best["pos"].alias("pos"), best["tenths"].alias("tenths"), best["score"].alias("score"))
        better = (pick["section"] == "xi") & best.isNotNull() & (best["score"] > pick["score"])
        changed = F.struct((acc["bank"] + pick["tenths"] - best["tenths"]).cast("int").alias("bank"), F.concat(F.array_remove(acc["used"], pick["id"]), F.array(best["id"])).alias("used"), F.concat(acc["picks"], F.array(new.cast(PICK))).alias("picks"))
        same = F.struct(acc["bank"].alias("bank"), acc["used"].alias("used"), F.concat(acc["picks"], F.array(pick)).alias("picks"))
        return F.when(better, changed).otherwise(same)

    return F.aggregate(team["picks"], start, step)


def generate(players: DataFrame, budget: float = 100.0, strategies: Mapping[str, Mapping[str, float]] = STRATEGIES, upgrade: bool = True) -> DataFrame:
    """A squad per strategy: strategy, section, slot_no, id, pos, price, score and the bank that is left.

    Players are scored under all strategies in one pass. Of one position and price only the best PER_PRICE can be
    picked, so what meets in a row per strategy is bounded by prices, not by players, and the cut runs before the
    shuffle too. The choices, each depending on those before it, are a fold over the places. Money is in tenths.
    """
    if not 80 <= budget <= 100:
        raise ValueError("a budget is 80 to 100")
    scored = scored_by_sets(players.where("status = 'a'"), strategies).withColumn("tenths", F.round(F.col("price") * 10).cast("int"))
    rank = F.row_number().over(Window.partitionBy("strategy", "pos", "tenths").orderBy(F.desc("score"), "ord", "id"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= PER_PRICE)
    entry = lambda by_price: F.struct((-_key(F.col("strategy"), F.col("score"), F.col("tenths"), by_price)).alias("k"), (-F.col("score")).alias("s"), *[F.col(c) for c in ("ord", "id", "pos", "tenths", "score")])
    pools = best.groupBy("strategy").agg(F.sort_array(F.collect_list(entry(True))).alias("pool"), F.sort_array(F.collect_list(entry(False))).alias("raw"))
    team = pools.withColumn("team", _fill(F.col("pool"), F.lit(round(budget * 10))))
    if upgrade:
        better = _upgrade(F.col("raw"), F.col("team"))
        plain = F.struct(F.col("team.bank").alias("bank"), F.col("team.used").alias("used"), F.col("team.picks").alias("picks"))
        team = team.withColumn("team", F.when(F.col("team.bank") > 20, better).otherwise(plain))
    rows = team.select("strategy", (F.col("team.bank") / 10).alias("bank"), F.explode("team.picks").alias("p"))
    return rows.select("strategy", "p.section", "p.slot_no", "p.id", "p.pos", (F.col("p.tenths") / 10).alias("price"), "p.score", "bank")


def ai_squad(team: DataFrame, players: DataFrame, budget: float = 100.0) -> DataFrame:
    """A formation's picks as squad slots with names and prices; unknown players get defaults; bank from the budget."""
    known = players.select(F.col("id"), F.col("name").alias("known"), F.col("team_short").alias("known_team"), F.col("pos").alias("known_pos"), F.col("price").alias("known_price"))
    rows = team.select(F.col("player_id").alias("id"), "section", "rank", "predicted_points").join(known, "id", "left")
    order = Window.partitionBy("section").orderBy(F.desc("predicted_points"), "id")
    filled = rows.select("section", F.row_number().over(order).alias("slot_no"), "id", F.coalesce("known", F.concat(F.lit("Player "), F.col("id").cast("string"))).alias("name"), F.coalesce("known_team", F.lit("T1")).alias("team_short"), F.coalesce("known_pos", F.lit("MID")).alias("pos"), F.coalesce("known_price", F.lit(5.0)).alias("price"))
    cost = filled.agg((F.sum(F.round(F.col("price") * 10)) / 10).alias("cost"))
    return filled.join(F.broadcast(cost)).select("section", "slot_no", "id", "name", "team_short", "pos", "price", (F.lit(budget) - F.col("cost")).alias("bank"))  # one row


def ai_or_balanced(predictions: DataFrame, players: DataFrame, budget: float = 100.0, formation: str = "3-4-3", excluded: list[int] = ()) -> DataFrame:
    """The predictions' team; if they are too few, the balanced squad, with fallback true."""
    try:
        kept = filters.affordable(predictions, budget, excluded)
    except ValueError:
        rows = generate(players, budget, {"balanced": STRATEGIES["balanced"]}).join(players.select("id", "name", "team_short"), "id")
        return rows.select("section", "slot_no", "id", "name", "team_short", "pos", "price", "bank", F.lit(True).alias("fallback"))
    return ai_squad(by_formation(kept, formation), players).withColumn("fallback", F.lit(False))
