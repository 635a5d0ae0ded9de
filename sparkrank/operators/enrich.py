"""Enriched players: teams, coming fixtures and advanced statistics joined to each player."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import number

ENRICHED = ["id", "ord", "name", "team_id", "team_short", "pos", "price", "form", "status", "xg90", "xa90", "exp_min", "next3_ease", "avg_points", "value", "ownership"]


def position(code: str | Column, default: str | None = "MID"):
    """GK, DEF, MID, FWD for 1 to 4."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate(["GK", "DEF", "MID", "FWD"], 1) for x in (k, v)]), (F.col(code) if isinstance(code, str) else code).cast("int")), F.lit(default))


def fixture_sides(fixtures: DataFrame) -> DataFrame:
    """Each fixture once for either team: ord, event, team, opponent, difficulty, is_home."""
    return fixtures.selectExpr(
        "ord", "event", "stack(2, team_h, team_a, team_h_difficulty, true, team_a, team_h, team_a_difficulty, false) AS (team, opponent, difficulty, is_home)"
    )


def next3_ease(fixtures: DataFrame, gameweek: int = 1, count: int = 3) -> DataFrame:
    """Mean own difficulty of each team's first fixtures, in the source's order, from the gameweek on.

    The rank is cut before the shuffle as well, so a team's fixtures needn't meet in one task.
    """
    sides = fixture_sides(fixtures.where(F.col("event") >= gameweek))
    nth = F.row_number().over(Window.partitionBy("team").orderBy("ord"))
    first = sides.withColumn("nth", nth).where(F.col("nth") <= count)
    return first.groupBy("team").agg((F.sum("difficulty") / F.count("*")).alias("next3_ease"))


def enrich(players: DataFrame, teams: DataFrame, fixtures: DataFrame, advanced: DataFrame, gameweek: int = 1) -> DataFrame:
    """One row per player with all ENRICHED columns; what is missing has its default.

    Teams and their ease are a row per team: Spark broadcasts them while they are small. Advanced statistics are a
    table as large as the players' and join on id by whatever way its size allows.
    """
    t = teams.select(F.col("id").alias("team"), F.col("short_name"))
    ease = next3_ease(fixtures, gameweek)
    stats = advanced.select("id", "xg90", "xa90", "exp_min", "avg_points", "value", "ownership")
    rows = players.join(t, "team", "left").join(ease, "team", "left").join(stats, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.select(
        "id", "ord", F.concat_ws(" ", "first_name", "second_name").alias("name"), F.col("team").alias("team_id"), F.coalesce("short_name", F.lit("UNK")).alias("team_short"), position("element_type").alias("pos"),
        (F.col("now_cost") / 10).alias("price"), number(F.col("form")).alias("form"), "status", zero("xg90"), zero("xa90"), zero("exp_min"), F.coalesce("next3_ease", F.lit(3.0)).alias("next3_ease"), zero("avg_points"), zero("value"), zero("ownership"),
    )


#: The statistics of the current-player view in their order, those that may be missing, and the static attributes.
STATISTICS = [
    "form", "total_points", "points_per_game", "selected_by_percent", "transfers_in", "transfers_out", "value_form", "value_season",
    "influence", "creativity", "threat", "ict_index", "starts", "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded",
    "goals_scored", "assists", "clean_sheets", "goals_conceded", "own_goals", "penalties_saved", "penalties_missed", "yellow_cards", "red_cards",
    "saves", "bonus", "bps", "influence_rank", "creativity_rank", "threat_rank", "ict_index_rank",
]
SET_PIECES = ["corners_and_indirect_freekicks_order", "direct_freekicks_order", "penalties_order"]
STATIC = ["selected_by_percent", "transfers_in", "transfers_out", "value_form", "value_season"]


def static_attributes(players: DataFrame) -> DataFrame:
    """What a player's panel rows share: player_id, name, position, team, price and the five figures of the whole season."""
    return players.select(F.col("id").alias("player_id"), F.concat_ws(" ", "first_name", "second_name").alias("name"), F.col("element_type").alias("position"), "team", (F.col("now_cost") / 10).alias("price"), *STATIC)


def current_players(players: DataFrame, teams: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The current-player view: id, name, position, team, team_name, price, then the named columns (all statistics by default).

    Set-piece orders that players haven't are null.
    """
    if columns is None:
        players = players.select("*", *[F.lit(None).cast("int").alias(c) for c in SET_PIECES if c not in players.columns])
        columns = [*STATISTICS, *SET_PIECES]
    t = teams.select(F.col("id").alias("team"), F.col("name").alias("team_name"))
    rows = players.join(t, "team", "left")
    return rows.select("id", F.concat_ws(" ", "first_name", "second_name").alias("name"), F.col("element_type").alias("position"), "team", F.coalesce("team_name", F.lit("Unknown")).alias("team_name"), (F.col("now_cost") / 10).alias("price"), *columns)
