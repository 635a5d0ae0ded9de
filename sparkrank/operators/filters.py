"""Point and range selections with checked arguments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .constants import POSITIONS


def whole_number(value: int | str) -> int | None:
    """The whole number that a string begins with, after white space; None where it begins with none."""
    found = re.match(r"\s*([+-]?[0-9]+)", str(value))
    return int(found[1]) if found else None


def by_id(players: DataFrame, id_: int | str) -> DataFrame:
    wanted = whole_number(id_)
    if wanted is None:
        raise ValueError(f"{id_!r} is no player id")
    return players.where(F.col("id") == wanted)


def by_position(players: DataFrame, pos: str) -> DataFrame:
    pos = pos.upper()
    if pos not in POSITIONS.values():
        raise ValueError(f"{pos!r} is no position")
    return players.where(F.col("pos") == pos)


def available(players: DataFrame) -> DataFrame:
    return players.where(F.col("status") == "a")


def by_gameweek(fixtures: DataFrame, gameweek: int) -> DataFrame:
    if gameweek < 1:
        raise ValueError("gameweeks begin with 1")
    return fixtures.where(F.col("event") == gameweek)


def by_team(fixtures: DataFrame, team: int) -> DataFrame:
    if not 1 <= team <= 20:
        raise ValueError("teams are 1 to 20")
    return fixtures.where((F.col("team_h") == team) | (F.col("team_a") == team))


def affordable(predictions: DataFrame, budget: float, excluded: list[int] = (), least: int = 11) -> DataFrame:
    """Predictions within the budget and not excluded; too few of them are an error."""
    kept = predictions.where(F.col("price") <= budget)
    if excluded:
        kept = kept.where(~F.col("player_id").isin(*excluded))
    if len(kept.select("player_id").take(least)) < least:
        raise ValueError(f"fewer than {least} players are left")
    return kept
