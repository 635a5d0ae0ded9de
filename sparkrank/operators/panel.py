"""The player-by-gameweek panel: live statistics, static attributes and fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .enrich import fixture_sides


def panel(live: DataFrame, static: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Live rows of known players with their attributes (static columns win name clashes) and their fixture.

    Of a team's fixtures in a gameweek the last in the source's order counts; without one, difficulty 3 at home.
    """
    columns = [c for c in live.columns if c == "player_id" or c not in static.columns]
    rows = live.select(*columns).join(static, "player_id")
    sides = fixture_sides(fixtures).groupBy(F.col("event").alias("gameweek"), "team").agg(F.max_by("difficulty", "ord").alias("difficulty"), F.max_by("is_home", "ord").alias("is_home"))
    joined = rows.join(sides, ["gameweek", "team"], "left")
    return joined.select(*[c for c in rows.columns], F.coalesce(sides["difficulty"], F.lit(3)).alias("fixture_difficulty"), F.coalesce(sides["is_home"], F.lit(True)).alias("is_home"))


def between(panel_: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """The gameweeks from start to end (the last by default); on a panel stored by gameweek only their folders are read."""
    rows = panel_.where(F.col("gameweek") >= start)
    return rows if end is None else rows.where(F.col("gameweek") <= end)


def summary(panel_: DataFrame) -> DataFrame:
    return panel_.agg(F.count("*").alias("n_rows"), F.min("gameweek").alias("first_gameweek"), F.max("gameweek").alias("last_gameweek"), F.countDistinct("player_id").alias("n_players"))


def split_gameweeks(panel_: DataFrame, share: float = 0.8) -> DataFrame:
    """A row per gameweek: its place in order and whether it is one of the first `share` that train.

    Gameweeks are few whatever the panel's size, so ordering them in one task is no limit.
    """
    weeks = panel_.select("gameweek").distinct()
    place = F.row_number().over(Window.orderBy("gameweek"))
    numbered = weeks.select("gameweek", place.alias("place"))
    total = numbered.agg(F.count("*").alias("n"))
    return numbered.join(F.broadcast(total)).select("gameweek", "place", (F.col("place") <= F.floor(F.col("n") * F.lit(share))).alias("train"))  # one row


def time_folds(panel_: DataFrame, folds: int = 5) -> DataFrame:
    """Expanding folds over the gameweeks in order: fold (from 1), gameweek and whether it trains.

    The test weeks of the folds follow each other, weeks // (folds + 1) of them each, up to the last; all weeks before them train. Fewer weeks
    than folds + 1 are an error.
    """
    weeks = sorted(r["gameweek"] for r in panel_.select("gameweek").distinct().collect())  # as few as there are gameweeks
    size = len(weeks) // (folds + 1)
    if not size:
        raise ValueError(f"{len(weeks)} gameweeks are too few for {folds} folds")
    begins = [len(weeks) - (folds - k) * size for k in range(folds)]
    rows = [(k + 1, w, i < begin) for k, begin in enumerate(begins) for i, w in enumerate(weeks[: begin + size])]
    return panel_.sparkSession.createDataFrame(rows, "fold int, gameweek int, train boolean")
