"""Scores of many players at once, and what is summed up from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .constants import DEFAULT_WEIGHTS, LABELS, POSITIONS, weights_frame


def scored(players: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Adds score and label."""
    rows = players.withColumn("score", scoring.score(weights))
    return rows.withColumn("label", scoring.label(F.col("score"), F.col("status")))


def scored_by_sets(players: DataFrame, sets: Mapping[str, Mapping[str, float]], name: str = "strategy") -> DataFrame:
    """Every player under every named set of weights in one pass: a row per player and set."""
    weights = weights_frame(players.sparkSession, dict(sets), name)
    rows = players.join(F.broadcast(weights))  # a row per set of weights
    return rows.withColumn("score", scoring.score(lambda m: F.col(f"w_{m}"))).drop(*[f"w_{m}" for m in scoring.METRICS])


def summed_up(players: DataFrame, sets: Mapping[str, Mapping[str, float]], name: str = "strategy") -> DataFrame:
    """For each named set of weights: n_players, n_good (a score of 6 or more) and best_score over all players."""
    return scored_by_sets(players, sets, name).groupBy(name).agg(F.count("*").alias("n_players"), F.count_if(F.col("score") >= 6).alias("n_good"), F.max("score").alias("best_score"))


def top_contributions(players: DataFrame, sets: Mapping[str, Mapping[str, float]], name: str = "strategy", k: int = 3) -> DataFrame:
    """For each named set of weights the k metrics that add most to all players' scores: rank, metric, weight, contribution.

    Metrics are summed once, in whole ten-thousandths, so the sums are exact; weights come after. Ties keep the metrics' order.
    """
    sums = players.agg(*[F.coalesce(F.sum(F.floor(scoring.normalised(m) * 10000 + 0.5)), F.lit(0)).alias(m) for m in scoring.METRICS])
    rows = weights_frame(players.sparkSession, dict(sets), name).join(F.broadcast(sums))  # one row of sums
    entry = lambda i, m: F.struct((-(F.col(m) * F.col(f"w_{m}") / 10000)).alias("k"), F.lit(i).alias("i"), F.lit(m).alias("metric"), F.col(f"w_{m}").alias("weight"))
    best = F.slice(F.array_sort(F.array(*[entry(i, m) for i, m in enumerate(scoring.METRICS)])), 1, k)
    rows = rows.select(name, F.posexplode(best).alias("at", "e"))
    return rows.select(name, (F.col("at") + 1).alias("rank"), "e.metric", "e.weight", (-F.col("e.k")).alias("contribution"))


def position_averages(players: DataFrame) -> DataFrame:
    """Mean score by position, all four present, 0 where nobody plays."""
    means = players.where("score IS NOT NULL").groupBy("pos").agg(F.avg("score").alias("mean"))
    every = players.sparkSession.createDataFrame([(p,) for p in POSITIONS.values()], "pos string")
    return every.join(means, "pos", "left").select("pos", F.coalesce("mean", F.lit(0.0)).alias("average_score"))


def label_counts(players: DataFrame) -> DataFrame:
    """How many players have each label, all labels present."""
    every = players.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    counts = players.where("score IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    return every.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def totals(players: DataFrame) -> DataFrame:
    """total_score (nulls as 0), average_score (0 for none) and n in one row."""
    total = F.sum(F.coalesce("score", F.lit(0.0)))
    return players.agg(F.coalesce(total, F.lit(0.0)).alias("total_score"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"), F.count("*").alias("n"))
