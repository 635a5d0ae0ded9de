"""Made-up advanced statistics, the same at every run: each value is a hash of the player and the column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(key: Column, salt: str) -> Column:
    """A number from 0 to below 1."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(2.0**32)


def advanced(players: DataFrame) -> DataFrame:
    """xg90 below .8, xa90 below .6, whole minutes below 90, 2 to 17 points, points by price, ownership below 100."""
    id_ = F.col("id")
    rows = players.select("id", (uniform(id_, "xg90") * 0.8).alias("xg90"), (uniform(id_, "xa90") * 0.6).alias("xa90"), F.floor(uniform(id_, "exp_min") * 90).cast("double").alias("exp_min"), (uniform(id_, "avg_points") * 15 + 2).alias("avg_points"), (uniform(id_, "price") * 10 + 4).alias("p"), (uniform(id_, "ownership") * 100).alias("ownership"))
    return rows.select("id", "xg90", "xa90", "exp_min", "avg_points", (F.col("avg_points") / F.col("p")).alias("value"), "ownership")
