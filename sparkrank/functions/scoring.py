"""Weighted scores and labels of players."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_up

#: The metrics that weights name, in the order in which they are summed.
METRICS = ["form", "xg90", "xa90", "exp_min", "next3_ease", "avg_points", "value", "ownership"]


def normalised(metric: str) -> Column:
    """A metric on the scale 0 to 10; missing values count as 0."""
    x = F.coalesce(F.col(metric).cast("double"), F.lit(0.0))
    capped = {"form": 2.0, "xg90": 20.0, "xa90": 25.0, "avg_points": 0.5, "value": 2.0}
    if metric in capped:
        return F.least(x * F.lit(capped[metric]), F.lit(10.0))
    if metric == "exp_min":
        return x / F.lit(90.0) * F.lit(10.0)
    if metric == "next3_ease":
        return (F.lit(6.0) - x) * F.lit(2.0)
    return x / F.lit(10.0)


def score(weights: Mapping[str, float] | Callable[[str], Column]) -> Column:
    """The weighted sum over METRICS to two decimals. weights: by metric (a missing one is 0), or their columns."""
    weight = weights if callable(weights) else lambda m: F.lit(float(weights.get(m, 0.0)))
    total = normalised(METRICS[0]) * weight(METRICS[0])
    for metric in METRICS[1:]:
        total = total + normalised(metric) * weight(metric)
    return half_up(total)


def label(score_: Column, status: Column) -> Column:
    """What to do with a player: one who can't play first, then by score."""
    return F.when(status.isin("i", "s", "d"), "not-playing").when(score_ >= 8, "perfect").when(score_ >= 6, "good").when(score_ >= 4, "poor").otherwise("urgent")


def level(score_: Column) -> Column:
    """The label by score alone, as lists of players show it."""
    return F.when(score_ >= 8, "Excellent").when(score_ >= 6, "Good").when(score_ >= 4, "Average").otherwise("Poor")


def normalised_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights over their sum, unless that is 0."""
    total = sum(float(weights.get(m, 0.0)) for m in METRICS)
    return {m: float(weights.get(m, 0.0)) / total if total else float(weights.get(m, 0.0)) for m in METRICS}
