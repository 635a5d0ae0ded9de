"""Constant relations. The values are fixed: scores and selections depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.scoring import METRICS


def _weights(*values: float) -> dict[str, float]:
    return dict(zip(METRICS, values, strict=True))


#                          form  xg90  xa90  exp_min  next3_ease  avg_points  value  ownership
DEFAULT_WEIGHTS = _weights(0.20, 0.15, 0.15, 0.15, 0.10, 0.15, 0.05, 0.05)
AI_WEIGHTS = _weights(0.25, 0.20, 0.20, 0.15, 0.10, 0.05, 0.03, 0.02)
PRESETS = {
    "Balanced Approach": _weights(0.15, 0.15, 0.15, 0.20, 0.15, 0.15, 0.05, 0.00),
    "Premium Heavy": _weights(0.10, 0.20, 0.20, 0.25, 0.10, 0.10, 0.02, 0.03),
    "Value Optimized": _weights(0.15, 0.15, 0.15, 0.15, 0.10, 0.10, 0.20, 0.00),
    "Form & Fixtures": _weights(0.25, 0.15, 0.10, 0.15, 0.25, 0.05, 0.03, 0.02),
    "Set & Forget": _weights(0.05, 0.15, 0.15, 0.30, 0.05, 0.25, 0.03, 0.02),
}
PRESET_TEXTS = {
    "Balanced Approach": "Well-rounded team focusing on consistent performers across all positions",
    "Premium Heavy": "Invest heavily in proven premium players with guaranteed minutes",
    "Value Optimized": "Maximum points per million - focus on budget enablers and differentials",
    "Form & Fixtures": "Players in hot form with favorable upcoming fixture runs",
    "Set & Forget": "Stable team with minimal transfers - focus on season-long consistency",
}
STRATEGIES = {
    "balanced": _weights(0.15, 0.15, 0.15, 0.20, 0.15, 0.15, 0.05, 0.00),
    "premium": _weights(0.15, 0.25, 0.25, 0.20, 0.05, 0.05, 0.00, 0.05),
    "value": _weights(0.15, 0.15, 0.15, 0.15, 0.10, 0.10, 0.20, 0.00),
    "differential": _weights(0.20, 0.20, 0.15, 0.15, 0.15, 0.10, 0.03, 0.02),
    "form": _weights(0.25, 0.15, 0.10, 0.15, 0.25, 0.05, 0.03, 0.02),
    "template": _weights(0.10, 0.10, 0.10, 0.25, 0.10, 0.20, 0.05, 0.10),
    "setforget": _weights(0.05, 0.15, 0.15, 0.30, 0.05, 0.25, 0.03, 0.02),
    "wildcard": _weights(0.30, 0.20, 0.15, 0.10, 0.20, 0.02, 0.02, 0.01),
}
POSITIONS = {1: "GK", 2: "DEF", 3: "MID", 4: "FWD"}
LABELS = ["perfect", "good", "poor", "urgent", "not-playing"]
#: Starting places of each formation in the order GK, DEF, MID, FWD, and the places of a whole squad.
FORMATIONS = {"3-4-3": (1, 3, 4, 3), "3-5-2": (1, 3, 5, 2), "4-3-3": (1, 4, 3, 3), "4-4-2": (1, 4, 4, 2), "4-5-1": (1, 4, 5, 1), "5-3-2": (1, 5, 3, 2), "5-4-1": (1, 5, 4, 1)}
SQUAD_PLACES = (2, 5, 5, 3)


def weights_frame(spark: SparkSession, sets: dict[str, dict[str, float]], name: str = "strategy") -> DataFrame:
    """A row for each named set of weights, a column w_<metric> for each metric."""
    schema = ", ".join([f"{name} string", *[f"w_{m} double" for m in METRICS]])
    return spark.createDataFrame([(k, *[w[m] for m in METRICS]) for k, w in sets.items()], schema)


def presets_frame(spark: SparkSession) -> DataFrame:
    """The presets with their descriptions."""
    texts = spark.createDataFrame(list(PRESET_TEXTS.items()), "name string, description string")
    return weights_frame(spark, PRESETS, "name").join(texts, "name")


def formations_frame(spark: SparkSession) -> DataFrame:
    rows = [(f, POSITIONS[i + 1], n, SQUAD_PLACES[i]) for f, places in FORMATIONS.items() for i, n in enumerate(places)]
    return spark.createDataFrame(rows, "formation string, pos string, starting int, total int")
