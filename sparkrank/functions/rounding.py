"""Rounding and number parsing with the rules of the scores' source language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounds to `digits` decimals, halves towards plus infinity (so -2.5 gives -2 at 0 digits)."""
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def number(text: Column) -> Column:
    """The number a string begins with, 0 for none; null gives 0."""
    prefix = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(prefix.try_cast("double"), F.lit(0.0))


def finite(x: Column) -> Column:
    """x with null, NaN and infinities as 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def confidence(points: Column) -> Column:
    """How far a prediction is trusted: less for higher ones, between .3 and .95."""
    return clamp(F.lit(0.8) - points * F.lit(0.02), 0.3, 0.95)
