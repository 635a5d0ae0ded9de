"""Display strings of numbers, labels and formations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_up


def _short(x: Column) -> Column:
    """One decimal, none if it is 0."""
    rounded = half_up(x, 1)
    return F.when(rounded == F.floor(rounded), F.format_string("%.0f", rounded)).otherwise(F.format_string("%.1f", rounded))


def price(x: Column) -> Column:
    return F.concat(F.lit("£"), _short(x), F.lit("m"))


def points(x: Column) -> Column:
    return _short(x)


def delta(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), _short(x))


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def minutes(x: Column) -> Column:
    return F.concat(x.cast("string"), F.lit("min"))


def difficulty(x: Column) -> Column:
    return F.when(x <= 2, "Easy").when(x <= 3, "Medium").otherwise("Hard")


def label_text(label: Column) -> Column:
    names = {"perfect": "Perfect", "good": "Good", "poor": "Poor", "urgent": "Urgent", "not-playing": "Not Playing"}
    out = F.when(F.lit(False), "")
    for key, text in names.items():
        out = out.when(label == key, text)
    return out.otherwise("Unknown")


def formation(n: Column, gk: Column, defenders: Column, mids: Column, forwards: Column) -> Column:
    """D-M-F of a valid eleven, else Invalid."""
    valid = (n == 11) & (gk == 1) & defenders.between(3, 5) & mids.between(3, 5) & forwards.between(1, 3)
    return F.when(valid, F.format_string("%d-%d-%d", defenders, mids, forwards)).otherwise("Invalid")


def iso_time(moment: Column) -> Column:
    """A moment of UTC as 2024-01-31T12:00:00.000Z."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stamped_name(prefix: str, moment: Column, suffix: str = ".csv") -> Column:
    """A file name that sorts by time: <prefix>_20240131_120000.csv."""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(moment, "yyyyMMdd_HHmmss"), F.lit(suffix))
