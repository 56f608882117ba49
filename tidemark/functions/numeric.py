"""Numbers as Column builders: rates, clamps, weights and back-off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, half-even; 0 when there is no whole."""
    return F.when(whole > 0, F.bround(part * F.lit(100.0) / whole, 1)).otherwise(F.lit(0.0))


def clamp(value: Column, low: float, high: float, default: float | None = None) -> Column:
    value = value if default is None else F.coalesce(value, F.lit(default))
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def or_else(value: Column, other: Column) -> Column:
    """value, unless it is null or 0."""
    return F.coalesce(F.nullif(value, F.lit(0)), other)


def to_int(value: Column) -> Column:
    """An integer, or 0 for what isn't one."""
    return F.coalesce(value.try_cast("int"), F.lit(0))


def severity(value: Column) -> Column:
    """A severity name, as it stands but for its case, or a number as 1 to 5; anything else is 1."""
    names = {"low": 1, "medium": 3, "high": 4, "critical": 5}
    text = F.lower(value.cast("string"))
    known = F.coalesce(*(F.when(text == k, F.lit(v)) for k, v in names.items()), F.regexp_replace(text, r"(?U)^\s+|\s+$", "").try_cast("int"), F.lit(1))
    return F.least(F.lit(5), F.greatest(F.lit(1), known)).cast("int")


def location_confidence(score: Column, ambiguous: Column, on_change: Column) -> Column:
    """A match's score, worth 0.7 of it if ambiguous and 0.5 if off the change."""
    return clamp(score * F.when(ambiguous, 0.7).otherwise(1.0) * F.when(on_change, 1.0).otherwise(0.5), 0.0, 1.0)


def retry_delay(attempts: Column, base: int = 30, most: int = 900, limit: int = 3) -> Column:
    """Seconds until the next try: doubled each time up to a most; null when none is left."""
    return F.when(attempts < limit, F.least(F.lit(most), (base * F.pow(F.lit(2), F.greatest(F.lit(0), attempts - 1))).cast("int")))


def weighted_mean(value: Column, weight: Column, how: str = "round") -> Column:
    """An aggregate: the mean by weight, 0 without weight. how: round (half-even) or floor."""
    mean = F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0))
    whole = F.bround(mean, 0) if how == "round" else F.floor(mean)
    return F.coalesce(whole.cast("int"), F.lit(0))
