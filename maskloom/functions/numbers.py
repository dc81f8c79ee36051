"""Rounding, clamping and coercion columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of booleans.
TRUE_WORDS = ["1", "true", "on", "yes", "y"]
FALSE_WORDS = ["0", "false", "off", "no", "n"]


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even, as the source domain does everywhere."""
    return F.bround(value, digits)


def clip(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 0.0, not NULL, on an empty denominator."""
    ratio = numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")
    return F.coalesce(ratio, F.lit(0.0))


def percent_to_u8(percent: Column) -> Column:
    """Confidence percentage to the 0..255 scale: clamp, then half-even."""
    return half_even(clip(percent.cast("int"), 0, 100) / F.lit(100.0) * F.lit(255.0)).cast("int")


def confidence_u8(probability: Column) -> Column:
    return clip(half_even(probability * F.lit(255.0)), 0.0, 255.0).cast("smallint")


def truthy(text: Column, default: bool | None = None) -> Column:
    word = F.lower(F.trim(text.cast("string")))
    if default is None:
        return F.coalesce(word.isin(TRUE_WORDS), F.lit(False))
    return (
        F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False).otherwise(F.lit(default))
    )


def clamp_or_default(text: Column, low: float, high: float, default: float) -> Column:
    """Parse a number, fall back to ``default`` when it does not parse, clamp to the bounds."""
    number = F.coalesce(text.cast("string").try_cast("double"), F.lit(float(default)))
    return clip(number, float(low), float(high))


def csv_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")


def csv_numbers(text: Column, kind: str, low, high) -> Column:
    """Comma list to an array of distinct in-range numbers, in order of appearance."""
    parsed = F.transform(csv_tokens(text), lambda t: t.try_cast("double").cast(kind))
    return F.array_distinct(
        F.filter(parsed, lambda v: v.isNotNull() & (v >= F.lit(low)) & (v <= F.lit(high)))
    )
