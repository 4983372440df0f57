"""Numeric column functions. Missing stays missing: a guard yields NULL, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """``num / den * scale`` where the denominator is positive, else NULL."""
    return F.when(den > 0, num * F.lit(scale) / den)


def ratio_or_null(num: Column, den: Column) -> Column:
    """``num / den`` with a zero denominator read as missing."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def log_positive(value: Column) -> Column:
    return F.when(value > 0, F.ln(value))


def zero_to_null(names: list[str]) -> dict[str, Column]:
    """Rates that were published as zero when they were not measured."""
    return {n: F.nullif(F.col(n), F.lit(0).cast("double")) for n in names}


def clean_double(value: Column) -> Column:
    """Text to double: decimal comma accepted, unreadable text and NaN become NULL."""
    number = F.replace(value.cast("string"), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(number), number)


def is_distinct(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def relative_gap(got: Column, expected: Column, floor: float = 1.0) -> Column:
    return F.abs(got - expected) / F.greatest(F.abs(expected), F.lit(floor))
