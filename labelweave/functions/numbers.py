"""Numeric column expressions with the null rules used throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text forms accepted as a number.
NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def finite(value: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(is_finite(value), value)


def ratio(numerator: Column, denominator: Column, empty: float = 0.0) -> Column:
    """Division that returns ``empty`` for a zero denominator."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(quotient, F.lit(float(empty)))


def entropy(*probabilities: Column) -> Column:
    """Shannon entropy in nats; a zero probability adds nothing."""
    total = F.lit(0.0)
    for p in probabilities:
        total = total - F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))
    return total
