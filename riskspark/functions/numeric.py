"""Rounding and percentile helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value: Column, digits: int) -> Column:
    """Round half up in plain double arithmetic, so that other engines give the same last digit."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """numerator / denominator, 0 where the denominator is 0."""
    quotient = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return rnd(F.coalesce(quotient, F.lit(0.0)), digits)


def first_nonzero(*values: Column) -> Column:
    """The first value that is neither null nor 0, else 0."""
    zero = F.lit(0)
    return F.coalesce(*[F.nullif(value, zero.cast("decimal(18,2)")) for value in values], zero.cast("decimal(18,2)"))


def micros(timestamp: Column) -> Column:
    """Microseconds since the epoch of a timestamp (session time zone UTC)."""
    return F.unix_micros(timestamp.cast("timestamp"))
