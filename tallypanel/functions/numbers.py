"""Guarded arithmetic: no infinities, no division errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 where either is missing or ``whole`` is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def round_half_even(number: Column) -> Column:
    """Nearest integer, ties to the even one."""
    return F.rint(number).cast("long")


def doubling_periods(rate: Column) -> Column:
    """Periods until a value doubles at ``rate`` per period, rounded half-even; 0 if none."""
    # log10 is NULL for arguments <= 0, which ends as 0 like a zero rate does.
    return round_half_even(safe_ratio(F.log10(F.lit(2.0)), F.log10(rate + 1)))


def delta_name(metric: str) -> str:
    """``confirmed`` to ``newConfirmed``."""
    return "new" + metric.capitalize()
