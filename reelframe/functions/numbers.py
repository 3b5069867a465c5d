"""Rounding and integer arithmetic with one meaning everywhere: halves go up, quotients go down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def floor_long(x) -> Column:
    return F.floor(col(x)).cast("long")


def round_half_up(x) -> Column:
    """Nearest whole number of a non-negative value."""
    return F.floor(col(x) + F.lit(0.5)).cast("long")


def round_to(x, places: int) -> Column:
    unit = float(10**places)
    return F.floor(col(x) * F.lit(unit) + F.lit(0.5)) / F.lit(unit)


def div(a, b) -> Column:
    """Whole quotient of non-negative whole numbers, exact beyond 2^53."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return ((a - F.pmod(a, b)) / b).cast("long")


def div_round(a, b) -> Column:
    """Whole quotient, halves up."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return div(a * 2 + b, b * 2)
