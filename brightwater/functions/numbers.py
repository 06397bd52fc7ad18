"""Rounding rules of the systems whose results are matched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up_half(value: Column, digits: int) -> Column:
    """Halves go towards plus infinity."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def whole_average(total: Column, count: Column) -> Column:
    """Average of non-negative integers as an integer, halves away from zero, computed exactly."""
    return F.call_function("div", total * 2 + count, F.nullif(count * 2, F.lit(0)))


def percent(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole rounded half up to ``digits``, in exact integer steps; null if whole is 0."""
    scale = 10**digits
    units = F.call_function(
        "div", part * (200 * scale) + whole, F.nullif(whole * 2, F.lit(0))
    )
    return units / float(scale)
