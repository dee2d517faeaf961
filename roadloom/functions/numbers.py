"""Rounding, clipping and ratios with the null rules that the analytics need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity: floor(x * 10^digits + 0.5) / 10^digits."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounds halves to the even neighbour."""
    return F.bround(x, digits)


def clip(x: Column, low: float, high: float) -> Column:
    """The value within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def per_at_least(numerator: Column, denominator: Column, least: float = 1.0) -> Column:
    """The ratio with a denominator of `least` at least; null where either part is null."""
    return F.when(denominator.isNotNull(), numerator / F.greatest(denominator, F.lit(least)))


def interpolate(x: Column, xs: list[float], ys: list[float], low: float | None = None, high: float | None = None) -> Column:
    """Linear interpolation between the points, constant beyond them; clipped where bounds are given."""
    value = F.lit(float(ys[-1]))
    for x0, x1, y0, y1 in list(zip(xs, xs[1:], ys, ys[1:], strict=False))[::-1]:
        value = F.when(x < x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(value)
    value = F.when(x.isNull(), None).when(x <= xs[0], F.lit(float(ys[0]))).otherwise(value)
    return clip(value, low, high) if low is not None and high is not None else value
