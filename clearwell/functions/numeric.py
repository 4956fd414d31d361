"""Numeric expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_FORMULAS: dict[str, Callable[[Column], Column]] = {
    "fahrenheit_to_celsius": lambda c: (c - 32) * 5 / 9,
    "celsius_to_fahrenheit": lambda c: c * 9 / 5 + 32,
    "celsius_to_kelvin": lambda c: c + 273.15,
    "psi_to_bar": lambda c: c * 0.0689475729,
    "miles_to_km": lambda c: c * 1.609344,
    "pounds_to_kg": lambda c: c * 0.45359237,
}


def clamp(c: Column, low: object, high: object) -> Column:
    """Keep a value within bounds; null stays null although least/greatest skip nulls."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of the same length, in double precision."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def uniform(seed: int, *key: Column) -> Column:
    """A uniform draw in (0, 1). With a row key it depends on that key only, so a lost task repeats it."""
    if not key:
        return F.rand(seed)
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def laplace_noise(scale: float, u: Column) -> Column:
    """Laplace(0, scale) by the inverse distribution function of a uniform draw ``u``."""
    centred = u - 0.5
    tail = F.greatest(1 - 2 * F.abs(centred), F.lit(1e-300))
    return F.lit(-scale) * F.signum(centred) * F.ln(tail)


def missing(c: Column, dtype: str) -> Column:
    """Null, or NaN in a floating column."""
    return c.isNull() | F.isnan(c) if dtype in ("float", "double") else c.isNull()


def present(c: Column, dtype: str) -> Column:
    """The value with NaN turned into null."""
    return F.when(~F.isnan(c), c) if dtype in ("float", "double") else c
