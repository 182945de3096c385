"""Exact rounding: half to even of a double's own value, as decimal arithmetic gives it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPLIT = 134217729.0  # 2**27 + 1


def _halves(value: float) -> tuple[float, float]:
    high = value * _SPLIT - (value * _SPLIT - value)
    return high, value - high


def rounded(x: Column, digits: int) -> Column:
    """x to so many places. Where x times the power of ten seems to lie half-way, the product's own error, which two
    halves of each factor give exactly, says on which side it is; only a true tie goes to the even neighbour."""
    x, power = x.cast("double"), 10.0**digits
    high, low = _halves(power)
    product, up = x * power, x * _SPLIT
    x_high = up - (up - x)
    x_low = x - x_high
    error = ((x_high * high - product) + x_high * low + x_low * high) + x_low * low
    below = F.floor(product).cast("double")
    tie = product - below == 0.5
    return F.when(tie & (error > 0), below + 1).when(tie & (error < 0), below).otherwise(F.rint(product)) / power


def rounded_sql(x: str, digits: int) -> str:
    """rounded() as DuckDB SQL."""
    power = 10.0**digits
    high, low = _halves(power)
    parts = f"list_transform([({x})::DOUBLE], lambda v: {{'y': v * {power!r}::DOUBLE, 'h': v * {_SPLIT!r}::DOUBLE - (v * {_SPLIT!r}::DOUBLE - v), 'l': v - (v * {_SPLIT!r}::DOUBLE - (v * {_SPLIT!r}::DOUBLE - v))}})"
    whole = f"list_transform({parts}, lambda s: {{'y': s.y, 'f': floor(s.y), 'e': ((s.h * {high!r}::DOUBLE - s.y) + s.h * {low!r}::DOUBLE + s.l * {high!r}::DOUBLE) + s.l * {low!r}::DOUBLE}})"
    return f"list_transform({whole}, lambda s: CASE WHEN s.y - s.f = 0.5 AND s.e > 0 THEN s.f + 1 WHEN s.y - s.f = 0.5 AND s.e < 0 THEN s.f ELSE round_even(s.y, 0) END / {power!r}::DOUBLE)[1]"
