"""Rounding of single results on the driver."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal


def half_up(x: float, places: int) -> float:
    """Rounding of the shortest decimal form, halves away from zero, as Spark's ``round`` does it."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
