"""Rounding to decimals by the exact binary value of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a double into two halves of 26 bits each.
SPLITTER = 134217729.0


def round_exact(value: Column, digits: int) -> Column:
    """Nearest multiple of 10^-digits to the exact value, halves to even.

    ``round`` works on the shortest decimal text of a double, so 0.123455, which is stored slightly below its
    text, would go up. Here the part of value × 10^digits that a double cannot hold is added back.
    """
    if not 0 <= digits <= 7:
        raise ValueError("digits must be between 0 and 7")
    factor = F.lit(float(10**digits))
    scaled = value * factor
    spread = value * SPLITTER
    upper = spread - (spread - value)
    lost = (upper * factor - scaled) + (value - upper) * factor
    below = F.floor(scaled)
    above_half = (scaled - below - 0.5) + lost
    up = (above_half > 0) | ((above_half == 0) & (F.pmod(below, F.lit(2)) == 1))
    return (below + F.when(up, 1).otherwise(0)) / factor
