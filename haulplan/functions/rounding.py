"""Rounding that any IEEE engine repeats bit for bit."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value, digits: int = 0) -> Column:
    """Half-up rounding to ``digits`` decimals as floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(F.lit(value) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
