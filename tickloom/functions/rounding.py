"""Rounding of binary numbers by their exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double's 53 bits in two halves.
_HALVES = float(2**27 + 1)


def rounded(x: Column, digits: int = 1) -> Column:
    """x to `digits` decimals (0 to 6): the nearest, judged by the exact value that the double has; of two equally near the even one.
    So 24350.05, whose double lies below it, is 24350.0. Null stays null; doubles of 2 ** 52 units of the last decimal are rounded already.

    The product with a power of ten is itself rounded and may land on a half. Then its error, which both halves of x give exactly,
    says on which side of that half the true product lies.
    """
    by = float(10**digits)
    x = x.cast("double")
    wide = x * _HALVES
    high = wide - (wide - x)
    product = x * by
    error = (high * by - product) + (x - high) * by
    down = F.floor(product).cast("double")
    half = (product - down == 0.5) & (error != 0.0)
    whole = F.when(half, F.when(error > 0.0, down + 1.0).otherwise(down)).otherwise(F.rint(product))
    return F.when(F.abs(product) >= 2.0**52, x).otherwise(whole / by)
