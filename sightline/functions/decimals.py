"""Fixed-point text of doubles, rounded by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A double times this, less itself, splits it into two halves of 26 bits whose products with small whole numbers are exact.
SPLIT = 134_217_729.0


def fixed(x: Column, decimals: int = 6) -> Column:
    """Text with so many decimals (6 at most), for numbers below 10^9 in size: to the nearest, an exact half to the even neighbour, as C's printf gives it.

    Twice the scaled number is taken as a rounded product and its exact error. Only where the product is an odd whole number do the two
    neighbours lie equally near, and then the error's sign decides. Larger, infinite and NaN numbers take the form that `format_string` gives.
    """
    if not 0 < decimals <= 6:
        raise ValueError("one to six decimals")
    unit = 10**decimals
    a = F.abs(x)
    high = a * SPLIT - (a * SPLIT - a)
    twice = a * (2.0 * unit)
    error = (high * (2.0 * unit) - twice) + (a - high) * (2.0 * unit)
    below = F.floor(twice / 2).cast("long")
    half = twice == (2 * below + 1).cast("double")
    up = F.when(half & (error != 0), error > 0).when(half, below % 2 == 1).otherwise(twice - 2 * below > 1)
    n = below + up.cast("long")
    # the sign of a negative number stays, also where nothing else of it does; the text of -0.0 begins with it too
    sign = F.when((x < 0) | ((x == 0) & (x.cast("string") == "-0.0")), "-").otherwise("")
    text = F.concat(sign, F.floor(n / unit).cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), decimals, "0"))
    return F.when(a < 1e9, text).otherwise(F.format_string(f"%.{decimals}f", x))
