"""Numeric helpers.

``F.round`` on a double rounds half-up on the shortest decimal string
(81.49375 -> 81.4938) although the stored binary value is below the tie.
``fround`` rounds the double itself: ``x * 10^p`` half away from zero, then
back, which agrees with Python's ``round`` except on exact binary ties and
with common SQL engines everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fround(c, digits: int = 0) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    m = float(10 ** digits)
    rounded = F.signum(x) * F.floor(F.abs(x) * F.lit(m) + F.lit(0.5)) / F.lit(m)
    return F.when(F.abs(x) * F.lit(m) < F.lit(float(1 << 53)), rounded).otherwise(x).alias(
        c if isinstance(c, str) else "fround")


def fdigits(x: Column, digits: int = 14) -> Column:
    """The double nearest to ``x`` written with ``digits`` significant digits:
    takes the float noise out of a short sum of decimal values, at any scale."""
    p = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    m = F.pow(F.lit(10.0), p)
    return F.when((p >= 0) & (p <= 22), F.rint(x * m) / m).otherwise(x)
