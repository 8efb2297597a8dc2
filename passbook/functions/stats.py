"""Statistics from exact sums: engines that agree on the sums agree on the last bit of the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double(c: Column) -> Column:
    return c.cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; 0 unless den > 0."""
    return F.when(double(den) > 0, double(num) / double(den)).otherwise(F.lit(0.0))


def variance(n: Column, s: Column, ss: Column) -> Column:
    """Population variance of n values with sum s and sum of squares ss; null without values."""
    n, s, ss = double(n), double(s), double(ss)
    return F.when(n > 0, F.greatest(ss / n - (s / n) * (s / n), F.lit(0.0)))


def slope(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> Column:
    """Least-squares slope; 0 for under two rows or without variation in x."""
    n, sx, sy, sxx, sxy = (double(c) for c in (n, sx, sy, sxx, sxy))
    den = n * sxx - sx * sx
    return F.when((n >= 2) & (den > 0), (n * sxy - sx * sy) / den).otherwise(F.lit(0.0))
