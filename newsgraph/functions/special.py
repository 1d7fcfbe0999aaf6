"""Log-gamma and its derivatives as column expressions (Spark has none)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How far arguments are shifted up before the asymptotic series
SHIFT = 8


def _series(x: Column, terms: list[tuple[float, int]]) -> Column:
    out = F.lit(0.0)
    for coefficient, power in terms:
        out = out + F.lit(coefficient) / F.pow(x, F.lit(power))
    return out


def lgamma(x: Column) -> Column:
    """log Gamma for x > 0: recurrence to x + 8, then Stirling's series."""
    y = x + SHIFT
    product = x
    for i in range(1, SHIFT):
        product = product * (x + i)
    tail = _series(y, [(1 / 12, 1), (-1 / 360, 3), (1 / 1260, 5), (-1 / 1680, 7), (1 / 1188, 9)])
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + tail - F.log(product)


def digamma(x: Column) -> Column:
    y = x + SHIFT
    below = F.lit(0.0)
    for i in range(SHIFT):
        below = below + 1 / (x + i)
    tail = _series(y, [(1 / 12, 2), (-1 / 120, 4), (1 / 252, 6), (-1 / 240, 8), (1 / 132, 10)])
    return F.log(y) - 1 / (2 * y) - tail - below


def trigamma(x: Column) -> Column:
    y = x + SHIFT
    below = F.lit(0.0)
    for i in range(SHIFT):
        below = below + 1 / ((x + i) * (x + i))
    tail = _series(y, [(1 / 6, 3), (-1 / 30, 5), (1 / 42, 7), (-1 / 30, 9), (5 / 66, 11)])
    return 1 / y + 1 / (2 * y * y) + tail + below
