"""Small helpers that steer where and how often an expression runs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def once(c: Column) -> Column:
    """``c``, computed once per row.

    The optimizer copies a deterministic expression into every later filter and
    generator that mentions it, which for a costly regex multiplies the work.
    The condition here always holds but is not deterministic, so it stays in place.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)
