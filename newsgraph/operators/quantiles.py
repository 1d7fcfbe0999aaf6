"""Exact quantiles of whole columns without sorting a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 10_000


@dataclass
class _Search:
    """The value at ``rank`` among those of ``column`` strictly between ``low`` and ``high``."""
    column: str
    rank: int
    size: int
    low: float = -math.inf
    high: float = math.inf
    value: float | None = None

    def inside(self) -> Column:
        c = F.col(self.column)
        held = c.isNotNull()
        if self.low > -math.inf:
            held = held & (c > self.low)
        if self.high < math.inf:
            held = held & (c < self.high)
        return F.when(held, c)

    def narrow(self, a: float, b: float, below: int, at_a: int, between: int, at_b: int) -> None:
        """Keeps the part that holds the rank, given the counts around two of the values."""
        for count, low, high in ((below, self.low, a), (at_a, a, a), (between, a, b), (at_b, b, b),
                                 (self.size, b, self.high)):
            if self.rank < count:
                break
            self.rank -= count
            self.size -= count
        if low == high:
            self.value = low
        else:
            last = high == self.high and low == b
            self.low, self.high, self.size = low, high, self.size if last else count


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    direct_rows: int = 1_000_000) -> dict[str, list[float] | None]:
    """Linear-interpolated quantiles per column; None where a column has no values.

    Each wanted rank is narrowed until at most ``direct_rows`` values are left around it:
    ``percentile_approx``, whose state is bounded, gives two values close around the rank, and a
    count decides on which side of them it lies. A round cuts the values left by three
    orders of magnitude; a short column needs none. What is left goes to an exact aggregate.
    """
    if not columns:
        return {}
    data = df.select(*[F.when(~F.isnan(c), F.col(c)).cast("double").alias(c) for c in columns])
    counts = data.agg(*[F.count(c).alias(c) for c in columns]).first()
    result: dict[str, list[float] | None] = {c: None for c in columns}
    searches = {}
    for c in columns:
        for p in probabilities if counts[c] else ():
            at = p * (counts[c] - 1)
            for r in (math.floor(at), math.ceil(at)):
                searches.setdefault((c, r), _Search(c, r, counts[c]))
    _select(data, list(searches.values()), direct_rows)
    for c in columns:
        if counts[c]:
            result[c] = []
            for p in probabilities:
                at = p * (counts[c] - 1)
                a, b = searches[c, math.floor(at)].value, searches[c, math.ceil(at)].value
                result[c].append(a + (b - a) * (at - math.floor(at)))
    return result


def _select(data: DataFrame, searches: list[_Search], direct_rows: int) -> None:
    while True:
        wide = [s for s in searches if s.value is None and s.size > direct_rows]
        if not wide:
            break
        sketch = []
        for i, s in enumerate(wide):
            at = s.rank / (s.size - 1)
            sketch.append(F.percentile_approx(s.inside(), [max(at - 2 / ACCURACY, 0.0),
                                                           min(at + 2 / ACCURACY, 1.0)], ACCURACY).alias(str(i)))
        near = data.agg(*sketch).first()
        counts = []
        for i, s in enumerate(wide):
            (a, b), x = near[str(i)], s.inside()
            counts += [F.count_if(x < a).alias(f"{i}l"), F.count_if(x == a).alias(f"{i}a"),
                       F.count_if((x > a) & (x < b)).alias(f"{i}m"),
                       F.count_if((x == b) & F.lit(a < b)).alias(f"{i}b")]
        row = data.agg(*counts).first()
        for i, s in enumerate(wide):
            s.narrow(*near[str(i)], *(row[f"{i}{k}"] for k in "lamb"))
    rest = [s for s in searches if s.value is None]
    if rest:
        # the discrete percentile at the middle of a rank's share is the value of that rank
        inner = data.select(*[s.inside().alias(f"v{i}") for i, s in enumerate(rest)])
        row = inner.agg(*[F.expr(f"percentile_disc({(s.rank + 0.5) / s.size!r}D) WITHIN GROUP (ORDER BY v{i})")
                          .alias(str(i)) for i, s in enumerate(rest)]).first()
        for i, s in enumerate(rest):
            s.value = row[str(i)]
