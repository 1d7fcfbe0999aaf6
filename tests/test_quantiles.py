import numpy as np
import pytest

from newsgraph.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def column(kind, n, rng):
    if kind == "spread":
        return rng.normal(size=n) * 10.0 ** rng.integers(-5, 5, n)
    if kind == "heavy":  # two values hold nearly all rows, the rest lies between them
        return np.where(rng.random(n) < 0.5, 1.0, np.where(rng.random(n) < 0.9, 2.0, 1 + rng.random(n)))
    if kind == "one":
        return np.full(n, 3.5)
    return rng.integers(0, 5, n).astype(float)


@pytest.mark.parametrize("limit", [10, 300, 1_000_000])
def test_equals_numpy(spark, limit):
    rng = np.random.default_rng(5)
    data = {k: column(k, 5001, rng) for k in ("spread", "heavy", "one", "ties")}
    rows = list(zip(*[v.tolist() for v in data.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in data))
    got = exact_quantiles(df, list(data), SHARES, direct_rows=limit)
    for k, v in data.items():
        assert got[k] == pytest.approx(np.quantile(v, SHARES).tolist(), rel=1e-12, abs=1e-12), k


def test_gaps_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (4.0, None)],
                               "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.5], "b": None}
