import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgraph.functions.special import digamma, lgamma, trigamma
from newsgraph.operators import regress as R

# The published model table; coef, IRR, lower, upper, p. The p-value of the
# third term is printed as 0.83 but a refit gives 0.831.
PUBLISHED = {
    "Intercept": (0.324, 1.382, 1.044, 1.830, 0.024),
    "Political_Prop": (0.111, 1.117, 0.884, 1.412, 0.353),
    "Economic_Prop": (0.023, 1.024, 0.826, 1.269, 0.830),
    "Health_Prop": (0.047, 1.048, 0.848, 1.296, 0.665),
    "Tone_Overall_Mean": (-0.013, 0.988, 0.947, 1.029, 0.554),
}


def counts(spark, alpha, n=4000, seed=3):
    """Counts with a known mean structure and dispersion."""
    rng = np.random.default_rng(seed)
    x1, x2 = rng.integers(0, 2, n), rng.normal(size=n)
    mu = np.exp(0.7 + 0.4 * x1 - 0.3 * x2)
    y = rng.poisson(mu * rng.gamma(1 / alpha, alpha, n)) if alpha else rng.poisson(mu)
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(y, x1, x2)]
    return spark.createDataFrame(rows, "y int, x1 double, x2 double"), np.column_stack([np.ones(n), x1, x2]), y


def test_special_functions(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 2.5, 10.0, 137.5, 1e5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select(lgamma(F.col("x")), digamma(F.col("x")), trigamma(F.col("x"))).collect()
    for x, (g, d, t) in zip(xs, rows):
        assert g == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-11)
        h = 1e-4 * x
        slope = (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)
        assert d == pytest.approx(slope, rel=1e-4, abs=1e-4)
        assert t > 0
    by_x = {x: r for x, r in zip(xs, rows)}
    assert by_x[1.0][1] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert by_x[1.0][2] == pytest.approx(math.pi ** 2 / 6, abs=1e-11)


def test_poisson_meets_its_score_equations(spark):
    df, x, y = counts(spark, 0.0)
    fit = R.poisson(df, "y", ["x1", "x2"])
    mu = np.exp(x @ np.array(fit.coef))
    assert np.abs(x.T @ (y - mu)).max() < 1e-4
    assert fit.se == pytest.approx(np.sqrt(np.diag(np.linalg.inv(x.T @ (x * mu[:, None])))).tolist(), rel=1e-6)


def test_negative_binomial_finds_the_maximum(spark):
    df, x, y = counts(spark, 0.6)
    fit = R.negative_binomial(df, "y", ["x1", "x2"])
    assert not fit.at_boundary and fit.alpha == pytest.approx(0.6, abs=0.1)

    def likelihood(coef, alpha):
        mu, r = np.exp(x @ np.array(coef)), 1 / alpha
        g = np.vectorize(math.lgamma)
        return (g(y + r) - g(r) - g(y + 1.0) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))).sum()

    best = likelihood(fit.coef, fit.alpha)
    assert fit.log_likelihood == pytest.approx(best, abs=1e-6)
    for step in (0.01, -0.01):
        assert likelihood(fit.coef, fit.alpha * math.exp(step)) < best
        for i in range(3):
            moved = list(fit.coef)
            moved[i] += step
            assert likelihood(moved, fit.alpha) < best


def test_without_overdispersion_the_result_is_poisson(spark):
    rows = [(y, float(i % 2)) for i, y in enumerate([2, 3, 2, 3, 2, 3, 3, 2] * 10)]
    df = spark.createDataFrame(rows, "y int, x double")
    fit = R.negative_binomial(df, "y", ["x"])
    assert fit.at_boundary and fit.alpha == 0.0
    assert fit.coef == pytest.approx(R.poisson(df, "y", ["x"]).coef, abs=1e-8)


def test_published_panel(spark):
    """Needs the published panel as a CSV file; NEWS_PANEL_CSV names it."""
    path = os.environ.get("NEWS_PANEL_CSV")
    if not path:
        pytest.skip("NEWS_PANEL_CSV is not set")
    panel = spark.read.csv(path, header=True, inferSchema=True)
    assert panel.agg(F.sum("Misinfo_Event_Count")).first()[0] == 500
    for fit in (R.poisson(panel), R.negative_binomial(panel)):
        rows = {r.term: tuple(r)[1:] for r in R.irr_table(fit, spark).collect()}
        assert rows.keys() == PUBLISHED.keys()
        for term, want in PUBLISHED.items():
            assert rows[term][:4] == pytest.approx(want[:4], abs=1e-9)
            assert rows[term][4] == pytest.approx(want[4], abs=0.00101)
    assert R.negative_binomial(panel).at_boundary
    ratio = R.overdispersion(panel, R.poisson(panel)).first().pearson_ratio
    assert round(ratio, 2) == 0.45
