"""Count regression of the panel: Poisson, dispersion tests, negative binomial, rate ratios.

A fit reads the panel once per step and brings back sums whose number depends on
the number of covariates only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.functions.special import digamma, lgamma, trigamma

OUTCOME = "Misinfo_Event_Count"
COVARIATES = ["Political_Prop", "Economic_Prop", "Health_Prop", "Tone_Overall_Mean"]
# Fixed value: the two-sided 95 % point of the normal distribution
Z95 = 1.959963984540054


@dataclass
class Fit:
    terms: list[str]
    coef: list[float]
    se: list[float]
    alpha: float = 0.0
    at_boundary: bool = False
    log_likelihood: float = math.nan
    n: int = 0


MOST_ROUNDS = 100


def complete_cases(panel: DataFrame, outcome: str, covariates: Sequence[str]) -> DataFrame:
    return panel.select(F.col(outcome).cast("double").alias("y"),
                        *[F.col(c).cast("double").alias(c) for c in covariates]).dropna()


def poisson(panel: DataFrame, outcome: str = OUTCOME, covariates: Sequence[str] = COVARIATES) -> Fit:
    """Log-link Poisson regression by Spark's own iteratively reweighted least squares."""
    data = VectorAssembler(inputCols=list(covariates), outputCol="features").transform(
        complete_cases(panel, outcome, covariates)).select("y", "features")
    model = GeneralizedLinearRegression(
        family="poisson", link="log", labelCol="y", tol=1e-10, maxIter=MOST_ROUNDS).fit(data)
    summary = model.summary
    if summary.numIterations >= MOST_ROUNDS:
        raise RuntimeError(f"the Poisson fit did not settle in {MOST_ROUNDS} rounds")
    # Spark lists the intercept last
    se = list(summary.coefficientStandardErrors)
    return Fit(["Intercept", *covariates], [model.intercept, *model.coefficients.toArray().tolist()],
               [se[-1], *se[:-1]], n=summary.numInstances)


def mean_of(fit: Fit) -> Column:
    eta = F.lit(float(fit.coef[0]))
    for name, b in zip(fit.terms[1:], fit.coef[1:]):
        eta = eta + F.lit(float(b)) * F.col(name)
    return F.exp(eta)


def overdispersion(panel: DataFrame, fit: Fit, outcome: str = OUTCOME) -> DataFrame:
    """Pearson chi-square over degrees of freedom, variance over mean, and the slope of the
    auxiliary regression ((y - mu)^2 - y) / mu on mu with its t-value, for a Poisson fit."""
    data = complete_cases(panel, outcome, fit.terms[1:]).withColumn("mu", mean_of(fit))
    excess = (F.pow(F.col("y") - F.col("mu"), F.lit(2)) - F.col("y")) / F.col("mu")
    data = data.withColumn("z", excess)
    sums = data.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pow(F.col("y") - F.col("mu"), F.lit(2)) / F.col("mu")).alias("pearson"),
        (F.var_samp("y") / F.avg("y")).alias("variance_to_mean"),
        F.sum(F.col("mu") * F.col("mu")).alias("mm"),
        F.sum(F.col("mu") * F.col("z")).alias("mz"),
        F.sum(F.col("z") * F.col("z")).alias("zz"))
    slope = F.col("mz") / F.col("mm")
    residual = (F.col("zz") - F.col("mz") * F.col("mz") / F.col("mm")) / (F.col("n") - 1)
    df = F.col("n") - len(fit.terms)
    return sums.select(
        "n", df.alias("df"), F.col("pearson").alias("pearson_chi2"),
        (F.col("pearson") / df).alias("pearson_ratio"), "variance_to_mean",
        slope.alias("aux_alpha"), (slope / F.sqrt(residual / F.col("mm"))).alias("aux_t"))


def _weighted_step(data: DataFrame, terms: list[str], coef: np.ndarray, alpha: float):
    """One reweighted least-squares step: (new coefficients, inverse information)."""
    fit = Fit(terms, coef.tolist(), [])
    x = [F.lit(1.0), *[F.col(c) for c in terms[1:]]]
    staged = data.withColumn("_mu", mean_of(fit)).withColumn(
        "_w", F.col("_mu") / (1 + F.lit(float(alpha)) * F.col("_mu"))).withColumn(
        "_z", F.log("_mu") + (F.col("y") - F.col("_mu")) / F.col("_mu"))
    w, z, p = F.col("_w"), F.col("_z"), len(terms)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = staged.agg(*[F.sum(w * x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs],
                     *[F.sum(w * x[i] * z).alias(f"b{i}") for i in range(p)]).first()
    a = np.zeros((p, p))
    for i, j in pairs:
        a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    inverse = np.linalg.inv(a)
    return inverse @ np.array([row[f"b{i}"] for i in range(p)]), inverse


def _settle(data, terms, coef, alpha, tol=1e-10, rounds=50):
    for _ in range(rounds):
        new, inverse = _weighted_step(data, terms, coef, alpha)
        done = np.max(np.abs(new - coef)) < tol * (1 + np.max(np.abs(new)))
        coef = new
        if done:
            return coef, inverse
    raise RuntimeError("regression did not converge")


def _alpha_slope(data: DataFrame, fit: Fit, alpha: float) -> tuple[float, float]:
    """Slope and curvature of the log-likelihood in log(1/alpha), at the fit's means."""
    r = 1.0 / alpha
    y, mu, rc = F.col("y"), F.col("_mu"), F.lit(r)
    slope = (digamma(y + rc) - digamma(rc) + F.log(rc / (rc + mu)) + 1 - (rc + y) / (rc + mu))
    curve = (trigamma(y + rc) - trigamma(rc) + 1 / rc - 1 / (rc + mu)
             - (mu - y) / F.pow(rc + mu, F.lit(2)))
    row = data.withColumn("_mu", mean_of(fit)).agg(F.sum(slope).alias("s"), F.sum(curve).alias("c")).first()
    return r * row["s"], r * r * row["c"] + r * row["s"]


def _log_likelihood(data: DataFrame, fit: Fit) -> float:
    y, mu, rc = F.col("y"), F.col("_mu"), F.lit(1.0 / fit.alpha)
    each = (lgamma(y + rc) - lgamma(rc) - lgamma(y + 1) + rc * F.log(rc / (rc + mu))
            + y * F.log(mu / (rc + mu)))
    return data.withColumn("_mu", mean_of(fit)).agg(F.sum(each)).first()[0]


def negative_binomial(panel: DataFrame, outcome: str = OUTCOME, covariates: Sequence[str] = COVARIATES,
                      tol: float = 1e-8, rounds: int = 60) -> Fit:
    """Negative binomial (variance mu + alpha mu^2) with alpha by maximum likelihood.

    If the likelihood does not rise when alpha leaves zero the counts are not
    overdispersed; the result is then the Poisson fit, marked ``at_boundary``.
    """
    data = complete_cases(panel, outcome, covariates).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        terms = ["Intercept", *covariates]
        first = data.agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).first()
        coef = np.zeros(len(terms))
        coef[0] = math.log(first["m"])
        coef, inverse = _settle(data, terms, coef, 0.0)
        fit = Fit(terms, coef.tolist(), np.sqrt(np.diag(inverse)).tolist(), n=first["n"])
        mu = mean_of(fit)
        at_zero = data.agg(
            F.sum(F.pow(F.col("y") - mu, F.lit(2)) - F.col("y")).alias("rise"),
            F.sum(F.pow(mu, F.lit(2))).alias("mm"),
            F.sum(F.col("y") * F.log(mu) - mu - lgamma(F.col("y") + 1)).alias("l")).first()
        fit.log_likelihood = at_zero["l"]
        if at_zero["rise"] <= 0:
            fit.at_boundary = True
            return fit
        alpha = max(at_zero["rise"] / at_zero["mm"], 1e-6)
        for _ in range(rounds):
            # coefficients and alpha are nearly independent, so one step of each in turn will do
            new, inverse = _weighted_step(data, terms, coef, alpha)
            moved, coef = np.max(np.abs(new - coef)), new
            fit = Fit(terms, coef.tolist(), np.sqrt(np.diag(inverse)).tolist(), alpha, n=first["n"])
            slope, curve = _alpha_slope(data, fit, alpha)
            step = slope / abs(curve) if curve else math.copysign(1.0, slope)
            step = max(-2.0, min(2.0, step))
            if abs(step) < tol and moved < tol:
                fit.log_likelihood = _log_likelihood(data, fit)
                return fit
            alpha = alpha * math.exp(-step)
            if alpha < 1e-9:
                fit.alpha, fit.at_boundary, fit.log_likelihood = 0.0, True, at_zero["l"]
                return fit
        raise RuntimeError("dispersion did not converge")
    finally:
        data.unpersist()


def irr_table(fit: Fit, spark, digits: int | None = 3) -> DataFrame:
    """Coefficient, rate ratio, its 95 % limits and two-sided p-value per term."""
    def cut(v):
        return float(v) if digits is None else round(float(v), digits) + 0.0

    rows = []
    for term, b, se in zip(fit.terms, fit.coef, fit.se):
        p = math.erfc(abs(b / se) / math.sqrt(2))
        rows.append((term, *map(cut, (b, math.exp(b), math.exp(b - Z95 * se), math.exp(b + Z95 * se), p))))
    return spark.createDataFrame(
        rows, "term string, coef double, IRR double, IRR_ci_lower double, IRR_ci_upper double, p_value double")


def fit_row(fit: Fit, spark) -> DataFrame:
    """Coefficients and errors by term with the fit's dispersion."""
    return spark.createDataFrame(
        [(t, b, s, fit.alpha, fit.at_boundary, fit.log_likelihood) for t, b, s in zip(fit.terms, fit.coef, fit.se)],
        "term string, coef double, se double, alpha double, at_boundary boolean, log_likelihood double")
