"""Empirical-Bayes rates and one-factor scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def beta_priors(df: DataFrame, groups: list[str], made: str, att: str, min_att: int = 50) -> DataFrame:
    """(groups, mean, kappa, n) by the method of moments, in one pass.

    True variance is the attempt-weighted variance of observed rates less binomial noise; kappa is
    the number of attempts the prior mean is worth.
    """
    d = df.where(F.col(att) >= min_att)
    m, a = F.col(made).cast("double"), F.col(att).cast("double")
    s = d.groupBy(*groups).agg(
        F.sum(m).alias("_m"), F.sum(a).alias("_a"), F.sum(m * m / a).alias("_q"), F.count(F.lit(1)).alias("n")
    )
    mean = F.col("_m") / F.col("_a")
    spread = mean * (1 - mean)
    observed = F.col("_q") / F.col("_a") - mean * mean
    true_var = F.greatest(observed - spread * F.col("n") / F.col("_a"), F.lit(1e-6))
    return s.select(*groups, mean.alias("mean"), F.greatest(spread / true_var - 1, F.lit(1.0)).alias("kappa"), "n")


def shrunk_rate(made: Column, att: Column, mean: Column, kappa: Column) -> Column:
    return (made + mean * kappa) / (att + kappa)


def one_factor(df: DataFrame, inputs: list[str], training: Column, zero: dict[str, float], name: str = "factor") -> DataFrame:
    """Score on the single factor the inputs share, 0 at the `zero` row, rising with inputs[0].

    Only the correlation matrix (one row, a square of the input count) reaches the driver; the
    score is a linear expression evaluated in place.
    """
    p = len(inputs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.where(training).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(inputs)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(inputs)],
        *[F.corr(inputs[i], inputs[j]).alias(f"r{i}_{j}") for i, j in pairs if i != j],
    ).first()
    r = np.eye(p)
    for i, j in pairs:
        if i != j:
            r[i, j] = r[j, i] = row[f"r{i}_{j}"]
    load, noise = np.sqrt(np.full(p, 0.5)), np.full(p, 0.5)
    for _ in range(2000):  # EM on a p x p matrix
        beta = (load / noise) / (1 + (load * load / noise).sum())
        second = 1 - beta @ load + beta @ r @ beta
        new = (r @ beta) / second
        noise = np.maximum(np.diag(r) - new * (beta @ r), 1e-6)
        if np.abs(new - load).max() < 1e-12:
            break
        load = new
    if load[0] < 0:
        load = -load
    coef = (load / noise) / (1 + (load * load / noise).sum())
    score = F.lit(0.0)
    for i, c in enumerate(inputs):
        score = score + float(coef[i] / row[f"s{i}"]) * (F.col(c) - float(zero[c]))
    return df.withColumn(name, score)
