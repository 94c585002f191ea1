"""Propensity-weighted comparisons with balance and sensitivity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resample import numeric_key, replicate_weights


def propensity(df: DataFrame, covariates: list[str], treated: str, weight: str | None = None) -> DataFrame:
    """Add `e`: probability of treatment by ridge logistic regression on standardised covariates."""
    x = VectorAssembler(inputCols=covariates, outputCol="_x").transform(df.withColumn("_t", F.col(treated).cast("double")))
    scaled = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(x).transform(x)
    n = scaled.count() if weight is None else scaled.agg(F.sum(weight)).first()[0]
    # A unit inverse penalty on the summed loss is 1 / n on the mean loss.
    lr = LogisticRegression(featuresCol="_z", labelCol="_t", regParam=1.0 / n, standardization=False, maxIter=100)
    if weight:
        lr = lr.setWeightCol(weight)
    out = lr.fit(scaled).transform(scaled)
    return out.withColumn("e", vector_to_array("probability")[1]).drop(
        "_x", "_z", "_t", "probability", "rawPrediction", "prediction"
    )


def propensity_replicates(
    df: DataFrame, covariates: list[str], treated: str, y: str, key: str, reps: int, trim: float = 0.05, seed: int = 0,
    iterations: int = 25, hit: Column | None = None,
) -> DataFrame:
    """(rep, diff, ratio): the weighted difference in each resample, with the propensity model refitted there.

    ratio is that of the weighted shares with `hit` (null without it, or where the untreated have none).

    Newton steps of all replicates run together: a pass over the rows sums gradients and second
    derivatives, a few numbers per replicate. Covariates are standardised once over all rows.
    """
    spark, p = df.sparkSession, len(covariates) + 1
    moments = df.agg(*[f(c).alias(f"{n}_{c}") for c in covariates for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    z = [((F.col(c) - moments[f"m_{c}"]) / (moments[f"s_{c}"] or 1.0)).cast("double").alias(f"z{i}") for i, c in enumerate(covariates)]
    rows = df.select(numeric_key(df, key).alias("key"), F.col(treated).cast("double").alias("t"), F.col(y).cast("double").alias("y"),
                     (F.lit(0.0) if hit is None else F.coalesce(hit.cast("double"), F.lit(0.0))).alias("h"), *z)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def total(size: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of part(x, t, y, h, weights) over batches: `size` numbers."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for whole in batches:
                for at in range(0, whole.num_rows, 4_000):
                    b = whole.slice(at, 4_000)
                    col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
                    x = np.column_stack([np.ones(b.num_rows), *[col[f"z{i}"] for i in range(p - 1)]])
                    out += part(x, col["t"], col["y"], col["h"], replicate_weights(col["key"], reps, seed).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(out)], names=["i", "v"])

        got = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size)
        out[got.column("i").to_numpy()] = got.column("v").to_numpy()
        return out

    beta = np.zeros((reps, p))
    ridge = np.diag([0.0, *[1.0] * (p - 1)])
    for _ in range(iterations):

        def slopes(x, t, y, h, w, beta=beta):
            e = 1 / (1 + np.exp(-(x @ beta.T)))
            g = x.T @ (w * (t[:, None] - e))
            v = w * e * (1 - e)
            return np.concatenate([g.ravel(), *[(x[:, i] * x[:, j]) @ v for i, j in pairs]])

        sums = total(reps * (p + len(pairs)), slopes)
        g = sums[: p * reps].reshape(p, reps).T - beta @ ridge
        h = np.empty((reps, p, p))
        for (i, j), v in zip(pairs, sums[p * reps :].reshape(len(pairs), reps), strict=True):
            h[:, i, j] = h[:, j, i] = v
        step = np.linalg.solve(h + ridge + 1e-9 * np.eye(p), g[..., None])[..., 0]
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break

    def arms(x, t, y, h, w):
        e = 1 / (1 + np.exp(-(x @ beta.T)))
        w = np.where((e > trim) & (e < 1 - trim), w, 0.0)
        one, none = w * t[:, None] / e, w * (1 - t)[:, None] / (1 - e)
        return np.concatenate([y @ one, one.sum(0), y @ none, none.sum(0), h @ one, h @ none])

    a, b, c, d, f, g = total(6 * reps, arms).reshape(6, reps)
    found = [(r + 1, float(a[r] / b[r] - c[r] / d[r]), float(f[r] / b[r] / (g[r] / d[r])) if hit is not None and g[r] else None)
             for r in range(reps) if b[r] and d[r]]
    return spark.createDataFrame(found, "rep int, diff double, ratio double")


def stabilised(df: DataFrame, treated: str, e: str = "e", weight: str | None = None) -> DataFrame:
    """Add `ipw`: stabilised inverse probability weights from the treated share."""
    w = F.col(weight) if weight else F.lit(1.0)
    share = df.agg(F.sum(w * F.col(treated).cast("double")) / F.sum(w)).scalar()
    t = F.col(treated)
    p = F.col("_p")
    return df.withColumn("_p", share).withColumn(
        "ipw", F.when(t, p / F.col(e)).otherwise((1 - p) / (1 - F.col(e)))
    ).drop("_p")


def ipw_effect(df: DataFrame, treated: str, y: str, hit: Column, e: str = "e", trim: float = 0.05) -> DataFrame:
    """One row: weighted difference, risk ratio, rows used, after trimming regions without overlap."""
    d = stabilised(df.where((F.col(e) > trim) & (F.col(e) < 1 - trim)), treated, e)
    t, w = F.col(treated), F.col("ipw")

    def mean(v: Column, arm: Column) -> Column:
        return F.try_divide(F.sum(F.when(arm, v * w)), F.sum(F.when(arm, w)))

    h = hit.cast("double")
    return d.agg(
        (mean(F.col(y), t) - mean(F.col(y), ~t)).alias("diff"),
        F.try_divide(mean(h, t), mean(h, ~t)).alias("risk_ratio"), F.count(F.lit(1)).alias("n_used"),
        F.min(e).alias("e_min"), F.max(e).alias("e_max"),
        (F.avg(F.when(t, F.col(y))) - F.avg(F.when(~t, F.col(y)))).alias("raw_diff"),
    )


def balance(df: DataFrame, covariates: list[str], treated: str, weight: str | None = None) -> DataFrame:
    """(feature, smd): standardised mean difference per covariate, in one pass over the table."""
    t = F.col(treated)
    w = F.col(weight) if weight else F.lit(1.0)
    aggs = []
    for c in covariates:
        x = F.col(c).cast("double")
        m1 = F.sum(F.when(t, x * w)) / F.sum(F.when(t, w))
        m0 = F.sum(F.when(~t, x * w)) / F.sum(F.when(~t, w))
        sd = F.sqrt((F.var_pop(F.when(t, x)) + F.var_pop(F.when(~t, x))) / 2)
        aggs.append(((m1 - m0) / F.when(sd > 0, sd).otherwise(1.0)).alias(c))
    return df.agg(*aggs).unpivot([], covariates, "feature", "smd")


def e_value(rr: Column) -> Column:
    """Association an unmeasured confounder would need to explain the ratio away."""
    r = F.when(rr >= 1, rr).when(rr > 0, 1 / rr)
    return r + F.sqrt(r * (r - 1))
