"""Career length with censoring.

Kaplan-Meier curves work on counts by duration, a bounded axis; Cox models take any durations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grids import Z95
from ..session import cut_lineage


def careers(entities: DataFrame, seasons: DataFrame, entity: str, cohort: str, period: str, last: int, grace: int = 2) -> DataFrame:
    """Entities with last period, periods played, duration and whether the career has ended."""
    per = seasons.groupBy(entity).agg(
        F.max(period).alias("last_period"), F.count_distinct(period).alias("periods_played")
    )
    e = entities.where(F.col(cohort) < last).join(per, entity, "left")
    ended = F.col("last_period").isNull() | (F.col("last_period") <= last - grace)
    return e.withColumns(
        {
            "periods_played": F.coalesce("periods_played", F.lit(0)),
            "duration": F.coalesce(F.col("last_period") - F.col(cohort), F.lit(0)).cast("int"),
            "ended": ended,
        }
    )


def kaplan_meier(df: DataFrame, band: str, duration: str, ended: str, horizon: int = 20) -> DataFrame:
    """(band, t, survival, ci_low, ci_high, n, median) at t = 0..horizon.

    Log-log Greenwood interval; between observed durations the curve is flat and the interval
    linear. The median is null when the curve never reaches one half.
    """
    counts = df.where(F.col(band).isNotNull()).groupBy(band, F.col(duration).alias("t")).agg(
        F.count(F.lit(1)).alias("m"), F.count_if(F.col(ended)).alias("d")
    )
    sizes = counts.groupBy(band).agg(F.sum("m").alias("n"), F.max("t").alias("_last"))
    axis = sizes.withColumn("t", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_last"), F.lit(horizon)))))
    c = axis.join(counts, [band, "t"], "left").withColumn(
        "seen", F.col("m").isNotNull() | (F.col("t") == 0)
    ).fillna(0, ["m", "d"])
    up = Window.partitionBy(band).orderBy("t")
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("risk", F.sum("m").over(up.rowsBetween(0, Window.unboundedFollowing)))
    alive = (F.col("d") > 0) & (F.col("d") < F.col("risk"))
    c = c.withColumns(
        {
            "_log": F.sum(F.when(alive, F.log1p(-F.col("d") / F.col("risk"))).otherwise(0.0)).over(so_far),
            "_var": F.sum(F.when(alive, F.col("d") / (F.col("risk") * (F.col("risk") - F.col("d")))).otherwise(0.0)).over(so_far),
            "_dead": F.max(((F.col("d") > 0) & (F.col("d") == F.col("risk"))).cast("int")).over(so_far) == 1,
        }
    )
    s = F.when(F.col("_dead"), 0.0).otherwise(F.exp("_log"))
    inside = (s > 0) & (s < 1)

    def bound(sign: int):
        # S ** exp(sign * z * se / log S)
        power = F.exp(F.lit(sign * Z95) * F.sqrt("_var") / F.when(inside, F.col("_log")))
        return F.when(inside, F.pow(s, power)).otherwise(s)

    c = c.withColumns({"survival": s, "_lo": bound(-1), "_hi": bound(1)})
    ahead = up.rowsBetween(0, Window.unboundedFollowing)
    known = {k: F.when(F.col("seen"), F.col(k)) for k in ("_lo", "_hi", "t")}
    out = c.withColumns(
        {
            **{f"{k}0": F.last(v, True).over(so_far) for k, v in known.items()},
            **{f"{k}1": F.first(v, True).over(ahead) for k, v in known.items()},
        }
    )
    frac = F.coalesce(F.try_divide(F.col("t") - F.col("t0"), F.col("t1") - F.col("t0")), F.lit(0.0))

    def between(k: str):
        return F.col(f"{k}0") + (F.coalesce(f"{k}1", f"{k}0") - F.col(f"{k}0")) * frac

    med = F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).over(Window.partitionBy(band))
    out = out.withColumns({"ci_low": between("_lo"), "ci_high": between("_hi"), "median": med})
    return out.where(F.col("t") <= horizon).select(band, "t", "survival", "ci_low", "ci_high", "n", "median")


#: Buckets of time: their totals are what a Newton step brings to the driver besides p x p sums.
BUCKETS = 128


def _time_buckets(df: DataFrame, duration: str) -> DataFrame:
    """The rows with `_b`, rising with the duration; equal durations share a bucket."""
    probs = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = df.agg(F.percentile_approx(duration, probs, 5000)).first()[0] or []  # a bounded number of cuts
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    return df.withColumn("_b", F.size(F.filter(edges, lambda e: e < F.col(duration))))


def _moments(df: DataFrame, xs: list[str], duration: str, ended: str, beta: np.ndarray) -> DataFrame:
    """(_b, t, d, risk, ends, x): per distinct duration the sums of w, wx, wxx' of all rows and of ended ones, and of x of ended ones.

    Partial sums leave the tasks, so a duration that very many rows share is one row a task.
    """
    eta = F.lit(0.0)
    for x, b in zip(xs, beta):
        eta = eta + float(b) * F.col(x)
    d = df.withColumn("_w", F.exp(eta))
    gone = F.col(ended)
    terms = [F.col("_w"), *[F.col("_w") * F.col(x) for x in xs]]
    terms += [F.col("_w") * F.col(xs[i]) * F.col(xs[j]) for i in range(len(xs)) for j in range(i, len(xs))]

    def total(values: list[Column]) -> Column:
        return F.array(*[F.sum(v) for v in values])

    return d.groupBy("_b", F.col(duration).cast("double").alias("t")).agg(
        F.count_if(gone).alias("d"), total(terms).alias("risk"), total([F.when(gone, v).otherwise(0.0) for v in terms]).alias("ends"),
        total([F.when(gone, F.col(x)).otherwise(0.0) for x in xs]).alias("x"))


def _unpacked(v: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of w, of wx, of wxx') from the order of _moments."""
    upper = np.zeros((p, p))
    upper[np.triu_indices(p)] = v[1 + p :]
    return v[0], v[1 : 1 + p], upper + np.triu(upper, 1).T


def _step(moments: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and information of the partial likelihood with Efron ties.

    Risk sets are sums over later durations: bucket totals are cumulated on the driver, and the rows of a
    bucket in one task, which returns sums of p + p x p numbers.
    """
    size = 1 + p + p * (p + 1) // 2
    sums = moments.groupBy("_b").agg(*[F.sum(F.col("risk")[i]).alias(f"r{i}") for i in range(size)]).collect()  # one row a bucket
    later: dict[int, np.ndarray] = {}
    run = np.zeros(size)
    for row in sorted(sums, key=lambda r: -r["_b"]):
        later[row["_b"]] = run.copy()
        run += [row[f"r{i}"] for i in range(size)]

    def inside(t: pa.Table) -> pa.Table:
        t = t.sort_by([("t", "descending")])
        risk, ends = (np.array(t.column(c).to_pylist()) for c in ("risk", "ends"))
        events, xs = t.column("d").to_numpy(), np.array(t.column("x").to_pylist())
        at_risk = np.cumsum(risk, axis=0) + later[t.column("_b")[0].as_py()]
        grad, info = np.zeros(p), np.zeros((p, p))
        for i in np.flatnonzero(events):
            r0, r1, r2 = _unpacked(at_risk[i], p)
            e0, e1, e2 = _unpacked(ends[i], p)
            s0, s1, q0, q1, q2 = _tie_sums(r0, e0, int(events[i]))
            grad += xs[i] - (s0 * r1 - s1 * e1)
            cross = np.outer(r1, e1)
            info += s0 * r2 - s1 * e2 - (q0 * np.outer(r1, r1) - q1 * (cross + cross.T) + q2 * np.outer(e1, e1))
        v = np.concatenate([grad, info.ravel()])
        return pa.table({"i": pa.array(np.arange(len(v)), pa.int32()), "v": v})

    rows = moments.groupBy("_b").applyInArrow(inside, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(p + p * p)
    for r in rows:
        out[r["i"]] = r["v"]
    return out[:p], out[p:].reshape(p, p)


def _tie_sums(risk: float, tied: float, d: int, chunk: int = 1 << 20) -> tuple[float, float, float, float, float]:
    """Sums over f = 0, 1/d, ... (d - 1)/d of 1/phi, f/phi, 1/phi^2, f/phi^2, f^2/phi^2, with phi = risk - f * tied.

    All that Efron's rule needs of d tied events; held in chunks, whatever their number.
    """
    out = np.zeros(5)
    for at in range(0, d, chunk):
        f = np.arange(at, min(at + chunk, d)) / d
        one = 1 / (risk - f * tied)
        two = one * one
        out += one.sum(), (f * one).sum(), two.sum(), (f * two).sum(), (f * f * two).sum()
    return tuple(out)


def cox(
    df: DataFrame, xs: list[str], duration: str, ended: str, penalizer: float = 0.01, max_iter: int = 25
) -> dict[str, dict[str, float]]:
    """Hazard ratios with Efron ties: Newton steps over sums by distinct duration.

    Covariates are standardised inside, as the ridge penalty applies to standardised effects. Durations
    may be any numbers, as many different ones as there are rows: a step brings sums by bucket of time
    and p x p sums to the driver. Rows with a null duration or covariate are left out.
    """
    df = df.select(F.col(duration).cast("double").alias(duration), ended, *xs).dropna()
    p = len(xs)
    stats = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)],
        *[F.stddev_samp(x).alias(f"s{i}") for i, x in enumerate(xs)],
    ).first()
    mu = [stats[f"m{i}"] for i in range(p)]
    sd = [stats[f"s{i}"] or 1.0 for i in range(p)]
    z = cut_lineage(_time_buckets(df.select(duration, ended, *[((F.col(x) - mu[i]) / sd[i]).alias(x) for i, x in enumerate(xs)]), duration))
    beta = np.zeros(p)
    info = np.eye(p)
    for _ in range(max_iter):
        grad, info = _step(cut_lineage(_moments(z, xs, duration, ended, beta)), p)
        grad -= stats["n"] * penalizer * beta
        info += stats["n"] * penalizer * np.eye(p)
        step = np.linalg.solve(info, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    cov = np.linalg.inv(info)
    from statistics import NormalDist

    out = {}
    for i, x in enumerate(xs):
        b, se = beta[i] / sd[i], float(np.sqrt(cov[i, i])) / sd[i]
        out[x] = {
            "coef": float(b), "hazard_ratio": float(np.exp(b)), "ci_low": float(np.exp(b - Z95 * se)),
            "ci_high": float(np.exp(b + Z95 * se)), "p": 2 * (1 - NormalDist().cdf(abs(b / se))), "n": int(stats["n"]),
        }
    return out


def concordance(df: DataFrame, risk: str, duration: str, ended: str, buckets: int = 256) -> DataFrame:
    """One row: share of comparable pairs where the higher risk fails first, ties half.

    A failure at t is comparable with everyone lasting longer, and with those censored at t. Risk
    ranks are cut into buckets; pairs are counted between buckets and durations, and inside a
    bucket by ordered sums, never written out.
    """
    from .ranking import value_positions

    pos = value_positions(df, risk, [], buckets=buckets)
    place = F.floor(F.col("below") * buckets / F.col("total")).alias("_b")
    d = df.join(pos.select(risk, F.col("below").cast("long").alias("_rank"), place), risk)
    cells = d.groupBy("_b", "_rank", F.col(duration).alias("t")).agg(
        F.count_if(F.col(ended)).alias("fail"), F.count_if(~F.col(ended)).alias("cens")
    )
    # Survivors of t are counted for every failure time: durations are few, ranks are many.
    times = df.where(F.col(ended)).select(F.col(duration).alias("at")).distinct()
    at = times.agg(F.array_sort(F.collect_list("at"))).scalar()
    marks = cells.withColumn("_ats", at).withColumn("at", F.explode("_ats"))
    lasts = (F.col("t") > F.col("at")).cast("int") * (F.col("fail") + F.col("cens")) + (
        F.col("t") == F.col("at")
    ).cast("int") * F.col("cens")
    per = marks.groupBy("at", "_b", "_rank").agg(
        F.sum(lasts).alias("later"), F.sum(F.when(F.col("t") == F.col("at"), F.col("fail")).otherwise(0)).alias("fails")
    )
    up = Window.partitionBy("at").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        per.groupBy("at", "_b").agg(F.sum("later").alias("_s"))
        .withColumn("_before", F.coalesce(F.sum("_s").over(up), F.lit(0)))
        .withColumn("all", F.sum("_s").over(Window.partitionBy("at")))
        .drop("_s")
    )
    inside = Window.partitionBy("at", "_b").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.join(totals, ["at", "_b"]).withColumn("lower", F.col("_before") + F.coalesce(F.sum("later").over(inside), F.lit(0)))
    agg = per.agg(
        F.sum(F.col("fails") * (F.col("lower") + 0.5 * F.col("later"))).alias("good"),
        F.sum(F.col("fails") * F.col("all")).alias("pairs"),
    )
    return agg.select(F.try_divide("good", "pairs").alias("concordance"), "pairs")


def split_at(df: DataFrame, duration: str, ended: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(early, late): censored at k; and those beyond k with the clock restarted."""
    t, e = F.col(duration), F.col(ended)
    early = df.withColumns({ended: e & (t <= k), duration: F.least(t, F.lit(k))})
    late = df.where(t > k).withColumn(duration, t - k)
    return early, late
