"""Group rates, partial pooling and report cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grids as G
from ..functions.special import chi2_tail
from .aggregates import best_row, worst_row


def segment_rates(df: DataFrame, by: list[str], pit: str, verdict: str) -> DataFrame:
    """Beat and miss rates with score intervals, and mean PIT with a normal interval."""
    d = df.where(F.col(pit).isNotNull())
    for b in by:
        d = d.where(F.col(b).isNotNull())
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(verdict) == "beat ceiling").alias("_up"),
        F.count_if(F.col(verdict) == "below floor").alias("_dn"), F.avg(pit).alias("mean_pit"),
        F.stddev_samp(pit).alias("_sd"),
    )
    n, half = F.col("n"), G.Z95 * F.col("_sd") / F.sqrt("n")
    up, dn = G.wilson("_up", "n"), G.wilson("_dn", "n")
    return g.select(
        *by, "n", (F.col("_up") / n).alias("beat_ceiling"), up[0].alias("bc_lo"), up[1].alias("bc_hi"),
        (F.col("_dn") / n).alias("below_floor"), dn[0].alias("bf_lo"), dn[1].alias("bf_hi"), "mean_pit",
        (F.col("mean_pit") - half).alias("pit_lo"), (F.col("mean_pit") + half).alias("pit_hi"),
    )


def pooled_effects(df: DataFrame, group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(group table, one-row heterogeneity test): Cochran's Q, DerSimonian-Laird tau, shrunk means."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    var = d.agg(F.var_samp(value)).scalar()
    g = d.groupBy(group).agg(F.avg(value).alias("raw_mean"), F.count(F.lit(1)).alias("n")).withColumn("_var", var)
    g = g.withColumn("se2", F.col("_var") / F.col("n")).withColumn("_w", 1 / F.col("se2"))
    m, w = F.col("raw_mean"), F.col("_w")
    s = g.agg(
        F.count(F.lit(1)).alias("groups"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * m).alias("swm"),
        F.sum(w * m * m).alias("swmm"),
    )
    q = F.col("swmm") - F.col("swm") * F.col("swm") / F.col("sw")
    df_ = F.col("groups") - 1
    tau2 = F.greatest((q - df_) / (F.col("sw") - F.col("sww") / F.col("sw")), F.lit(0.0))
    test = s.select(
        "groups", q.alias("q"), df_.alias("df"), chi2_tail(q, df_).alias("p_value"), F.sqrt(tau2).alias("tau"),
        (F.col("swm") / F.col("sw")).alias("grand"),
    )
    packed = s.select(F.struct(tau2.alias("t2"), (F.col("swm") / F.col("sw")).alias("g")).alias("s")).scalar()
    g = g.withColumn("_s", packed)
    half = G.Z95 * F.sqrt("se2")
    shrink = F.col("_s.t2") / (F.col("_s.t2") + F.col("se2"))
    table = g.select(
        group, "n", "raw_mean", (m - half).alias("raw_lo"), (m + half).alias("raw_hi"),
        (F.col("_s.g") + shrink * (m - F.col("_s.g"))).alias("pooled"),
    )
    return table, test


def group_report(
    df: DataFrame, group: str, value: str, key: str, good: Column, star: Column, rank_by: str | None = None,
    min_rows: int = 1, z: float = 1.645,
) -> DataFrame:
    """Report card per group: centred mean with 90 % interval, shares, best and worst row."""
    d = df.where(F.col(group).isNotNull())
    centre = d.agg(F.avg(value)).scalar()
    by = rank_by or value
    g = d.groupBy(group).agg(
        F.count(F.lit(1)).alias("picks"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"),
        F.avg(F.coalesce(good, F.lit(False)).cast("double")).alias("good_share"),
        F.count_if(star).alias("stars"), best_row(by, key, key).alias("best"), worst_row(by, key, key).alias("worst"),
    ).where(F.col("picks") >= min_rows).withColumn("_c", centre)
    se = F.col("_sd") / F.sqrt("picks")
    return g.select(
        group, "picks", (F.col("_m") - F.col("_c")).alias("vs_slot"), se.alias("se"),
        (F.col("_m") - F.col("_c") - z * se).alias("lo"), (F.col("_m") - F.col("_c") + z * se).alias("hi"),
        "good_share", "stars", "best", "worst",
    )
