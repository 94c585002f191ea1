"""One training set for trees, and features prepared for learners that take no missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouped_trees import Growth, forest_grids
from .ranking import quantile_grid


def forest_quantiles(train: DataFrame, test: DataFrame, features: list[str], y: str, growth: Growth = Growth(share=1 / 3), points: int = 99) -> DataFrame:
    """(id, grid): the quantile regression forest of a single training set."""
    one = F.lit(0).alias("fold")
    return forest_grids(train.select("*", one), test.select("*", one), features, y, growth, points).select("id", "grid")


def imputed(rows: DataFrame, train: DataFrame, features: list[str], by: list[str], min_observed: int = 30, clip: float = 5.0) -> DataFrame:
    """Median fill and clipped z-scores from the training rows of each fold.

    A feature observed fewer than `min_observed` times in the fold is pinned to its median.
    Adds `z_<feature>` and `no_<feature>`.
    """
    long = train.unpivot([*by], features, "feature", "v")
    med = quantile_grid(long.where(F.col("v").isNotNull()), "v", [0.5], [*by, "feature"], "_q")
    n = long.groupBy(*by, "feature").agg(F.count("v").alias("_n"))
    filled = long.join(n.join(med, [*by, "feature"], "left").withColumn("_med", F.coalesce(F.col("_q")[0], F.lit(0.0))), [*by, "feature"])
    v = F.coalesce("v", "_med")
    stats = filled.groupBy(*by, "feature").agg(
        F.first("_med").alias("_med"), F.avg(v).alias("_mu"), F.stddev_samp(v).alias("_sd"), F.first("_n").alias("_n")
    )
    wide = stats.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("feature") == f, F.struct("_med", "_mu", "_sd", "_n"))).alias(f"_s_{f}")
            for f in features
        ]
    )
    out = rows.join(wide, by)

    def z(f: str) -> Column:
        s = F.col(f"_s_{f}")
        x = F.when(s["_n"] < min_observed, s["_med"]).otherwise(F.coalesce(f, s["_med"]))
        sd = F.coalesce(F.nullif(s["_sd"], F.lit(0.0)), F.lit(1.0))
        return F.greatest(F.least((x - s["_mu"]) / sd, F.lit(clip)), F.lit(-clip))

    out = out.withColumns({**{f"z_{f}": z(f) for f in features}, **{f"no_{f}": F.col(f).isNull().cast("double") for f in features}})
    return out.drop(*[f"_s_{f}" for f in features])
