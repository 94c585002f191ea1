"""Quantile forecasts: slot model of record, conformal shift, blends, rolling-origin backtests.

A model is a function from training roles to a (fold, key, grid) frame, so all folds are fitted
and predicted in one Spark job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grids as G
from ..functions.common import let
from .folds import fold_cohorts
from .neighbours import slot_grids, slot_pool
from .ranking import quantile_grid


def adaptive_k(k: int, share: float = 0.2, least: int = 10) -> Column:
    """Neighbour count capped at a share of the fold's training rows (half-even rounding)."""
    return F.least(F.lit(k), F.greatest(F.lit(least), F.bround(F.col("n_train") * share).cast("int")))


def conformal_level(total: Column, tau: Column) -> Column:
    return F.ceil((total + 1) * tau) / total


@dataclass(frozen=True)
class SlotModel:
    """Slot neighbours with an optional conformal shift from the latest training cohorts."""

    cohort: str
    slot: str
    y: str
    order: str
    lag: int
    folds: tuple[int, ...]
    k: int = 60
    adaptive: bool = False
    calib: int = 0
    min_fit: int = 0
    min_training: int = 0
    retrospective: bool = False

    def roles(self, rows: DataFrame) -> DataFrame:
        known = rows.where(F.col(self.y).isNotNull())
        return fold_cohorts(
            known, self.cohort, self.lag, list(self.folds), self.calib, self.min_fit,
            self.min_training, self.retrospective,
        )

    def fit(self, rows: DataFrame) -> DataFrame:
        """(fold, slot, grid, n_train, max_train, retrospective) for every slot in the table."""
        roles = self.roles(rows)
        pool, sizes = slot_pool(rows, self.cohort, self.slot, self.y, self.order, self.k)
        grids = slot_grids(
            pool, sizes, roles, rows.where(F.col(self.slot).isNotNull()).select(self.slot),
            self.cohort, self.slot, self.y, self.order, self.k, G.LEVELS,
            adaptive_k(self.k) if self.adaptive else None,
        ).drop("k")
        if self.calib:
            grids = self._shifted(rows, roles, grids)
        info = roles.groupBy("fold").agg(
            F.max("n_train").alias("n_train"), F.max(self.cohort).alias("max_train"),
            F.max("retrospective").alias("retrospective"),
        )
        return grids.join(info, "fold")

    def _shifted(self, rows: DataFrame, roles: DataFrame, grids: DataFrame) -> DataFrame:
        held = roles.where("role = 'calib'").select("fold", self.cohort)
        known = rows.where(F.col(self.y).isNotNull()).select(self.cohort, self.slot, self.y)
        delta = conformal_shift(
            known.join(held, self.cohort).join(grids, ["fold", self.slot]), "grid", self.y, ["fold"]
        )
        moved = grids.join(delta, "fold", "left")
        shifted = F.when(F.col("delta").isNull(), G.monotone("grid")).otherwise(
            G.shift(G.monotone("grid"), "delta")
        )
        return moved.withColumn("grid", G.clamp_below(shifted, F.lit(0.0))).drop("delta")

    def predict(self, rows: DataFrame, fitted: DataFrame) -> DataFrame:
        """Attach each row's grid from the fold of its own cohort."""
        grid = fitted.withColumnRenamed("fold", self.cohort)
        out = rows.join(grid, [self.cohort, self.slot])
        return out.withColumn("grid", G.monotone("grid"))


def conformal_shift(held_out: DataFrame, grid: str, y: str, by: list[str], name: str = "delta") -> DataFrame:
    """Per level, the shift that puts the right share of held-out outcomes below it."""
    resid = held_out.select(
        *by, F.posexplode(F.transform(G.monotone(grid), lambda q: F.col(y) - q)).alias("_i", "_e")
    )
    n = len(G.LEVELS)
    # One level per position: ask each position only for its own level.
    rows = quantile_grid(resid, "_e", [0.0], [*by, "_i"], "_q", level=lambda total, _t: conformal_level(
        total, F.element_at(G.levels_array(), F.col("_i") + 1)
    ))
    packed = F.array_sort(F.collect_list(F.struct("_i", F.col("_q")[0].alias("d"))))
    return rows.groupBy(*by).agg(F.transform(packed, lambda s: s["d"]).alias(name)).where(F.size(name) == n)


def blend_predictions(preds: list[DataFrame], weights: list[float], keys: list[str]) -> DataFrame:
    """Weighted mean of the grids of several models, level by level."""
    out = preds[0].select(*keys, F.col("grid").alias("_g0"))
    for i, p in enumerate(preds[1:], 1):
        out = out.join(p.select(*keys, F.col("grid").alias(f"_g{i}")), keys)
    return out.select(*keys, G.blend([f"_g{i}" for i in range(len(preds))], weights).alias("grid"))


def neighbour_grids(neighbours: DataFrame, outcomes: DataFrame, by: list[str], y: str) -> DataFrame:
    """(by, id, grid): quantiles of the neighbours' outcomes, at most k per subject."""
    known = outcomes.select(F.col("id").alias("neighbour"), y)
    levels = F.array(*[F.lit(t) for t in G.LEVELS])
    return neighbours.join(known, "neighbour").groupBy(*by, "id").agg(F.percentile(y, levels).alias("grid"))


def backtest(models: dict[str, Callable[[], DataFrame]], y: str) -> DataFrame:
    """Out-of-sample predictions of several models in one frame, grids monotone, tagged by model.

    Each model returns (fold, id, y, grid); written out partitioned by model this is the cache.
    """
    out = None
    for name, run in models.items():
        p = run().select(F.lit(name).alias("model"), "fold", "id", y, G.monotone("grid").alias("grid"))
        out = p if out is None else out.unionByName(p)
    return out


def entity_scores(preds: DataFrame, y: str, star_cut: float, bust_cut: float) -> DataFrame:
    """Proper scores per prediction row."""
    g, out = "grid", F.col(y)
    return preds.withColumns(
        {
            "crps": G.crps(y, g),
            "pinball_floor": G.pinball(y, G.at_level(g, G.FLOOR), G.FLOOR),
            "pinball_median": G.pinball(y, G.at_level(g, G.MEDIAN), G.MEDIAN),
            "pinball_ceiling": G.pinball(y, G.at_level(g, G.CEILING), G.CEILING),
            "brier_star": G.brier(1 - G.cdf(g, F.lit(star_cut)), out >= star_cut),
            "brier_bust": G.brier(G.cdf(g, F.lit(bust_cut)), out < bust_cut),
            "below_floor": G.half_tie_below(y, G.at_level(g, G.FLOOR)),
            "above_ceiling": G.half_tie_above(y, G.at_level(g, G.CEILING)),
        }
    )


SCORES = [
    "crps", "pinball_floor", "pinball_median", "pinball_ceiling", "brier_star", "brier_bust",
    "below_floor", "above_ceiling",
]


def coverage_curve(preds: DataFrame, y: str, by: list[str] = []) -> DataFrame:
    """Observed share below each level, ties counting half."""
    levels = preds.select(*by, y, F.posexplode("grid").alias("_i", "_q"))
    tau = F.element_at(G.levels_array(), F.col("_i") + 1)
    return (
        levels.withColumn("level", tau)
        .groupBy(*by, "level")
        .agg(F.avg(G.half_tie_below(y, F.col("_q"))).alias("observed"), F.count(F.lit(1)).alias("n"))
    )


def verdict_label(lo: Column, hi: Column) -> Column:
    """Interval of a score difference, lower is better."""
    return F.when(hi < 0, "better").when(lo > 0, "worse").otherwise("no detectable difference")


def posterior(m0: Column, s0: Column, obs: Column, a: Column, b: Column, sigma: Column) -> dict[str, Column]:
    """Normal-normal update on the square-root scale; a null measurement leaves the prior."""
    info = (b * b) / (sigma * sigma)
    prior = 1 / (s0 * s0)
    prec = prior + info
    mean = (m0 * prior + b * (F.sqrt(F.greatest(obs, F.lit(0.0))) - a) / (sigma * sigma)) / prec
    seen = b.isNotNull() & obs.isNotNull()
    return {
        "post_mean": F.when(seen, mean).otherwise(m0),
        "post_sd": F.when(seen, F.sqrt(1 / prec)).otherwise(s0),
        "data_weight": F.when(seen, info / prec).otherwise(F.lit(0.0)),
    }


def normal_grid(mean: Column, sd: Column) -> Column:
    """Grid of a normal on the square-root scale, squared back."""
    from statistics import NormalDist

    z = F.array(*[F.lit(NormalDist().inv_cdf(t)) for t in G.LEVELS])
    return F.transform(z, lambda v: F.pow(F.greatest(mean + v * sd, F.lit(0.0)), F.lit(2.0)))


def error_grid(mean: Column, resid: Column) -> Column:
    """Grid from empirical errors on the square-root scale."""
    return F.transform(resid, lambda e: F.pow(F.greatest(mean + e, F.lit(0.0)), F.lit(2.0)))


def isotonic_decreasing(blocks: Column) -> Column:
    """Non-increasing least-squares fit of an ordered array of structs (x, v), by min-max of means.

    The i-th fit is min over a <= i of max over b >= i of mean(v[a..b]), for arrays of slot length.
    """
    v = F.transform(blocks, lambda s: s["v"])
    n = F.size(v)

    def at(i: Column) -> Column:
        def from_a(a: Column) -> Column:
            means = F.transform(
                F.sequence(i, n),
                lambda b: let(F.slice(v, a, b - a + 1), lambda part: G.mean(part)),
            )
            return F.array_max(means)

        return F.array_min(F.transform(F.sequence(F.lit(1), i), from_a))

    return F.transform(F.sequence(F.lit(1), n), at)
