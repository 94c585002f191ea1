"""Quantile learners whose fold is a key: one call fits and predicts every fold.

A learner has a name and `predict(train, test)`. Both frames have `fold`, `id` and feature columns, the
training rows also the outcome `y` and their `cohort`; a training row appears once in each fold it may
serve. The result is (fold, id, grid), one row per test row with a fold that has training rows. The number
of Spark jobs does not depend on the number of folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import partial
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grids as G
from ..session import cut_lineage, together
from . import forecast as FC
from . import grouped_trees as GT
from . import neighbours as NB


class Learner(Protocol):
    name: str

    def predict(self, train: DataFrame, test: DataFrame) -> DataFrame: ...


def known(train: DataFrame) -> DataFrame:
    return train.where(F.col("y").isNotNull())


@dataclass(frozen=True)
class SlotLearner:
    """Quantiles of the k training rows with the nearest slots."""

    slot: str = "slot"
    k: int = 60
    name: str = "slot"

    def predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        rows = known(train).withColumn("_own", F.col("fold"))
        pool, sizes = NB.slot_pool(rows, "_own", self.slot, "y", "id", self.k)
        roles = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n_train")).select(
            "fold", F.col("fold").alias("_own"), "n_train", F.lit("fit").alias("role"))
        slots = test.where(F.col(self.slot).isNotNull()).select(self.slot)
        grids = NB.slot_grids(pool, sizes, roles, slots, "_own", self.slot, "y", "id", self.k, G.LEVELS)
        return test.select("fold", "id", self.slot).join(grids, ["fold", self.slot]).select("fold", "id", "grid")


def ridge_weights(train: DataFrame, features: list[str], alphas: list[float]) -> dict:
    """Per fold |ridge coefficient| of each standardised feature, scaled to sum sqrt(p); alpha by leave-one-out.

    Tasks return moments and errors by fold; p x p matrices per fold reach the driver.
    """
    z = NB.standardised(train, features, ["fold"], train).select("fold", "vec", F.col("y").cast("double").alias("y"))
    p = len(features)

    def parts(b: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        folds = np.array(b.column("fold").to_pylist(), object)
        x = np.array([[np.nan if v is None else v for v in row] for row in b.column("vec").to_pylist()], float).reshape(-1, p)
        x, y = np.nan_to_num(x), b.column("y").to_numpy(zero_copy_only=False)  # standardised: 0 is the mean
        for f in dict.fromkeys(folds):
            yield f, x[folds == f], y[folds == f]

    kind = z.schema["fold"].dataType.simpleString()
    names = ["fold", "i", "v"]

    def sums(of) -> dict:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for f, x, y in parts(b):
                    v = of(f, x, y)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f] * len(v), b.schema.field("fold").type), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=names)

        rows = z.mapInArrow(run, f"fold {kind}, i int, v double").groupBy("fold", "i").agg(F.sum("v").alias("v")).collect()
        out: dict = {}
        for r in sorted(rows, key=lambda r: r.i):
            out.setdefault(r.fold, []).append(r.v)
        return out

    def moments(f, x, y):
        full = np.column_stack([x, np.ones(len(x)), y])
        return (full.T @ full).ravel()

    fits = {}
    for f, m in sums(moments).items():
        m = np.array(m).reshape(p + 2, p + 2)
        n, mean = m[p, p], m[p] / m[p, p]
        c = m - n * np.outer(mean, mean)
        inverse = [np.linalg.inv(c[:p, :p] + a * np.eye(p)) for a in alphas]
        fits[f] = n, mean, inverse, [inv @ c[:p, p + 1] for inv in inverse]

    def errors(f, x, y):
        n, mean, inverse, coefs = fits[f]
        x, r = x - mean[:p], y - mean[p + 1]
        return [(((r - x @ w) / (1 - 1 / n - np.einsum("ij,jk,ik->i", x, inv, x))) ** 2).sum() for inv, w in zip(inverse, coefs)]

    out = {}
    for f, loss in sums(errors).items():
        w = np.abs(fits[f][3][int(np.argmin(loss))])
        out[f] = [float(v) for v in w / w.sum() * np.sqrt(p)]
    return out


def by_fold(values: dict) -> Column:
    """A driver-side value per fold as a column (folds are few)."""
    pairs = [x for f, v in values.items() for x in (F.lit(f), F.array(*[F.lit(e) for e in v]))]
    return F.create_map(*pairs)[F.col("fold")]


ALPHAS = [10 ** (-1 + 4 * i / 19) for i in range(20)]


@dataclass(frozen=True)
class NeighbourLearner:
    """Quantiles of the k nearest training rows by standardised features, weighted by a ridge fit of the fold if `weighted`."""

    features: list[str]
    k: int = 30
    weighted: bool = False
    space: NB.Space = field(default_factory=NB.Space)
    guards: tuple[str, ...] = ()
    name: str = "stats neighbours"

    def neighbours(self, train: DataFrame, test: DataFrame) -> DataFrame:
        train = known(train)
        cols = ["fold", "id", "vec", *self.guards]
        pool = NB.standardised(train, self.features, ["fold"], train).select(*cols)
        subjects = NB.standardised(test, self.features, ["fold"], train).select(*cols)
        if self.weighted:
            w = by_fold(ridge_weights(train, self.features, ALPHAS))
            pool, subjects = (d.withColumn("vec", F.zip_with("vec", w, lambda v, x: v * x)) for d in (pool, subjects))
        return NB.nearest(subjects, pool, self.space, self.k, ["fold"], "id")

    def predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        return grids_of(self.neighbours(train, test), train)


def grids_of(near: DataFrame, train: DataFrame) -> DataFrame:
    outcomes = known(train).select("fold", F.col("id").alias("neighbour"), "y")
    levels = F.array(*[F.lit(t) for t in G.LEVELS])
    return near.select("fold", "id", "neighbour").join(outcomes, ["fold", "neighbour"]).groupBy("fold", "id").agg(F.percentile("y", levels).alias("grid"))


@dataclass(frozen=True)
class TreeProximityLearner:
    """Quantiles of the k training rows that share most leaves of boosted trees.

    Leaves are one-hot, so one minus the cosine is the share of trees with different leaves and the
    feature-space neighbour join applies unchanged.
    """

    features: list[str]
    growth: GT.Growth = GT.Growth(trees=20, depth=3, rate=0.1)
    k: int = 30
    name: str = "tree-proximity neighbours"

    def neighbours(self, train: DataFrame, test: DataFrame) -> DataFrame:
        train = known(train)
        grove, _ = GT.grow(train, self.features, "y", self.growth)
        ends = range(self.growth.nodes)

        def coded(rows: DataFrame) -> DataFrame:
            hot = F.flatten(F.transform("leaf", lambda v: F.transform(F.array(*[F.lit(n) for n in ends]), lambda n: (v == n).cast("double"))))
            return GT.leaves(rows, grove, ["id"]).select("fold", "id", hot.alias("vec"))

        return NB.nearest(coded(test), coded(train), NB.Space(cosine=True), self.k, ["fold"], "id", walk=True)

    def predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        return grids_of(self.neighbours(train, test), train)


@dataclass(frozen=True)
class ForestLearner:
    """Quantile regression forest."""

    features: list[str]
    growth: GT.Growth = GT.Growth(share=1 / 3)
    name: str = "quantile forest"

    def predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        return GT.forest_grids(known(train), test, self.features, "y", self.growth).select("fold", "id", "grid")


@dataclass(frozen=True)
class BlendLearner:
    """Weighted mean of the grids of several learners, level by level."""

    parts: list[Learner]
    weights: list[float]
    name: str = "blend"

    def predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        grids = together(train.sparkSession, [partial(p.predict, train, test) for p in self.parts])
        return FC.blend_predictions(grids, self.weights, ["fold", "id"])


@dataclass(frozen=True)
class ConformalLearner:
    """A learner shifted level by level to cover the latest training cohorts of each fold.

    Those cohorts are kept out of its fit. A fold with fewer than calib + min_fit training cohorts is
    fitted on all of them and not shifted. Shifted grids do not fall below 0.
    """

    inner: Learner
    calib: int = 1
    min_fit: int = 1

    @property
    def name(self) -> str:
        return f"{self.inner.name} + conformal"

    def predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        train = known(train)
        cohorts = train.groupBy("fold", "cohort").agg(F.lit(1).alias("_1"))  # one row per fold and cohort
        per = Window.partitionBy("fold")
        recent = F.row_number().over(per.orderBy(F.col("cohort").desc())) <= self.calib
        roles = cohorts.select("fold", "cohort", (recent & (F.count(F.lit(1)).over(per) >= self.calib + self.min_fit)).alias("_held"))
        train = train.join(roles, ["fold", "cohort"])
        held = train.where("_held").drop("_held")
        both = test.withColumn("_test", F.lit(True)).unionByName(held.withColumn("_test", F.lit(False)), allowMissingColumns=True)
        grids = cut_lineage(self.inner.predict(train.where("NOT _held").drop("_held"), both))
        delta = FC.conformal_shift(held.select("fold", "id", "y").join(grids, ["fold", "id"]), "grid", "y", ["fold"])
        found = test.select("fold", "id").join(grids, ["fold", "id"]).join(delta, "fold", "left")
        moved = G.clamp_below(G.shift(G.monotone("grid"), "delta"), F.lit(0.0))
        return found.select("fold", "id", F.when(F.col("delta").isNull(), G.monotone("grid")).otherwise(moved).alias("grid"))


def backtest(learners: list[Learner], train: DataFrame, test: DataFrame) -> DataFrame:
    """(model, fold, id, y, grid) of every learner, grids monotone, each learner's predictions written out once.

    A part of a blend that is itself in the list is not fitted again. Learners that need no other are
    fitted side by side, blends when their parts are there.
    """
    alone: dict[str, Learner] = {}

    def gather(learner: Learner) -> None:
        if isinstance(learner, BlendLearner):
            for p in learner.parts:
                gather(p)
        else:
            alone.setdefault(learner.name, learner)

    for learner in learners:
        gather(learner)
    grids = together(train.sparkSession, [lambda m=m: cut_lineage(m.predict(train, test)) for m in alone.values()])
    done = dict(zip(alone, grids, strict=True))

    def predicted(learner: Learner) -> DataFrame:
        if learner.name not in done:
            if isinstance(learner, BlendLearner):
                learner = replace(learner, parts=[_Ready(p.name, predicted(p)) for p in learner.parts])
            done[learner.name] = cut_lineage(learner.predict(train, test))
        return done[learner.name]

    out = None
    outcomes = test.select("fold", "id", "y")
    for learner in learners:
        rows = predicted(learner).join(outcomes, ["fold", "id"]).select(
            F.lit(learner.name).alias("model"), "fold", "id", "y", G.monotone("grid").alias("grid"))
        out = rows if out is None else out.unionByName(rows)
    return out


@dataclass(frozen=True)
class _Ready:
    name: str
    grids: DataFrame

    def predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        return self.grids


def compare(scores: DataFrame, pairs: dict[str, tuple[str, str]], reps: int, key: str = "id", score: str = "crps") -> DataFrame:
    """(comparison, n, diff, lo, hi, verdict): paired bootstrap of model a minus model b for every named pair, in one job."""
    from . import resample as RS

    rows = F.array(*[F.struct(F.lit(name).alias("comparison"), F.lit(a).alias("a"), F.lit(b).alias("b")) for name, (a, b) in pairs.items()])
    wide = scores.where(F.col("model").isin(*{m for p in pairs.values() for m in p})).groupBy("fold", key).agg(
        F.map_from_entries(F.collect_list(F.struct("model", score))).alias("_s"))  # one entry a model
    each = wide.withColumn("_p", F.explode(rows)).select(
        key, "_p.comparison", (F.try_element_at("_s", F.col("_p.a")) - F.try_element_at("_s", F.col("_p.b"))).alias("diff"))
    out = RS.bootstrap_mean(each.where("diff is not null"), key, ["diff"], ["comparison"], reps)
    lo, hi = F.round("diff_lo", 9), F.round("diff_hi", 9)
    return out.select("comparison", "n", "diff", F.col("diff_lo").alias("lo"), F.col("diff_hi").alias("hi"), FC.verdict_label(lo, hi).alias("verdict"))
