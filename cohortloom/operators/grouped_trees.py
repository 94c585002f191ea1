"""Regression trees of many training sets at once, grown level by level from shared histograms.

A training set is a fold, or a fold seen through one of several feature lists (a variant). Rows carry
their fold as a key and features as small bin numbers. One job per level counts weight and outcome by
(set, tree, node, feature, bin) inside the tasks, and one shuffle of those counts picks the best split of
every open node of every tree of every set. The number of jobs depends on depth (and, when boosting, on
the number of trees), never on the number of folds or variants.

What reaches the driver or travels to tasks is bounded by the plan: sets x trees x 2 ** depth nodes.
Outcomes are whole multiples of UNIT, so sums are exact and a grove is the same on any partitioning. A
missing feature is bin 0, below all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grids as G
from ..session import cut_lineage
from .ranking import quantile_grid
from .resample import numeric_key, replicate_weights

#: Outcomes are counted in multiples of this.
UNIT = 1e-7


@dataclass(frozen=True)
class Growth:
    trees: int = 20
    depth: int = 4
    min_leaf: int = 20
    bins: int = 32  # at most 255
    share: float = 1.0  # of a variant's features that a node may split on
    rate: float | None = None  # boost with this step; otherwise a forest of resampled trees
    seed: int = 0

    @property
    def nodes(self) -> int:
        return 2 ** (self.depth + 1) - 1


@dataclass
class Grove:
    """Trees by (set, tree, node): children of node i are 2i + 1 and 2i + 2."""

    growth: Growth
    folds: list
    sets: list[tuple[str, int]]  # variant and place of the fold
    features: list[str]
    allowed: dict[str, list[int]]
    cuts: list[list[np.ndarray]]  # by fold and feature, rising
    base: np.ndarray  # by fold, in units
    feature: np.ndarray = field(init=False)  # -1: a leaf
    cut: np.ndarray = field(init=False)  # rows of this bin or a lower one go left
    value: np.ndarray = field(init=False)  # what a leaf of a boosted tree adds, in units
    gain: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        shape = (len(self.sets), self.growth.trees, self.growth.nodes)
        self.feature, self.cut = np.full(shape, -1, np.int16), np.zeros(shape, np.int16)
        self.value, self.gain = np.zeros(shape, np.int64), np.zeros(shape)

    def walk(self, s: int, t: int, bins: np.ndarray) -> np.ndarray:
        """The node that each row has come to in a tree."""
        node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.growth.depth):
            f = self.feature[s, t, node]
            right = bins[every, np.maximum(f, 0)] > self.cut[s, t, node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def boosted(self, s: int, bins: np.ndarray, trees: int) -> np.ndarray:
        """Sum of the first trees of a set, in units."""
        total = np.full(len(bins), self.base[self.sets[s][1]])
        for t in range(trees):
            total += self.value[s, t, self.walk(s, t, bins)]
        return total

    def chosen(self, s: int, t: int, node: int) -> np.ndarray:
        """The features that a node may split on."""
        own = self.allowed[self.sets[s][0]]
        rng = np.random.default_rng((self.growth.seed, s, t, node))
        return np.sort(rng.permutation(own)[: max(1, math.ceil(self.growth.share * len(own)))])

    def importances(self) -> dict[tuple[str, object], dict[str, float]]:
        """Share of the splits' gain by (variant, fold) and feature."""
        out = {}
        for s, (variant, f) in enumerate(self.sets):
            sums = np.bincount(np.maximum(self.feature[s], 0).ravel(), self.gain[s].ravel(), len(self.features))
            out[variant, self.folds[f]] = {self.features[j]: float(sums[j] / (sums.sum() or 1.0)) for j in self.allowed[variant]}
        return out


def binned(rows: DataFrame, grove: Grove, fold: str, keep: list[str]) -> DataFrame:
    """`keep` columns, place of the fold and the features' bins; rows of other folds are dropped."""
    x = [F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(grove.features)]
    known = rows.where(F.col(fold).isin(grove.folds))
    src = known.select(*keep, F.col(fold).alias("_f"), *x)
    schema = T.StructType([*(src.schema[c] for c in keep), T.StructField("_fold", T.ShortType()), T.StructField("_bins", T.BinaryType())])
    place, cuts, width = {f: i for i, f in enumerate(grove.folds)}, grove.cuts, len(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([place[f] for f in b.column("_f").to_pylist()], np.int16)
            bins = np.zeros((b.num_rows, width), np.uint8)
            for j in range(width):
                v = b.column(f"_x{j}").to_numpy(zero_copy_only=False)
                for f in np.unique(at):
                    own = np.flatnonzero((at == f) & ~np.isnan(v))
                    bins[own, j] = 1 + np.searchsorted(cuts[f][j], v[own], side="left")
            packed = pa.array([row.tobytes() for row in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(at), packed], names=schema.names)

    return src.mapInArrow(run, schema)


def _bins(b: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("_bins").to_pylist()), np.uint8).reshape(b.num_rows, width)


def _counts(train: DataFrame, grove: Grove, level: int, trees: range) -> DataFrame:
    """(s, t, node, feature, bin, w, y): weight and outcome of the open nodes of a level, one row a task."""
    g, width, size = grove.growth, len(grove.features), grove.growth.bins + 1
    first, count = 2**level - 1, 2**level
    free = np.zeros((len(grove.sets), g.trees, count, width), bool)
    for s in range(len(grove.sets)):
        for t in trees:
            for n in range(count):
                if not level or grove.feature[s, t, (first + n - 1) // 2] >= 0:
                    free[s, t, n, grove.chosen(s, t, first + n)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            at, bins = b.column("_fold").to_numpy(), _bins(b, width)
            y, keys = b.column("_y").to_numpy(), b.column("_key").to_numpy()
            for s, (_, f) in enumerate(grove.sets):
                own = np.flatnonzero(at == f)
                if not len(own):
                    continue
                x, target = bins[own], y[own]
                if g.rate is None:
                    weights = replicate_weights(keys[own], g.trees, g.seed)
                else:
                    target, weights = target - grove.boosted(s, x, trees.start), None
                for t in trees:
                    w = np.ones(len(own), np.int64) if weights is None else weights[:, t]
                    node = grove.walk(s, t, x) - first
                    here = np.flatnonzero((node >= 0) & (w > 0))
                    held = cells.setdefault((s, t), np.zeros((2, width, count * size), np.int64))
                    for j in range(width):
                        rows = here[free[s, t, node[here], j]]
                        if len(rows):
                            spot = node[rows] * size + x[rows, j]
                            held[0, j] += np.bincount(spot, w[rows], count * size).astype(np.int64)
                            held[1, j] += np.bincount(spot, w[rows] * target[rows], count * size).astype(np.int64)
        for (s, t), held in cells.items():
            j, spot = np.nonzero(held[0])
            same = [pa.array(np.full(len(j), v, np.int32)) for v in (s, t)]
            yield pa.RecordBatch.from_arrays(
                [*same, *(pa.array(v.astype(np.int32)) for v in (first + spot // size, j, spot % size)), pa.array(held[0, j, spot]), pa.array(held[1, j, spot])],
                names=["s", "t", "node", "feature", "bin", "w", "y"])

    parts = train.mapInArrow(run, "s int, t int, node int, feature int, bin int, w bigint, y bigint")
    # One exchange serves the sums, the running sums and the choice.
    return parts.repartition("s", "t", "node").groupBy("s", "t", "node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("y").alias("y"))


def _splits(counts: DataFrame, min_leaf: int) -> list:
    """The best split of each node: most gain, then the lower feature and bin. One row a node."""
    whole = Window.partitionBy("s", "t", "node", "feature")
    upto = whole.orderBy("bin")
    c = counts.select("s", "t", "node", "feature", "bin", F.sum("w").over(upto).alias("wl"), F.sum("y").over(upto).alias("yl"),
                      F.sum("w").over(whole).alias("w"), F.sum("y").over(whole).alias("y"))
    c = c.where((F.col("wl") >= min_leaf) & (F.col("w") - F.col("wl") >= min_leaf))

    def part(y, w):
        return y.cast("double") * y.cast("double") / w

    y, w, yl, wl = (F.col(n) for n in ("y", "w", "yl", "wl"))
    c = c.withColumn("gain", (part(yl, wl) + part(y - yl, w - wl) - part(y, w)) * UNIT * UNIT)
    found = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "wl", "yl", "w", "y"))
    return c.where("gain > 1e-9").groupBy("s", "t", "node").agg(found.alias("x")).select("s", "t", "node", "x.*").collect()


def grow(
    train: DataFrame, features: list[str], y: str, growth: Growth, key: str = "id", fold: str = "fold",
    variants: dict[str, list[str]] | None = None,
) -> tuple[Grove, DataFrame]:
    """(grove, binned training rows) of every fold of `train` and every variant's features.

    Rows without an outcome are not used; features that are null count as missing. `key` seeds the
    resampling weights of a forest, so that a row weighs the same in every set. Raises without rows.
    """
    known = train.where(F.col(y).isNotNull() & F.col(fold).isNotNull())
    unit = F.round(F.col(y) / UNIT).cast("bigint")
    stats = known.groupBy(fold).agg(F.sum(unit).alias("y"), F.count(F.lit(1)).alias("n")).orderBy(fold).collect()  # one row a fold
    if not stats:
        raise ValueError("no training row has an outcome")
    folds = [r[fold] for r in stats]
    long = known.select(fold, *[F.col(c).cast("double").alias(c) for c in features]).unpivot([fold], features, "feature", "v")
    taus = [i / growth.bins for i in range(1, growth.bins)]
    grids = {(r[fold], r.feature): r.grid for r in quantile_grid(long.where("v is not null"), "v", taus, [fold, "feature"]).collect()}
    cuts = [[np.unique(np.array(grids.get((f, c)) or [], float)) for c in features] for f in folds]
    named = variants or {"all": features}
    grove = Grove(
        growth, folds, [(v, f) for v in named for f in range(len(folds))], features,
        {v: [features.index(c) for c in cs] for v, cs in named.items()}, cuts,
        np.array([round(r.y / r.n) if growth.rate is not None else 0 for r in stats], np.int64))
    rows = known.withColumns({"_y": unit, "_key": numeric_key(known, key)})
    rows = cut_lineage(binned(rows, grove, fold, ["_y", "_key"]))
    rounds = [range(growth.trees)] if growth.rate is None else [range(t, t + 1) for t in range(growth.trees)]
    for trees in rounds:
        for level in range(growth.depth):
            best = _splits(_counts(rows, grove, level, trees), growth.min_leaf)
            if not best:
                break
            for r in best:
                at = r.s, r.t, r.node
                grove.feature[at], grove.cut[at], grove.gain[at] = -r.f, -r.b, r.gain
                if growth.rate is not None:
                    for child, (total, n) in enumerate(((r.yl, r.wl), (r.y - r.yl, r.w - r.wl)), 1):
                        grove.value[r.s, r.t, 2 * r.node + child] = round(growth.rate * total / n)
    return grove, rows


def leaves(rows: DataFrame, grove: Grove, keep: list[str], fold: str = "fold") -> DataFrame:
    """(keep, fold, variant, leaf): the node of every tree, one row per variant."""
    return _applied(rows, grove, keep, fold, "leaf", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()),
                    lambda s, bins: list(np.stack([grove.walk(s, t, bins) for t in range(grove.growth.trees)], 1).astype(np.int32)))


def predictions(rows: DataFrame, grove: Grove, keep: list[str], fold: str = "fold") -> DataFrame:
    """(keep, fold, variant, prediction) of a boosted grove."""
    return _applied(rows, grove, keep, fold, "prediction", T.DoubleType(), pa.float64(),
                    lambda s, bins: list(grove.boosted(s, bins, grove.growth.trees) * UNIT))


def _applied(rows, grove, keep, fold, name, kind, arrow, of) -> DataFrame:
    ready = binned(rows, grove, fold, [*keep, fold])
    schema = T.StructType([*(ready.schema[c] for c in [*keep, fold]), T.StructField("variant", T.StringType()), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, bins = b.column("_fold").to_numpy(), _bins(b, len(grove.features))
            for s, (variant, f) in enumerate(grove.sets):
                own = np.flatnonzero(at == f)
                if len(own):
                    part = b.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in [*keep, fold]), pa.array([variant] * len(own)), pa.array(of(s, bins[own]), arrow)], names=schema.names)

    return ready.mapInArrow(run, schema)


def leaf_shares(binned_rows: DataFrame, grove: Grove, cuts: np.ndarray) -> np.ndarray:
    """(set, tree, node, cut): share of a leaf's training outcomes at or below each cut of its fold.

    Bounded by the plan: sets x trees x nodes x cuts numbers.
    """
    width, shape = len(grove.features), (len(grove.sets), grove.growth.trees, grove.growth.nodes, cuts.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            at, bins, y = b.column("_fold").to_numpy(), _bins(b, width), b.column("_y").to_numpy() * UNIT
            for s, (_, f) in enumerate(grove.sets):
                own = np.flatnonzero(at == f)
                # A cut is met up to rounding: cuts are outcomes, or lie between two.
                place = np.minimum(np.searchsorted(cuts[f], y[own] - UNIT, side="left"), shape[3] - 1)
                for t in range(shape[1]) if len(own) else ():
                    held = cells.setdefault((s, t), np.zeros(shape[2] * shape[3], np.int64))
                    held += np.bincount(grove.walk(s, t, bins[own]) * shape[3] + place, minlength=len(held))
        for (s, t), held in cells.items():
            spot = np.flatnonzero(held)
            at = (s * shape[1] + t) * len(held) + spot
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[spot])], names=["at", "n"])

    got = binned_rows.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(math.prod(shape))
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    out = out.reshape(shape)
    return np.cumsum(out, axis=3) / np.maximum(out.sum(3, keepdims=True), 1)


def forest_grids(
    train: DataFrame, test: DataFrame, features: list[str], y: str, growth: Growth = Growth(share=1 / 3), points: int = 99,
    key: str = "id", fold: str = "fold", variants: dict[str, list[str]] | None = None,
) -> DataFrame:
    """(fold, variant, key, grid): quantile regression forests of all folds and variants.

    Each leaf keeps its share of training outcomes at or below the ends and `points` exact quantiles of
    its fold; a row averages the shares of its trees' leaves and inverts them, linearly between cuts.
    """
    grove, rows = grow(train, features, y, growth, key, fold, variants)
    taus = [i / (points + 1) for i in range(points + 2)]
    known = train.where(F.col(y).isNotNull()).select(fold, F.col(y).cast("double").alias(y))
    axes = {r[fold]: r.grid for r in quantile_grid(known, y, taus, [fold]).collect()}  # one row a fold
    cuts = np.array([axes[f] for f in grove.folds], float)
    shares = leaf_shares(rows, grove, cuts)

    def of(s: int, bins: np.ndarray) -> list:
        axis, n = cuts[grove.sets[s][1]], len(bins)
        cdf = sum(shares[s, t, grove.walk(s, t, bins)] for t in range(growth.trees)) / growth.trees
        out = np.empty((n, len(G.LEVELS)))
        for i, tau in enumerate(G.LEVELS):
            at = np.minimum((cdf < tau - 1e-9).sum(1), len(axis) - 1)  # the first cut with a share of tau
            before = np.maximum(at - 1, 0)
            low, high = cdf[np.arange(n), before], cdf[np.arange(n), at]
            rise = (at > 0) & (high > low)
            part = np.where(rise, np.minimum((tau - low) / np.where(rise, high - low, 1.0), 1.0), 1.0)
            out[:, i] = axis[before] + (axis[at] - axis[before]) * part
        return list(out)

    return _applied(test, grove, [key], fold, "grid", T.ArrayType(T.DoubleType()), pa.list_(pa.float64()), of)
