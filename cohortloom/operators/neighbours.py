"""Nearest neighbours: along a slot axis, and in feature space.

Slot neighbours work on distinct slots and at most k rows per slot, so their cost does not grow
with the table. Feature-space neighbours are an exact k-nearest join by cells: training rows are
grouped around pivots, again and again until a cell holds a tile of rows, so cells grow in number
with the pool and not in size. Each cell keeps a bounding box. A subject first meets the cells
nearest to it; the distance of its k-th row there bounds which other cells can hold anything
nearer, and only those follow. Comparison runs on bounded tiles that return k rows per subject;
pairs are never written out. In many dimensions boxes bound little, and the join tends to all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage as staged
from .ranking import attach, top_k

# ------------------------------------------------------------------------ slot neighbours


def slot_pool(rows: DataFrame, cohort: str, slot: str, y: str, order: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(first k rows per cohort and slot in training order, row counts per cohort and slot)."""
    known = rows.where(F.col(y).isNotNull() & F.col(slot).isNotNull())
    sizes = known.groupBy(cohort, slot).agg(F.count(F.lit(1)).alias("_n"))
    first = top_k(known.select(cohort, slot, y, order), [cohort, slot], [F.col(order)], k, "_rn")
    return first.drop("_rn"), sizes


def slot_grids(
    pool: DataFrame, sizes: DataFrame, roles: DataFrame, slots: DataFrame, cohort: str, slot: str,
    y: str, order: str, k: int, levels: list[float], k_of_fold: Column | None = None,
) -> DataFrame:
    """(fold, slot, grid, k) for every slot of `slots`: quantiles of the k nearest outcomes.

    Nearest is |log slot - log slot'|, ties by training order. The k nearest rows lie within k
    distinct training slots on either side, so each subject slot meets at most 2k + 1 slots.
    """
    fit = roles.where("role = 'fit'").select("fold", cohort, "n_train")
    want = F.lit(k) if k_of_fold is None else k_of_fold
    per_fold = fit.select("fold", want.cast("int").alias("k")).distinct()
    counts = sizes.join(fit, cohort).groupBy("fold", slot).agg(F.sum("_n").alias("_n"))
    ordered = Window.partitionBy("fold").orderBy(slot)
    ranked = counts.withColumn("_r", F.row_number().over(ordered))
    # Position of each subject slot among the fold's training slots.
    subjects = slots.select(slot).distinct().withColumn("_subject", F.lit(True))
    folds = fit.agg(F.collect_set("fold")).scalar()
    subjects = subjects.withColumn("fold", F.explode(folds))
    both = ranked.select("fold", slot, "_r").join(subjects, ["fold", slot], "full")
    at = F.coalesce(F.max("_r").over(ordered.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    near = (
        both.withColumn("_at", at)
        .where("_subject")
        .withColumn("_r", F.explode(F.sequence(F.greatest(F.col("_at") - k, F.lit(1)), F.col("_at") + k + 1)))
        .select("fold", F.col(slot).alias("_slot"), "_r")
    )
    gap = F.abs(F.log(F.col("_slot").cast("double")) - F.log(F.col(slot).cast("double")))
    dist = F.round(gap * 1e9).cast("long")  # equal gaps tie exactly
    near = near.join(ranked, ["fold", "_r"]).withColumn("_d", dist).join(per_fold, "fold")
    closer = Window.partitionBy("fold", "_slot").orderBy("_d").rangeBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_closer", F.coalesce(F.sum("_n").over(closer), F.lit(0))).where("_closer < k")
    rows = near.join(pool.join(fit.drop("n_train"), cohort), ["fold", slot])
    best = Window.partitionBy("fold", "_slot").orderBy("_d", order)
    picked = rows.withColumn("_i", F.row_number().over(best)).where("_i <= k")
    return picked.groupBy("fold", F.col("_slot").alias(slot)).agg(
        F.percentile(y, F.array(*[F.lit(t) for t in levels])).alias("grid"),
        F.first("k").alias("k"),
    )


# --------------------------------------------------------------------- feature neighbours


@dataclass(frozen=True)
class Space:
    """How two feature vectors compare.

    weights       one factor per feature, applied to standardised values (0 drops it)
    min_overlap   share of the subject's features a row must share, else `penalty` is added
    same          columns that must agree, else `penalty` is added
    within        (column, width): a known difference above width adds `penalty`
    cosine        vectors are scaled to unit length first; distance is 1 - cosine
    exclude_self  a row is never its own neighbour
    parts         (start, stop, factor, space): distance is the sum of factor * distance in the
                  slice; spaces of slices carry their own weights, penalties and guards
    """

    features: list[str] = field(default_factory=list)
    weights: list[float] | None = None
    min_overlap: float = 0.7
    penalty: float = 1000.0
    same: list[str] = field(default_factory=list)
    within: tuple[str, float] | None = None
    cosine: bool = False
    exclude_self: bool = True
    parts: list[tuple[int, int, float, "Space"]] = field(default_factory=list)


def _matrix(vectors: pd.Series, space: Space) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=float) for v in vectors], dtype=float)
    if space.cosine:
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(norm > 0, norm, 1.0)
    if space.weights is not None:
        x = x * np.asarray(space.weights, dtype=float)
    return x


def _used(x: np.ndarray, space: Space) -> np.ndarray:
    has = ~np.isnan(x)
    if space.weights is not None:
        has &= np.asarray(space.weights, dtype=float) > 0
    return has


def _sliced(rows: pd.DataFrame, start: int, stop: int) -> pd.DataFrame:
    return rows.assign(vec=[np.asarray(v, dtype=float)[start:stop] for v in rows["vec"]])


#: Pairs whose distances are worked out at a time, so that they stay in cache; features up to which they are met one by one.
AT_ONCE, NARROW = 1 << 16, 8


@dataclass
class _Side:
    """Rows of one side of a tile as arrays, made once."""

    x: np.ndarray
    ids: np.ndarray
    guards: dict[str, np.ndarray]
    used: np.ndarray  # features of a weight above 0
    missing: np.ndarray  # features that some row may lack
    slices: list["_Side"] = field(default_factory=list)

    def rows(self, at: slice | np.ndarray) -> "_Side":
        return _Side(self.x[at], self.ids[at], {c: v[at] for c, v in self.guards.items()}, self.used, self.missing, [part.rows(at) for part in self.slices])


def _apart(s: _Side, p: _Side, space: Space) -> Space:
    """The same space; where no row is on both sides, without looking for such rows pair by pair."""
    return space if np.isin(s.ids, p.ids).any() else _unlike(space)


def _unlike(space: Space) -> Space:
    return replace(space, exclude_self=False, parts=[(start, stop, factor, _unlike(sub)) for start, stop, factor, sub in space.parts])


def _side(rows: pd.DataFrame, space: Space) -> _Side:
    if space.parts:
        return _Side(np.zeros((len(rows), 0)), rows["id"].to_numpy(), {}, np.zeros(0, bool), np.zeros(0, bool),
                     [_side(_sliced(rows, start, stop), sub) for start, stop, _, sub in space.parts])
    x = _matrix(rows["vec"], space)
    guards = {c: rows[c].to_numpy() for c in space.same}
    if space.within:
        guards[space.within[0] + " as number"] = rows[space.within[0]].to_numpy(float)
    used = np.ones(x.shape[1] if x.ndim > 1 else 0, bool) if space.weights is None else np.asarray(space.weights, float) > 0
    return _Side(x, rows["id"].to_numpy(), guards, used, np.isnan(x).any(axis=0))


def _distances(s: _Side, p: _Side, space: Space) -> np.ndarray:
    """Distances of every row of a side to every row of the other."""
    if space.parts:
        d = 0.0
        for (_, _, factor, sub), a, b in zip(space.parts, s.slices, p.slices, strict=True):
            d = d + factor * _distances(a, b, sub)
        return d
    n, m, width = len(s.x), len(p.x), s.x.shape[1]
    if space.cosine or width > NARROW:
        return _guarded(_wide(s.x, p.x, s.used, space), s, p, space)
    out = np.empty((n, m))
    step = max(AT_ONCE // max(m, 1), 1)
    missing = s.missing | p.missing
    own = space.min_overlap * np.maximum((~np.isnan(s.x) & s.used).sum(axis=1, keepdims=True), 1.0)
    for at in (slice(i, i + step) for i in range(0, n, step)):
        x, d = s.x[at], out[at]
        # Counts of features that both sides have: of all of them, and of those with a weight.
        shared = both = None
        d[:] = 0.0
        for j in range(width):
            gap = x[:, j, None] - p.x[None, :, j]
            if missing[j]:
                known = ~np.isnan(gap)
                np.copyto(gap, 0.0, where=~known)
                known = known.view(np.int8)
                shared = known.copy() if shared is None else np.add(shared, known, out=shared)
                if s.used[j]:
                    both = known.copy() if both is None else np.add(both, known, out=both)
            gap *= gap
            d += gap
        if shared is None:
            np.sqrt(d, out=d)
        else:
            with np.errstate(divide="ignore"):
                scale = width / (np.arange(missing.sum() + 1) + width - missing.sum())
            none = np.isinf(scale)
            scale[none] = 0.0
            d *= scale[shared]
            np.sqrt(d, out=d)
            if none.any():
                d += np.where(none, np.inf, 0.0)[shared]
        both = (s.used & ~missing).sum() + (0 if both is None else both)
        few = both < own[at]
        if few.any():
            d += space.penalty * few
        out[at] = _guarded(d, s.rows(at), p, space)
    return out


def _wide(a: np.ndarray, b: np.ndarray, used: np.ndarray, space: Space) -> np.ndarray:
    """Distances by matrix products."""
    ha, hb = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
    za, zb = np.where(ha > 0, a, 0.0), np.where(hb > 0, b, 0.0)
    if space.cosine:
        return 1.0 - za @ zb.T
    shared = ha @ hb.T
    sq = (za * za) @ hb.T + ha @ (zb * zb).T - 2 * (za @ zb.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.sqrt(np.maximum(sq, 0.0) * (a.shape[1] / shared))
    d = np.where(shared > 0, d, np.inf)
    ua, ub = ha * used, hb * used
    own = np.maximum(ua.sum(axis=1, keepdims=True), 1.0)
    return d + space.penalty * ((ua @ ub.T) < space.min_overlap * own)


def _guarded(d: np.ndarray, s: _Side, p: _Side, space: Space) -> np.ndarray:
    """Distances with the penalty of the guards, and none between a row and itself."""
    if space.same or space.within:
        guard = np.zeros(d.shape, dtype=bool)
        for c in space.same:
            guard |= s.guards[c][:, None] != p.guards[c][None, :]
        if space.within:
            c, width = space.within
            gap = np.abs(s.guards[c + " as number"][:, None] - p.guards[c + " as number"][None, :])
            guard |= gap > width  # unknown compares false
        d = d + space.penalty * guard
    if space.exclude_self:
        d = np.where(s.ids[:, None] == p.ids[None, :], np.inf, d)
    return d


def _tile_distances(s: pd.DataFrame, p: pd.DataFrame, space: Space) -> np.ndarray:
    """Distances of every subject of a tile to every row of it."""
    return _distances(_side(s, space), _side(p, space), space)


def _box_bounds(s: pd.DataFrame, cells: pd.DataFrame, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the distance from each subject to any row of each cell.

    Valid with missing features: dimensions always present in the cell bound from below,
    dimensions present at least once bound from above.
    """
    if space.parts:
        low = high = 0.0
        for start, stop, factor, sub in space.parts:
            cut = cells.assign(**{c: [np.asarray(v)[start:stop] for v in cells[c]] for c in ("lo", "hi", "always")})
            lo, hi = _box_bounds(_sliced(s, start, stop), cut, sub)
            low, high = low + factor * lo, high + factor * hi
        return low, high
    a = _matrix(s["vec"], space)
    lo = np.array([np.asarray(v, dtype=float) for v in cells["lo"]])
    hi = np.array([np.asarray(v, dtype=float) for v in cells["hi"]])
    always = np.array([np.asarray(v, dtype=bool) for v in cells["always"]])
    some = ~np.isnan(lo)
    low = np.empty((len(a), len(lo)))
    high = np.empty_like(low)
    width = a.shape[1]
    ua = _used(a, space)
    w_used = np.ones(width, bool) if space.weights is None else np.asarray(space.weights, float) > 0
    for j in range(len(lo)):  # a bounded number of cells
        has = ~np.isnan(a)
        gap = np.maximum(np.maximum(lo[j] - a, a - hi[j]), 0.0)
        far = np.maximum(np.abs(a - lo[j]), np.abs(a - hi[j]))
        sure, maybe = has & always[j], has & some[j]
        n_sure, n_maybe = sure.sum(axis=1), maybe.sum(axis=1)
        lsum = np.where(sure, gap, 0.0) ** 2
        usum = np.where(maybe, far, 0.0) ** 2
        if space.cosine:  # unit vectors: 1 - cos = |u - v|^2 / 2
            low[:, j], high[:, j] = lsum.sum(axis=1) / 2, np.minimum(usum.sum(axis=1) / 2, 2.0)
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            low[:, j] = np.where(n_maybe > 0, np.sqrt(lsum.sum(axis=1) * width / n_maybe), np.inf)
            high[:, j] = np.where(n_sure > 0, np.sqrt(usum.sum(axis=1) * width / n_sure), np.inf)
        own = space.min_overlap * np.maximum(ua.sum(axis=1), 1)
        most = (ua & some[j] & w_used).sum(axis=1)
        least = (ua & always[j] & w_used).sum(axis=1)
        low[:, j] += space.penalty * (most < own)
        high[:, j] += space.penalty * (least < own)
    # Guards and the subject's own row can only push a row back.
    guarded = space.same or space.within
    slack = 1e-9 + 1e-9 * np.where(np.isfinite(low), np.abs(low), 0.0)
    return low - slack, high + (space.penalty if guarded else 0.0) + 1e-9


def _guards(space: Space) -> list[str]:
    own = [*space.same, *([space.within[0]] if space.within else [])]
    return list(dict.fromkeys(own + [g for part in space.parts for g in _guards(part[3])]))


def distance_counts(
    subjects: DataFrame, pool: DataFrame, space: Space, by: list[str], decimals: int = 4,
    per_subject: bool = True, ordered: bool = False, below: float = np.inf, tile: int = 2048,
) -> DataFrame:
    """(by, [id], distance, n): how many pool rows lie at each rounded distance.

    For statistics over all pairs, such as the median distance to a pool: tiles of bounded size
    count distances and only counts leave them. `ordered` counts each unordered pair once.
    The work is the product of both sides by definition; the output is not.
    """
    guards = _guards(space)
    side = ["id", "vec", *guards]
    s, p = subjects.select(*by, *side), pool.select(*by, *side)

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))

    sizes = attach(parts(s, "_ns"), parts(p, "_np"), by, ["_np"])

    def placed(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        d = attach(df, sizes, by, ["_ns", "_np"]).withColumn(own, F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("_ns", "_np")

    left, right = placed(s, "_i", "_ns", "_j", "_np"), placed(p, "_j", "_np", "_i", "_ns")
    keys = "".join(f"{b} {p.schema[b].dataType.simpleString()}, " for b in by)
    id_type = p.schema["id"].dataType.simpleString()
    scale = 10.0**decimals

    def count(rows: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        cols = [*by, *(["id"] if per_subject else []), "distance", "n"]
        if rows.empty or cand.empty:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in cols})
        d = _tile_distances(rows, cand, space)
        keep = np.isfinite(d) & (d < below)
        if ordered:
            keep &= rows["id"].to_numpy()[:, None] < cand["id"].to_numpy()[None, :]
        q = np.round(np.where(keep, d, 0.0) * scale).astype(np.int64)
        group = [rows[b].iloc[0] for b in by]
        if not per_subject:
            v, n = np.unique(q[keep], return_counts=True)
            return pd.DataFrame({**{b: [g] * len(v) for b, g in zip(by, group)}, "distance": v / scale, "n": n})
        out = []
        for i, sid in enumerate(rows["id"].to_numpy()):
            v, n = np.unique(q[i][keep[i]], return_counts=True)
            out.append(pd.DataFrame({"id": sid, "distance": v / scale, "n": n}))
        return pd.concat(out, ignore_index=True).assign(**dict(zip(by, group)))[cols]

    subject = f"id {id_type}, " if per_subject else ""
    counted = (
        left.groupBy(*by, "_i", "_j").cogroup(_renewed(right).groupBy(*by, "_i", "_j"))
        .applyInPandas(count, f"{keys}{subject}distance double, n long")
    )
    group = [*by, *(["id"] if per_subject else [])]
    return counted.groupBy(*group, "distance").agg(F.sum("n").alias("n"))


def ridge_weights(train: DataFrame, features: list[str], y: str, alphas: list[float]) -> list[float]:
    """|ridge coefficient| per standardised feature, scaled to sum sqrt(p); alpha by leave-one-out.

    Batches return moment and error sums; only p x p matrices reach the driver.
    """
    p = len(features)
    aggs = [f(c).alias(f"{t}{i}") for i, c in enumerate(features) for f, t in ((F.avg, "m"), (F.stddev_samp, "s"))]
    stats = train.agg(*aggs, F.avg(y).alias("y")).first()
    z = train.select(
        *[F.coalesce((F.col(c) - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)],
        F.col(y).cast("double").alias("y"),
    )
    cols = [f"x{i}" for i in range(p)]

    def moments(batches):
        for b in batches:
            x = np.column_stack([b[cols].to_numpy(float), np.ones(len(b)), b["y"].to_numpy(float)])
            yield pd.DataFrame({"i": np.arange((p + 2) ** 2), "v": (x.T @ x).ravel()})

    rows = z.mapInPandas(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    m = np.array([r["v"] for r in rows]).reshape(p + 2, p + 2)
    n, mean = m[p, p], m[p, : p + 2] / m[p, p]
    c = m / n - np.outer(mean, mean)
    gram, cross = n * c[:p, :p], n * c[:p, p + 1]
    inverse = [np.linalg.inv(gram + a * np.eye(p)) for a in alphas]
    coefs = [inv @ cross for inv in inverse]

    def errors(batches):
        for b in batches:
            x = b[cols].to_numpy(float) - mean[:p]
            r = b["y"].to_numpy(float) - mean[p + 1]
            loss = [
                (((r - x @ w) / (1 - 1 / n - np.einsum("ij,jk,ik->i", x, inv, x))) ** 2).sum()
                for inv, w in zip(inverse, coefs)
            ]
            yield pd.DataFrame({"i": np.arange(len(alphas)), "v": loss})

    best = z.mapInPandas(errors, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("v", "i").first()["i"]
    w = np.abs(coefs[best])
    return [float(v) for v in w / w.sum() * np.sqrt(p)]


def _renewed(df: DataFrame) -> DataFrame:
    """Same columns under new attribute ids, so both sides of a cogroup may share a source."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def chunked(rows: DataFrame, small: DataFrame, on: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """Cut a group into chunks of about `size` rows and repeat its small companion for each of them."""
    parts = rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_k"))
    chunk = F.pmod(F.xxhash64("id"), F.col("_k")).cast("int")
    repeat = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    return (
        attach(rows, parts, on, ["_k"]).withColumn("_chunk", chunk).drop("_k"),
        attach(small, parts, on, ["_k"]).withColumn("_chunk", repeat).drop("_k"),
    )


def cut_cells(
    rows: DataFrame, side: list[str], space: Space, by: list[str], pivots: int, tile: int, least: int = 0,
) -> tuple[DataFrame, int, int]:
    """(rows with _cell, base, depth): rows go to the nearest of a few pivots, and cells of more than a tile again.

    Pivots are rows in hash order; they only shape the cells. A cut multiplies the id by `base` and adds
    the place, so integer division finds the cell that a cell was cut from; all have had `depth` cuts.
    Groups of at most `least` rows are not cut.
    """
    first = [F.xxhash64("id"), F.col("id")]

    def assign(part: pd.DataFrame, piv: pd.DataFrame) -> pd.DataFrame:
        cols = [*by, *side, "_cell"]
        if part.empty:
            return part.assign(_cell=pd.Series(dtype="int64"))[cols]
        raw = _matrix(part["vec"], space)
        x, y = np.nan_to_num(raw), np.nan_to_num(_matrix(piv["_pv"], space))
        near = ((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :]).argmin(axis=1)
        missing = np.array([hash(tuple(m)) % 4 for m in np.isnan(raw)])
        return part[cols].assign(_cell=part["_cell"].to_numpy() * (4 * pivots) + near * 4 + missing)

    on = [*by, "_cell"]
    celled = rows.select(*by, *side).withColumn("_cell", F.lit(0).cast("long"))
    schema = celled.schema
    # A level cuts a cell by `pivots` or so; ids of cells stay within a long.
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    # Uneven pivots may need two levels more; points that are all equal are never cut, only dealt out.
    even = int(np.ceil(np.log(most / tile) / np.log(pivots))) if most > tile else 0
    base, depth = 4 * pivots, 0
    for level in range(min(even + 2, int(62 / np.log2(base))) if most > least else 0):
        sizes = celled.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        limit = tile if level else least
        large = sizes.where(F.col("_n") > limit).select(*on)
        if level and sizes.agg(F.max("_n")).first()[0] <= limit:
            break
        to_cut = celled.join(large, on, "left_semi")
        picks = top_k(to_cut, on, first, pivots, "_pivot").select(*on, F.col("vec").alias("_pv"))
        own, spread = chunked(to_cut, picks, on, 16 * tile)
        cut = own.groupBy(*on, "_chunk").cogroup(_renewed(spread).groupBy(*on, "_chunk")).applyInPandas(assign, schema)
        done = celled.join(large, on, "left_anti").withColumn("_cell", F.col("_cell") * base)
        celled = staged(cut.unionByName(done.select(*cut.columns)))
        depth += 1
    return celled, base, depth


def cell_dimensions(celled: DataFrame, space: Space, by: list[str]) -> DataFrame:
    """(by, _cell, _d, lo, hi, always, n): each side of each cell's box, from partial aggregates; always: no row misses it."""
    on = [*by, "_cell"]
    keys = "".join(f"{c} {celled.schema[c].dataType.simpleString()}, " for c in on)

    def part(batches):
        for rows in batches:
            x = _matrix(rows["vec"], space)
            own = rows[on].reset_index(drop=True)
            place = own.groupby(on, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(place, kind="stable")
            start = np.flatnonzero(np.diff(place[order], prepend=-1))
            x = x[order]
            out = own.iloc[order[start]].reset_index(drop=True)
            out["lo"], out["hi"] = list(np.fmin.reduceat(x, start)), list(np.fmax.reduceat(x, start))
            out["known"] = list(np.add.reduceat((~np.isnan(x)).astype(np.int64), start))
            out["n"] = np.diff(start, append=len(x))
            yield out

    parts = celled.select(*on, "vec").mapInPandas(part, f"{keys}lo array<double>, hi array<double>, known array<long>, n long")
    sides = parts.select(*on, "n", F.posexplode(F.arrays_zip("lo", "hi", "known")).alias("_d", "_x"))
    low, high = (F.when(~F.isnan(f"_x.{c}"), F.col(f"_x.{c}")) for c in ("lo", "hi"))
    return staged(
        sides.groupBy(*on, "_d")
        .agg(F.min(low).alias("lo"), F.max(high).alias("hi"), (F.sum("_x.known") == F.sum("n")).alias("always"), F.sum("n").alias("n"))
    )


def packed_boxes(dims: DataFrame, on: list[str]) -> DataFrame:
    """(on, lo, hi, always, n): boxes as arrays over dimensions."""
    packed = F.array_sort(F.collect_list(F.struct("_d", "lo", "hi", "always")))
    return dims.groupBy(*on).agg(
        F.transform(packed, lambda t: t["lo"]).alias("lo"),
        F.transform(packed, lambda t: t["hi"]).alias("hi"),
        F.transform(packed, lambda t: t["always"]).alias("always"),
        F.max("n").alias("n"),
    )


def barrier(space: Space) -> tuple[list[str], float]:
    """(columns that must agree, the least distance of a row where one of them does not)."""
    if not space.parts:
        return space.same, space.penalty
    held = [(sub.same, factor * sub.penalty) for _, _, factor, sub in space.parts if sub.same]
    return list(dict.fromkeys(c for same, _ in held for c in same)), min((cost for _, cost in held), default=0.0)


def nearest(
    subjects: DataFrame, pool: DataFrame, space: Space, k: int, by: list[str], order: str,
    pivots: int = 16, tile: int = 2048, meter=None, boxes_seen=None, walk: bool = False,
) -> DataFrame:
    """(by, id, rank, neighbour, distance): exact k nearest pool rows of each subject in its group.

    Cells, the cells that a subject may reach and its first neighbours are written out on the way
    where the session names a shared folder, as more than one step reads them.

    Both sides have columns `by`, `id`, `vec` (array of doubles, null = missing) and the guard
    columns; the pool also has `order`, the tie-break of equal distances. Accumulators `meter` and
    `boxes_seen` count the pairs and the boxes that subjects are compared with.

    With `walk` every subject first walks to one cell and meets it, and follows the tree with the distance of
    its k-th row there as a bound: for many dimensions, where boxes alone bound little.

    Where columns must agree, subjects first meet the rows that agree with them. One that has k of those
    nearer than the penalty is settled, since every other row is at least the penalty away; the others
    meet the whole group.
    """
    guards = _guards(space)
    side = list(dict.fromkeys([*by, "id", "vec", *guards]))
    s, p = subjects.select(*side), pool.select(*side, F.col(order).alias("_ord"))
    same, cost = barrier(space)
    same = [c for c in same if c not in by]
    if not same:
        return _nearest(s, p, space, k, by, pivots, tile, meter, boxes_seen, walk=walk).drop("_ord")
    # As group keys under other names, so that the columns stay among the guards.
    keys = {c: f"_same_{c}" for c in same}
    sk, pk = (d.withColumns({n: F.col(c) for c, n in keys.items()}) for d in (s, p))
    # Rows that agree are few: small groups are not cut.
    found = _nearest(sk, pk, space, k, [*by, *keys.values()], pivots, tile, meter, boxes_seen, tile, walk)
    found = staged(top_k(found.drop("rank", *keys.values()), [*by, "id"], [F.col("distance"), F.col("_ord")], k))
    settled = staged(found.where((F.col("rank") == k) & (F.col("distance") < cost - 1e-6)).select(*by, "id"))
    far = _nearest(staged(s.join(settled, [*by, "id"], "left_anti")), p, space, k, by, pivots, tile, meter, boxes_seen, walk=walk)
    return found.join(settled, [*by, "id"], "left_semi").unionByName(far).drop("_ord")


#: Tiles that a block of cells and a slice of subjects may hold.
BLOCK, SLICE = 8, 4


def _blocks(most: int, wide: int, pivots: int, base: int, depth: int) -> Column:
    """Number of the block of a cell: cells near each other in the tree, about `wide` rows together in a group of `most` rows."""
    if not depth:
        return F.lit(0).cast("long")
    level, rest = 1, most
    while level < depth and rest > wide * pivots:
        level, rest = level + 1, rest / pivots
    ways = int(min(max(np.ceil(rest / wide), 1), pivots))
    # Cells of one node of the level above are dealt by the place of their pivot.
    return F.expr(f"(_cell div {base ** (depth - level + 1)}) * {ways} + (((_cell div {base ** (depth - level)}) % {base}) div 4) % {ways}")


def _nearest(
    s: DataFrame, p: DataFrame, space: Space, k: int, by: list[str], pivots: int, tile: int, meter, boxes_seen, least: int = 0, walk: bool = False,
) -> DataFrame:
    """nearest, with the tie-break `_ord` as a column of the pool and of the result. Groups of at most `least` rows are not cut."""
    side = ["id", "vec", *_guards(space)]
    id_type = p.schema["id"].dataType.simpleString()
    keys = "".join(f"{b} {p.schema[b].dataType.simpleString()}, " for b in by)
    # Rows of subjects and cells carry the number of the subject; features are met where they are needed.
    features = staged(s.select(*by, *side).withColumn("_row", F.monotonically_increasing_id()))

    celled, base, depth = cut_cells(p, [*side, "_ord"], space, by, pivots, tile, least)

    # 1. Bounding box and size of each cell.
    dims = cell_dimensions(celled, space, by)

    def boxes(level: int) -> DataFrame:
        """Nodes of a level of the tree: cells that share their first cuts, under the node they were cut from."""
        node = F.expr(f"_cell div {base ** (depth - level)}")
        own = dims.withColumn("_node", node).groupBy(*by, "_node", "_d").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and("always").alias("always"), F.sum("n").alias("n"))
        return packed_boxes(own, [*by, "_node"]).withColumn("_up", F.expr(f"_node div {base}"))

    cells = staged(boxes(depth).select(*by, F.col("_node").alias("_cell"), "n"))

    # 2. Tiles: a bounded slice of a block of cells against a bounded slice of the subjects that follow any of them.
    wide = BLOCK * tile
    most = cells.groupBy(*by).agg(F.sum("n").alias("_n")).agg(F.max("_n")).first()[0] or 0
    block = _blocks(most, wide, pivots, base, depth)
    blocks = cells.groupBy(*by, block.alias("_block")).agg(F.ceil(F.sum("n") / wide).cast("int").alias("_parts"))
    tile_keys = [*by, "_block", "_part", "_slice"]
    ord_type = p.schema["_ord"].dataType.simpleString()

    def compare(rows: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        out = [*by, "id", "neighbour", "_ord", "distance"]
        if rows.empty or cand.empty:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in out})
        cand = cand.sort_values("_ord", kind="stable").reset_index(drop=True)
        own = cand["_cell"].to_numpy()
        left, right = _side(rows, space), _side(cand, space)
        follows, many = np.concatenate(rows["_cells"].to_numpy()), rows["_cells"].map(len).to_numpy()
        who = np.repeat(np.arange(len(rows)), many)[np.argsort(follows, kind="stable")]
        follows = np.sort(follows)
        # The k least distances that each row has met: nothing beyond the last of them is kept, or beyond one known before.
        least, known = np.full((len(rows), k), np.inf), rows["_kth"].to_numpy(float)
        known = np.where(np.isnan(known), np.inf, known)[:, None]
        found = []
        for cell in np.unique(own):
            at = np.flatnonzero(own == cell)
            ids = who[np.searchsorted(follows, cell) : np.searchsorted(follows, cell, side="right")]
            near, step = right.rows(at), max(AT_ONCE // len(at), 1)
            own_space = _apart(left.rows(ids), near, space)
            if meter is not None:
                meter.add(len(ids) * len(at))
            for part in (ids[i : i + step] for i in range(0, len(ids), step)):
                d = np.round(_distances(left.rows(part), near, own_space), 9)
                last = np.minimum(least[part, -1:], known[part])
                if k < d.shape[1] and np.isinf(last).any():
                    last = np.minimum(last, np.partition(d, k - 1, axis=1)[:, k - 1 : k])
                i, j = np.nonzero(np.isfinite(d) & (d <= last))
                if not len(i):
                    continue
                # The k least of each row, ties in the order of the candidates.
                v = d[i, j]
                order = np.lexsort((j, v, i))
                i, j, v = i[order], j[order], v[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, v, place = (x[place < k] for x in (i, j, v, place))
                mine = np.full((len(part), k), np.inf)
                mine[i, place] = v
                least[part] = np.sort(np.concatenate([least[part], mine], axis=1), axis=1)[:, :k]
                found.append((part[i], at[j], v))
        if not found:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in out})
        # The k least of all cells of the block.
        i, j, d = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((j, d, i))
        place = np.arange(len(order)) - np.searchsorted(i[order], i[order])
        order = order[place < k]
        got = rows.iloc[i[order]][[*by, "id"]].reset_index(drop=True)
        got["neighbour"] = cand["id"].to_numpy()[j[order]]
        got["_ord"] = cand["_ord"].to_numpy()[j[order]]
        got["distance"] = d[order]
        return got

    def compared(meets: DataFrame) -> DataFrame:
        # Dealt by subject once, for the groups and for their features.
        held = meets.repartition("_row").groupBy(*by, block.alias("_block"), "_row").agg(
            F.collect_list("_cell").alias("_cells"), F.min("_kth").alias("_kth"))
        n = F.count(F.lit(1))
        slices = F.greatest(F.least(F.ceil(n / tile), F.lit(8)), F.ceil(n / (SLICE * tile))).cast("int")
        load = held.groupBy(*by, "_block").agg(slices.alias("_slices")).join(blocks, [*by, "_block"])
        left = (
            held.join(features.select("_row", *side).hint("merge"), "_row")
            .join(load, [*by, "_block"])
            .withColumn("_slice", F.pmod(F.xxhash64("_row"), F.col("_slices")).cast("int"))
            .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
            .select(*tile_keys, "_cells", "_kth", *side)
        )
        right = (
            celled.withColumn("_block", block)
            .join(load, [*by, "_block"])
            .withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
            .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
            .select(*tile_keys, "_cell", "_ord", *side)
        )
        return (
            left.groupBy(*tile_keys).cogroup(_renewed(right).groupBy(*tile_keys))
            .applyInPandas(compare, f"{keys}id {id_type}, neighbour {id_type}, _ord {ord_type}, distance double")
        )

    # 3. Which cells can hold one of a subject's k nearest? Down the tree: a subject meets the children of
    # the nodes it still follows, at most `base` for each, and goes on with those that may be near enough.
    need = k + (1 if space.exclude_self else 0)

    def below(rows: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        out = [*by, "id", "_row", "_seed", "_bound", "_node", "_n", "_low", "_high"]
        if rows.empty or node.empty:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in out})
        if boxes_seen is not None:
            boxes_seen.add(len(rows) * len(node))
        low, high = _box_bounds(rows, node, space)
        size, bound = node["n"].to_numpy(), rows["_bound"].to_numpy(float)
        keep = np.isfinite(low) & (low <= bound[:, None] + 1e-9)
        if size.sum() >= need:  # the children alone may settle it
            by_high = np.argsort(high, axis=1, kind="stable")
            enough = np.cumsum(size[by_high], axis=1) >= need
            keep &= low <= np.take_along_axis(high, by_high, axis=1)[np.arange(len(rows)), enough.argmax(axis=1)][:, None]
        i, j = np.nonzero(keep)
        hit = rows.iloc[i][[*by, "id", "_row", "_seed", "_bound"]].reset_index(drop=True)
        hit["_node"], hit["_n"] = node["_node"].to_numpy()[j], size[j]
        hit["_low"], hit["_high"] = low[i, j], high[i, j]
        return hit

    def toward(rows: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        out = [*by, "id", "_row", "_node"]
        if rows.empty or node.empty:
            return rows.assign(_node=-1)[out]
        if boxes_seen is not None:
            boxes_seen.add(len(rows) * len(node))
        low, high = _box_bounds(rows, node, space)
        fits = np.isfinite(low) & (node["n"].to_numpy() >= need)
        least_low = np.where(fits, low, np.inf).min(axis=1)[:, None]
        best = np.where(fits & (low <= least_low), np.minimum(high, 1e300), np.inf).argmin(axis=1)
        return rows.assign(_node=np.where(fits.any(axis=1), node["_node"].to_numpy()[best], -1))[out]

    def beside(rows: DataFrame) -> DataFrame:
        return rows.join(features.select("_row", *side[1:]), "_row")

    best = [F.col("distance"), F.col("_ord")]
    infinite = F.lit(float("inf"))
    every = features.select(*by, "id", "_row")
    start, near = every.withColumn("_seed", F.lit(-1).cast("long")), None
    if walk and depth:
        start = every.withColumn("_up", F.lit(0).cast("long"))
        for level in range(1, depth + 1):
            rows_, spread = chunked(start, boxes(level), [*by, "_up"], 16 * tile)
            on = [*by, "_up", "_chunk"]
            met = beside(rows_).groupBy(*on).cogroup(_renewed(spread).groupBy(*on)).applyInPandas(toward, f"{keys}id {id_type}, _row long, _node long")
            start = staged(met.withColumnRenamed("_node", "_up"))
        start = start.withColumnRenamed("_up", "_seed")
        first = start.where("_seed >= 0").withColumn("_cell", F.col("_seed"))
        near = staged(top_k(compared(first.withColumn("_kth", F.lit(None).cast("double"))), [*by, "id"], best, k).drop("rank"))
        kth = near.groupBy(*by, "id").agg(F.max("distance").alias("_bound"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).drop("_n")
        start = start.join(kth, [*by, "id"], "left").withColumn("_bound", F.coalesce("_bound", infinite))
    else:
        start = start.withColumn("_bound", infinite)
    frontier = start.withColumn("_up", F.lit(0).cast("long"))
    if not depth:  # every group is one small cell
        frontier = frontier.withColumns({"_n": F.lit(0).cast("long"), "_low": F.lit(0.0)})
    one = Window.partitionBy(*by, "id")
    for level in range(1, depth + 1):
        rows_, spread = chunked(frontier, boxes(level), [*by, "_up"], 16 * tile)
        on = [*by, "_up", "_chunk"]
        met = beside(rows_).groupBy(*on).cogroup(_renewed(spread).groupBy(*on)).applyInPandas(
            below, f"{keys}id {id_type}, _row long, _seed long, _bound double, _node long, _n long, _low double, _high double")
        # The bound so far: nodes that reach no further hold enough rows. Nodes that start beyond it are left.
        held = F.sum("_n").over(one.orderBy("_high", "_node").rowsBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("_reach", F.when(held >= need, F.col("_high")))
        met = met.withColumn("_reach", F.min("_reach").over(one)).where(F.col("_reach").isNull() | (F.col("_low") <= F.col("_reach")))
        frontier = staged(met.select(*by, "id", "_row", "_seed", "_bound", F.col("_node").alias("_up"), "_n", "_low"))
    # Nearest cells first, until they hold enough rows.
    before = F.coalesce(F.sum("_n").over(one.orderBy("_low", "_up").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = frontier.withColumn("_first", before < need).where("_up <> _seed").withColumnRenamed("_up", "_cell")

    closest = compared(reach.where("_first").withColumn("_kth", F.lit(None).cast("double")))
    near = staged(top_k(closest if near is None else near.unionByName(closest), [*by, "id"], best, k))
    kth = near.where(F.col("rank") == k).select(*by, "id", F.col("distance").alias("_kth"))
    others = reach.where("not _first").join(kth, [*by, "id"], "left")
    # Distances are compared at nine decimals; a cell that may tie with the k-th row is looked at.
    far = compared(others.where(F.col("_kth").isNull() | (F.col("_low") <= F.col("_kth") + 1e-9)))
    return top_k(near.drop("rank").unionByName(far), [*by, "id"], best, k)


def standardised(
    rows: DataFrame, features: list[str], by: list[str], train: DataFrame, name: str = "vec"
) -> DataFrame:
    """Array of z-scores by the training rows of the same group; sd 0 or unknown counts as 1."""
    aggs = [f(c).alias(f"_{t}_{c}") for c in features for f, t in ((F.avg, "mu"), (F.stddev_samp, "sd"))]
    stats = train.groupBy(*by).agg(*aggs)

    def z(c: str) -> Column:
        sd = F.coalesce(F.nullif(F.col(f"_sd_{c}"), F.lit(0.0)), F.lit(1.0))
        return (F.col(c) - F.col(f"_mu_{c}")) / sd

    out = rows.join(stats, by).withColumn(name, F.array(*[z(c).cast("double") for c in features]))
    return out.drop(*[f"_{t}_{c}" for c in features for t in ("mu", "sd")])


def gaps(a: Column, b: Column, weights: list[float] | None = None) -> Column:
    """Weighted absolute gap per feature; null where either side is missing."""
    diff = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if weights is None:
        return diff
    return F.zip_with(diff, F.array(*[F.lit(float(w)) for w in weights]), lambda d, w: d * w)


def driving_features(gap: Column, labels: list[str], n: int = 3) -> Column:
    """Labels of the n smallest known gaps, nearest first, ties in feature order."""
    named = F.zip_with(
        gap, F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(labels)]),
        lambda g, s: F.struct(g.alias("g"), s["i"].alias("i"), s["v"].alias("v")),
    )
    known = F.array_sort(F.filter(named, lambda t: t["g"].isNotNull()))
    return F.array_join(F.transform(F.slice(known, 1, n), lambda t: t["v"]), ", ")
