"""Quantile grids: one array column of values at evenly spaced levels.

The grid levels are 0.05 .. 0.95. Everything here is built from higher-order functions, so it
stays in the JVM and costs the grid length per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ColumnOrName, col, let

LEVELS = [round(0.05 * i, 2) for i in range(1, 20)]
FLOOR, MEDIAN, CEILING = 0.25, 0.5, 0.9
Z95 = 1.959963984540054


def levels_array(levels: list[float] = LEVELS) -> Column:
    return F.array(*[F.lit(v) for v in levels])


def at_level(grid: ColumnOrName, tau: float, levels: list[float] = LEVELS) -> Column:
    i = min(range(len(levels)), key=lambda j: abs(levels[j] - tau))
    return F.element_at(col(grid), i + 1)


def monotone(grid: ColumnOrName) -> Column:
    return F.array_sort(col(grid))


def shift(grid: ColumnOrName, delta: ColumnOrName) -> Column:
    return F.zip_with(col(grid), col(delta), lambda a, b: a + b)


def clamp_below(grid: ColumnOrName, low: Column) -> Column:
    return F.transform(col(grid), lambda v: F.greatest(v, low))


def blend(grids: list[ColumnOrName], weights: list[float]) -> Column:
    """Weighted mean of sorted grids, level by level."""
    total = sum(weights)

    def scaled(grid: ColumnOrName, factor: float) -> Column:
        return F.transform(monotone(grid), lambda v: v * factor)

    parts = [scaled(g, w / total) for g, w in zip(grids, weights)]
    out = parts[0]
    for p in parts[1:]:
        out = shift(out, p)
    return out


def cdf(grid: ColumnOrName, t: ColumnOrName, levels: list[float] = LEVELS) -> Column:
    """P(Y <= t): linear between levels, one extra step in each tail, right-continuous at ties."""
    n = len(levels)
    taus = F.array(F.lit(0.0), *[F.lit(v) for v in levels], F.lit(1.0))
    at = col(t)

    def knots(q: Column) -> Column:
        low = F.element_at(q, 1) - (F.element_at(q, 2) - F.element_at(q, 1)) - 1e-9
        high = F.element_at(q, n) + (F.element_at(q, n) - F.element_at(q, n - 1)) + 1e-9
        return F.concat(F.array(low), q, F.array(high))

    def invert(x: Column) -> Column:
        def inside(i: Column) -> Column:
            x0, x1 = F.element_at(x, i), F.element_at(x, i + 1)
            t0, t1 = F.element_at(taus, i), F.element_at(taus, i + 1)
            return (
                F.when(i == 0, 0.0)
                .when(i >= n + 2, 1.0)
                .when(x1 > x0, t0 + (t1 - t0) * (at - x0) / (x1 - x0))
                .otherwise(t1)
            )

        return let(F.size(F.filter(x, lambda v: v <= at)), inside)

    value = let(let(monotone(grid), knots), invert)
    return F.when(at.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def pit(grid: ColumnOrName, y: ColumnOrName) -> Column:
    """Where the outcome fell in the range, 0 to 1, at the middle of point masses."""
    return (cdf(grid, col(y)) + cdf(grid, col(y) - 1e-9)) / 2


def pinball(y: ColumnOrName, q: Column, tau: float | Column) -> Column:
    d = col(y) - q
    return F.greatest(tau * d, (tau - 1) * d)


def crps(y: ColumnOrName, grid: ColumnOrName, levels: list[float] = LEVELS) -> Column:
    """Twice the mean pinball loss over the grid."""
    losses = F.zip_with(col(grid), levels_array(levels), lambda q, tau: pinball(y, q, tau))
    return 2 * F.aggregate(losses, F.lit(0.0), lambda a, b: a + b) / len(levels)


def brier(p: Column, hit: Column) -> Column:
    return F.pow(p - hit.cast("double"), F.lit(2.0))


def half_tie_below(y: ColumnOrName, q: Column) -> Column:
    """1 below, 0.5 at a tie, 0 above."""
    return (col(y) < q).cast("double") + 0.5 * (col(y) == q).cast("double")


def half_tie_above(y: ColumnOrName, q: Column) -> Column:
    return (col(y) > q).cast("double") + 0.5 * (col(y) == q).cast("double")


def tier_probabilities(grid: ColumnOrName, cuts: list[float]) -> Column:
    """P(each tier): differences of the CDF at the cuts."""
    probs = [cdf(grid, F.lit(c)) for c in cuts]
    inside = F.array(F.lit(0.0), *probs)
    upper = F.array(*probs, F.lit(1.0))
    return F.zip_with(inside, upper, lambda a, b: F.least(F.greatest(b - a, F.lit(0.0)), F.lit(1.0)))


def mean(grid: ColumnOrName) -> Column:
    return F.aggregate(col(grid), F.lit(0.0), lambda a, b: a + b) / F.size(col(grid))


def root_moments(grid: ColumnOrName, min_sd: float = 0.05) -> tuple[Column, Column]:
    """Mean and spread of the grid on the square-root scale."""
    roots = F.transform(col(grid), lambda v: F.sqrt(F.greatest(v, F.lit(0.0))))
    m = mean(roots)
    var = let(m, lambda mu: mean(F.transform(roots, lambda r: (r - mu) * (r - mu))))
    return m, F.greatest(F.sqrt(var), F.lit(min_sd))


def expected_value(grid: ColumnOrName) -> Column:
    """Mean of the grid plus both tails: low tail at the first level, high tail one gap out."""
    q = col(grid)
    last, before = F.element_at(q, -1), F.element_at(q, -2)
    return 0.95 * mean(q) + 0.025 * F.element_at(q, 1) + 0.025 * (last + (last - before))


def shrink_floor(
    grid: ColumnOrName, reached: ColumnOrName, factor: ColumnOrName, levels: list[float] = LEVELS
) -> Column:
    """Pull levels up to 0.25 toward the value already reached; a null factor leaves them."""
    r, lam = col(reached), F.coalesce(col(factor), F.lit(1.0))
    return F.zip_with(
        col(grid),
        levels_array(levels),
        lambda q, tau: F.when((tau <= FLOOR) & (lam < 1.0), r + lam * (q - r)).otherwise(q),
    )


def grade_letter(pct: Column) -> Column:
    return F.when(pct >= 0.9, "A").when(pct >= 0.5, "B").when(pct >= 0.25, "C").otherwise("D")


def verdict(y: ColumnOrName, floor: Column, ceiling: Column) -> Column:
    return (
        F.when(col(y) > ceiling, "beat ceiling")
        .when(col(y) < floor, "below floor")
        .when(col(y).isNotNull(), "within band")
    )


def wilson(k: ColumnOrName, n: ColumnOrName, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a share."""
    k, n = col(k), col(n)
    p = F.try_divide(k, n)
    den = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / den
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / den
    return centre - half, centre + half


def to_columns(grid: ColumnOrName, prefix: str = "q", levels: list[float] = LEVELS) -> dict[str, Column]:
    """Expand a grid to columns q0.05 .. q0.95 at the edge of the library."""
    return {f"{prefix}{tau:.2f}": F.element_at(col(grid), i + 1) for i, tau in enumerate(levels)}
