"""Rates, ages and target transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import ColumnOrName, col, ratio

LOG_SCALE = 0.25


def possessions(fga: ColumnOrName, orb: ColumnOrName, tov: ColumnOrName, fta: ColumnOrName) -> Column:
    return col(fga) - col(orb) + col(tov) + 0.475 * col(fta)


def true_shooting(pts: ColumnOrName, fga: ColumnOrName, fta: ColumnOrName) -> Column:
    return ratio(col(pts), 2 * (col(fga) + 0.44 * col(fta)))


def per(stat: ColumnOrName, minutes: ColumnOrName, base: float = 40.0) -> Column:
    return F.when(col(minutes) > 0, col(stat) * base / col(minutes))


def age_at(year: ColumnOrName, birth: ColumnOrName, month: int = 6, day: int = 25) -> Column:
    ref = F.make_date(col(year).cast("int"), F.lit(month), F.lit(day))
    return F.datediff(ref, col(birth)) / 365.25


def _floored(c: ColumnOrName) -> Column:
    """max(value, 0) that keeps null: greatest() alone would turn null into 0."""
    return F.when(col(c) > 0, col(c)).when(col(c).isNotNull(), 0.0)


def to_log(y: ColumnOrName, scale: float = LOG_SCALE) -> Column:
    return F.log1p(_floored(y) / scale)


def from_log(t: ColumnOrName, scale: float = LOG_SCALE) -> Column:
    return scale * F.expm1(_floored(t))


def to_sqrt(y: ColumnOrName) -> Column:
    return F.sqrt(_floored(y))


def from_sqrt(t: ColumnOrName) -> Column:
    return F.pow(_floored(t), F.lit(2.0))


def shrink_to(value: ColumnOrName, weight: ColumnOrName, prior: float, prior_weight: float) -> Column:
    """Weighted pull toward a prior; a null value counts as the prior."""
    v = F.coalesce(col(value), F.lit(float(prior)))
    return (v * col(weight) + prior * prior_weight) / (col(weight) + prior_weight)


def usage_rate(
    fga: Column, fta: Column, tov: Column, mp: Column, five: Column,
    tm_fga: Column, tm_fta: Column, tm_tov: Column,
) -> Column:
    """Share of team plays used while on the floor; `five` is team minutes / 5."""
    den = mp * (tm_fga + 0.44 * tm_fta + tm_tov)
    return 100 * F.try_divide((fga + 0.44 * fta + tov) * five, den)


def assist_rate(ast: Column, mp: Column, five: Column, tm_fg: Column, fg: Column) -> Column:
    return 100 * F.try_divide(ast, F.try_divide(mp, five) * tm_fg - fg)


def published_or_derived(published: ColumnOrName, derived: ColumnOrName, name: str) -> dict[str, Column]:
    """Columns `name` and `name_source`: the published value wins."""
    p, d = col(published), col(derived)
    return {
        name: F.coalesce(p, d),
        f"{name}_source": F.when(p.isNotNull(), "published").when(d.isNotNull(), "derived"),
    }


def one_hot(c: ColumnOrName, values: list[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}{v}": F.coalesce((col(c) == v).cast("int"), F.lit(0)) for v in values}
