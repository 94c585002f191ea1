"""Group-by shapes that recur: conditional shares, argmax rows, pivots, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_k


def sum_or_zero(c: Column | str) -> Column:
    """Sum where nothing adds up to 0; plain F.sum gives null for all-null."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def share(cond: Column) -> Column:
    """Share of rows where the condition holds; unknown counts as false."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    x, w = (F.col(c) if isinstance(c, str) else c for c in (x, w))
    return F.try_divide(F.sum(x * w), F.sum(w))


def best_row(value: Column | str, tie: Column | str, *fields: str) -> Column:
    """Fields of the row with the largest value; ties go to the smallest key. Combines map-side."""
    v = F.col(value) if isinstance(value, str) else value
    t = F.col(tie) if isinstance(tie, str) else tie
    return F.max_by(F.struct(*fields) if len(fields) > 1 else F.col(fields[0]), F.struct(v, -t))


def worst_row(value: Column | str, tie: Column | str, *fields: str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    t = F.col(tie) if isinstance(tie, str) else tie
    return F.min_by(F.struct(*fields) if len(fields) > 1 else F.col(fields[0]), F.struct(v, t))


def top_sum(df: DataFrame, groups: list[str], value: str, tie: str, k: int, name: str) -> DataFrame:
    top = top_k(df, groups, [F.col(value).desc(), F.col(tie)], k)
    return top.groupBy(*groups).agg(F.sum(value).alias(name))


def value_shares(
    df: DataFrame, groups: list[str], label: str, labels: list[str], prefix: str = ""
) -> DataFrame:
    """Share of each label per group; null labels are left out, absent labels are 0."""
    known = df.where(F.col(label).isNotNull())
    return known.groupBy(*groups).agg(
        *[share(F.col(label) == v).alias(f"{prefix}{v}") for v in labels]
    )


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).agg(
        *[F.count_if(F.col(column) == v).alias(str(v)) for v in values]
    )


def regression(y: Column, x: Column) -> dict[str, Column]:
    """Slope, intercept and residual sd (n - 2) in one pass."""
    rss = F.regr_syy(y, x) - F.try_divide(F.pow(F.regr_sxy(y, x), F.lit(2)), F.regr_sxx(y, x))
    return {
        "b": F.regr_slope(y, x),
        "a": F.regr_intercept(y, x),
        "sigma": F.sqrt(F.greatest(F.try_divide(rss, F.regr_count(y, x) - 2), F.lit(0.0))),
    }


def missing_shares(df: DataFrame, cols: list[str], groups: list[str] = []) -> DataFrame:
    """Long table (groups, feature, missing): one pass, then one unpivot of the small result."""
    wide = df.groupBy(*groups).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return wide.unpivot(groups, cols, "feature", "missing")


def keep_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop every row whose key occurs more than once."""
    single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return df.join(single, keys, "left_semi")


def hash_sample(df: DataFrame, groups: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows per group in hash order: repeatable and independent of partitioning."""
    return top_k(df, groups, [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], n, "_rn").drop("_rn")
