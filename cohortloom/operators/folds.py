"""As-of folds: what may be learnt from when.

A fold is a test cohort. Training rows reach their folds by exploding the folds a cohort may
serve, so no row-level range join is planned and every fold runs in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def is_known_by(df: DataFrame, period: str, cohort: str) -> DataFrame:
    """Flag rows that existed at the cohort date; entities without a cohort keep all rows."""
    known = F.col(cohort).isNull() | (F.col(period) <= F.col(cohort))
    return df.withColumn("is_known", known)


def assign_folds(df: DataFrame, cohort: str, lag: int, first: int, last: int, fold: str = "fold") -> DataFrame:
    """Repeat each training row once per fold it may serve: cohort + lag <= fold."""
    start = F.greatest(F.col(cohort) + lag, F.lit(first)).cast("int")
    return df.where(start <= last).withColumn(fold, F.explode(F.sequence(start, F.lit(last))))


def assert_no_leak(df: DataFrame, cohort: str, fold: str, lag: int) -> DataFrame:
    """Raise at run time if a row's outcome was not known at its fold."""
    leak = F.assert_true(F.col(cohort) + lag <= F.col(fold), F.lit("leakage: outcome not yet observed"))
    return df.where(leak.isNull())


def fold_cohorts(
    known: DataFrame, cohort: str, lag: int, folds: list[int], calib: int = 0, min_fit: int = 0,
    min_training: int = 0, retrospective: bool = False,
) -> DataFrame:
    """(fold, cohort, n, n_train, role, retrospective): which cohorts train which fold.

    A fold short of `min_training` rows is dropped, or with `retrospective` trains on all other
    cohorts. The latest `calib` cohorts get role 'calib' when `calib + min_fit` are there.
    One row per cohort and fold, whatever the data size.
    """
    sizes = known.groupBy(cohort).agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds])))
    per = Window.partitionBy("fold")
    asof = F.col(cohort) + lag <= F.col("fold")
    pairs = pairs.withColumn("_asof", asof).withColumn(
        "_n", F.sum(F.when(F.col("_asof"), F.col("n")).otherwise(0)).over(per)
    )
    enough = (F.col("_n") >= max(min_training, 1))
    if retrospective:
        keep = F.when(enough, F.col("_asof")).otherwise(F.col(cohort) != F.col("fold"))
    else:
        keep = enough & F.col("_asof")
    pairs = pairs.where(keep).withColumn("retrospective", ~enough)
    recent = Window.partitionBy("fold").orderBy(F.col(cohort).desc())
    role = F.when(
        (F.lit(calib) > 0)
        & (F.count(F.lit(1)).over(per) >= calib + min_fit)
        & (F.row_number().over(recent) <= calib),
        "calib",
    ).otherwise("fit")
    return pairs.select(
        "fold", cohort, "n", F.sum("n").over(per).alias("n_train"), role.alias("role"), "retrospective"
    )
