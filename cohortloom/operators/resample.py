"""Poisson bootstrap: a weight per row and replicate, so resampling is one grouped sum.

The weight depends only on the row key, the replicate and the seed. Every model or metric that
carries the same key therefore sees the same resample, whatever the partitioning, and a lost
executor recomputes the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import attach

PRIME = 2147483647


def _poisson_cdf() -> list[float]:
    """P(X <= k) of Poisson(1) for k = 0, 1, ... until what is left is below the hash's resolution."""
    term = total = math.exp(-1)
    out = [total]
    while 1 - total > 1 / PRIME:
        term /= len(out)
        total += term
        out.append(total)
    return out


POISSON_CDF = _poisson_cdf()


def unit_hash(key: Column, rep: Column, seed: int = 0) -> Column:
    """Reproducible number in [0, 1) from integer arithmetic only, equal in any engine.

    The key is an integer column; `numeric_key` makes one of any other.
    """
    m = F.lit(PRIME).cast("long")
    h = F.pmod(F.pmod(key.cast("long"), m) * 48271 + rep.cast("long") * 69621 + seed * 16807 + 12345, m)
    h = F.pmod(F.pmod(h * h, m) + h * 40692, m)
    h = F.pmod(F.pmod(h * h, m) + h * 69069 + 1, m)
    return h / float(PRIME)


def numeric_key(df: DataFrame, key: str) -> Column:
    """The key itself if it is an integer, else a hash of it."""
    whole = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.col(key).cast("long") if whole else F.xxhash64(F.col(key))


def replicate_weights(keys: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """poisson_weight of some keys (rows) in replicates 1 to `reps` (columns), by the same integer arithmetic."""
    m, rep = np.int64(PRIME), np.arange(1, reps + 1, dtype=np.int64)
    h = ((keys % m) * np.int64(48271))[:, None] + rep * np.int64(69621) + np.int64(seed * 16807 + 12345)
    h %= m
    h = ((h * h) % m + h * np.int64(40692)) % m
    h = ((h * h) % m + h * np.int64(69069) + 1) % m
    return np.searchsorted(np.array(POISSON_CDF), h / float(PRIME), side="right")


def poisson_weight(key: Column, rep: Column, seed: int = 0) -> Column:
    u = unit_hash(key, rep, seed)
    return sum(((u >= c).cast("int") for c in POISSON_CDF[1:]), (u >= POISSON_CDF[0]).cast("int"))


def weight_sql(key: str, rep: str, seed: int = 0) -> str:
    """The same weight as SQL text."""
    m = PRIME
    h1 = f"((({key}) % {m}) * 48271 + ({rep}) * 69621 + {seed * 16807 + 12345}) % {m}"
    steps = " + ".join(f"(u >= {c!r})::INT" for c in POISSON_CDF)
    return (
        f"(SELECT {steps} FROM (SELECT ((h2 * h2) % {m} + h2 * 69069 + 1) % {m} / {float(m)} AS u FROM "
        f"(SELECT ((h1 * h1) % {m} + h1 * 40692) % {m} AS h2 FROM (SELECT CAST({h1} AS BIGINT) AS h1))))"
    )


def replicate_sums(df: DataFrame, key: str, values: list[str], groups: list[str], reps: int, seed: int = 0) -> DataFrame:
    """(groups, rep, and per value s_<value> and w_<value>): weighted sums over the resampled rows.

    Each task multiplies the weights of a batch with its values, so what leaves it is one row per
    group and replicate, not one per row and replicate.
    """
    number = {v: F.col(v).cast("double").alias(v) for v in values}
    rows = df.select(*groups, numeric_key(df, key).alias("_key"), *number.values())
    names = [f"{x}_{v}" for v in values for x in ("s", "w")]
    fields = [rows.schema[g] for g in groups] + [T.StructField("rep", T.IntegerType())] + [T.StructField(n, T.DoubleType()) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                w = replicate_weights(b.column("_key").to_numpy(zero_copy_only=False), reps, seed).astype(float)
                own = pa.Table.from_batches([b.select([*groups, "_key"])]).append_column("_at", pa.array(range(b.num_rows)))
                kinds = own.group_by(groups).aggregate([("_at", "list")]) if groups else None
                places = kinds.column("_at_list").to_pylist() if groups else [range(b.num_rows)]
                sums: list[list[np.ndarray]] = [[] for _ in names]
                for place in places:
                    part = w[list(place)]
                    for i, v in enumerate(values):
                        x = b.column(v).take(pa.array(place)).to_numpy(zero_copy_only=False)
                        known = ~np.isnan(x)
                        sums[2 * i].append(np.where(known, x, 0.0) @ part)
                        sums[2 * i + 1].append(known.astype(float) @ part)
                index = pa.array(np.repeat(np.arange(len(places)), reps))
                keys = [kinds.column(g).combine_chunks().take(index) for g in groups]
                arrays = [*keys, pa.array(np.tile(np.arange(1, reps + 1, dtype=np.int32), len(places)))]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(np.concatenate(c)) for c in sums]], names=[*groups, "rep", *names])

    parts = rows.mapInArrow(run, T.StructType(fields))
    return parts.groupBy(*groups, "rep").agg(*[F.sum(n).alias(n) for n in names])


def interval(rep_values: DataFrame, groups: list[str], value: str, lo: str, hi: str, level: float = 0.95) -> DataFrame:
    """Percentile interval over replicates; a group holds one value per replicate."""
    tail = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return rep_values.groupBy(*groups).agg(q.alias("_q")).select(
        *groups, F.col("_q")[0].alias(lo), F.col("_q")[1].alias(hi)
    )


def bootstrap_mean(
    df: DataFrame, key: str, values: list[str], groups: list[str], reps: int, seed: int = 0
) -> DataFrame:
    """(groups, n, and per value: mean, lo, hi) from replicate_sums."""
    point = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values]
    )
    sums = replicate_sums(df, key, values, groups, reps, seed)
    means = sums.select(*groups, "rep", *[F.try_divide(F.col(f"s_{v}"), F.col(f"w_{v}")).alias(v) for v in values])
    ci = means.groupBy(*groups).agg(
        *[F.percentile(v, F.array(F.lit(0.025), F.lit(0.975))).alias(f"_{v}") for v in values]
    )
    out = attach(point, ci, groups, [f"_{v}" for v in values])
    cols = [*groups, "n"]
    for v in values:
        cols += [v, F.col(f"_{v}")[0].alias(f"{v}_lo"), F.col(f"_{v}")[1].alias(f"{v}_hi")]
    return out.select(*cols)


def paired_scores(scores: DataFrame, key: str, score: str, baselines: list[str]) -> DataFrame:
    """(model, key, score, base, diff): score minus each baseline's score of the same row."""
    base = scores.where(F.col("model").isin(*baselines)).select(
        F.col("model").alias("base"), key, F.col(score).alias("_b")
    )
    return scores.select("model", key, score).join(base, key).withColumn("diff", F.col(score) - F.col("_b")).drop("_b")
