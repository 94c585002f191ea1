"""Clusters of vectors by Lloyd rounds over a table of distances to fixed pivots (LAESA).

The exact distances of every vector to a few pivots are stored once. In each round the driver measures
its centroids against the pivots; by the triangle inequality the largest difference between the two
rows of that table bounds a vector's distance to a centroid from below. The centroid with the least
bound is measured first, then only those whose bound does not exceed the nearest one found. Distances
are whole numbers, and of equal ones the lower centroid counts, so the result is that of a full search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch
from .common import stage
from .vectors import first_vectors, group_sums, joined, lists, matrix, means, total, whole_vectors


@dataclass(frozen=True)
class Plan:
    dim: int = 64
    clusters: int = 16
    rounds: int = 3
    scale: float = 64.0
    pivots: int = 12
    pool: int = 128  # rows, the first by the starting order, among which pivots are chosen


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row or of all rows to one."""
    return ((x - y) ** 2).sum(-1)


def choose_pivots(pool: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: the first, then each time the one with the largest sum of distances to those chosen."""
    chosen, far = [0], np.zeros(len(pool))
    while len(chosen) < min(count, len(pool)):
        far += np.sqrt(apart(pool, pool[chosen[-1]]))
        far[chosen] = -1.0
        chosen.append(int(far.argmax()))
    return pool[chosen]


def pivot_table(vectors: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """id, vector, and its exact squared distances to the pivots."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("apart", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vector"), dim)
            d = np.stack([apart(x, p) for p in pivots], 1)
            yield pa.RecordBatch.from_arrays([*b.columns, lists(d, pa.int64())], names=schema.names)

    return vectors.mapInArrow(run, schema)


def nearest(x: np.ndarray, table: np.ndarray, centres: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every row, its squared distance, and how many exact distances that took."""
    own = np.sqrt(table)
    bound = np.zeros((len(x), len(centres)))
    for j, p in enumerate(pivots):
        np.maximum(bound, np.abs(own[:, j, None] - np.sqrt(apart(centres, p))), out=bound)
    bound -= 1e-9 * (1 + own.max(1, initial=0))[:, None]  # more than roots can be off: no centroid is ruled out by rounding
    cluster = bound.argmin(1)
    far = apart(x, centres[cluster])
    first, measured = cluster.copy(), len(x)
    for c, centre in enumerate(centres):
        rows = np.flatnonzero((bound[:, c] <= np.sqrt(far)) & (first != c))
        d = apart(x[rows], centre)
        win = (d < far[rows]) | ((d == far[rows]) & (c < cluster[rows]))
        cluster[rows[win]], far[rows[win]] = c, d[win]
        measured += len(rows)
    return cluster, far, measured


def _sums(table: DataFrame, centres: np.ndarray, pivots: np.ndarray, dim: int) -> DataFrame:
    """One row a task: sums and counts of the vectors nearest to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centres), dim + 1), np.int64)
        for b in batches:
            x = matrix(b.column("vector"), dim)
            cluster, _, _ = nearest(x, matrix(b.column("apart"), len(pivots)), centres, pivots)
            sums += group_sums(cluster, x, len(centres))
        yield pa.RecordBatch.from_arrays([lists(sums.reshape(1, -1), pa.int64())], names=["sums"])

    return table.select("vector", "apart").mapInArrow(run, "sums array<bigint>")


def _assigned(table: DataFrame, centres: np.ndarray, pivots: np.ndarray, dim: int) -> DataFrame:
    schema = T.StructType([table.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vector"), dim)
            cluster, far, _ = nearest(x, matrix(b.column("apart"), len(pivots)), centres, pivots)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster, pa.int32()), pa.array(far)], names=schema.names)

    return table.mapInArrow(run, schema)


def start_order(id_col: Column, seed: str = "1") -> Column:
    """sha256 of `seed:id`, null for a null id."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256)


def cluster(
    df: DataFrame, plan: Plan = Plan(), id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """(rows, centroids, inertia): per kept vector id, cluster and squared distance; the distance summed by cluster.

    Centroids start as the vectors with the smallest hash of their id; null ids come last, ties go by
    components, and rows that repeat count each: equal centroids leave all but the lowest without rows,
    and a centroid without rows stays where it is. Vectors that are null, of another length, or hold a
    null or a number that is not finite are dropped. With fewer vectors than clusters there are as many
    centroids as vectors; an empty table gives no rows. Columns besides the two are not read, so their
    names cannot clash. Centroids and inertia are on the driver, bounded by the plan.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, plan.dim, plan.scale, F.col(vector_col), id=F.col(id_col))
    pool = first_vectors(vectors, plan.dim, [start_order(F.col("id")).asc_nulls_last()], max(plan.clusters, plan.pool))
    centres = pool[: plan.clusters].copy()
    if not len(pool):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centres, {}
    pivots = choose_pivots(pool, plan.pivots)
    table = stage(pivot_table(vectors, pivots, plan.dim), scratch(spark, "pivots"))
    for _ in range(plan.rounds):
        sums = total(_sums(table, centres, pivots, plan.dim), "sums", (len(centres), plan.dim + 1))
        moved = means(sums, centres)
        if (moved == centres).all():  # every later round would repeat this one
            break
        centres = moved
    rows = stage(_assigned(table, centres, pivots, plan.dim), scratch(spark, "clusters"))
    inertia = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a centroid
    return rows, centres, inertia


def centre_digests(centres: np.ndarray) -> list[str]:
    """sha256 of each centroid's components."""
    return [hashlib.sha256(joined(c).encode()).hexdigest() for c in centres]
