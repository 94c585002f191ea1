"""Embeddings as vectors of whole numbers, and sums over groups of them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def largest(dim: int) -> int:
    """Components up to this size have squared distances that a long holds."""
    return math.isqrt((2**63 - 1) // max(dim, 1)) // 2


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with a row of the matrix in each place."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.reshape(-1), kind))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def whole_vectors(df: DataFrame, dim: int, scale: float, vector: Column, **keep: Column) -> DataFrame:
    """The `keep` columns and vector array<int>: floor(scale * x) of every component, x as double.

    Vectors that are null, not `dim` long, or hold a null or a number that is not finite are dropped.
    A component so large that squared distances may leave a long is an error, not a wrong number.
    """
    rows = df.select(*[c.alias(name) for name, c in keep.items()], vector.cast("array<double>").alias("vector"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("vector", T.ArrayType(T.IntegerType()))])
    names, limit = schema.names, largest(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array(pc.fill_null(pc.list_value_length(b.column("vector")), -1))
            held = b.take(pa.array(np.flatnonzero(lengths == dim)))
            x = held.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, dim)  # nulls become nan
            fine = np.isfinite(x).all(1)
            whole = np.floor(x[fine] * scale)
            if whole.size and np.abs(whole).max() > limit:
                raise ValueError(f"a component is beyond {limit} after scaling by {scale}")
            held = held.filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], lists(whole.astype(np.int32), pa.int32())], names=names)

    return rows.mapInArrow(run, schema)


def first_vectors(vectors: DataFrame, dim: int, order: list[Column], count: int) -> np.ndarray:
    """The vectors of the first `count` rows as a matrix; ties go by components, rows that repeat count each."""
    rows = vectors.orderBy(*order, "vector").limit(count).select("vector").collect()
    return np.array([r.vector for r in rows], np.int64).reshape(len(rows), dim)


def group_sums(groups: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """(count, width + 1): by group the sums of the values' columns, then the number of rows."""
    order = np.argsort(groups, kind="stable")
    edges = np.searchsorted(groups[order], np.arange(count + 1))
    running = np.zeros((len(values) + 1, values.shape[1]), np.int64)
    np.cumsum(values[order], axis=0, out=running[1:])
    return np.column_stack([running[edges[1:]] - running[edges[:-1]], np.diff(edges)])


def total(rows: DataFrame, column: str, shape: tuple[int, ...]) -> list[int]:
    """Elementwise exact sums over rows with arrays of one length; bounded by that length, not by rows."""
    sums = rows.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("k", "s"))
    got = {r.k: int(r.s) for r in sums.groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return [got.get(k, 0) for k in range(math.prod(shape))]


def means(sums: list[int], old: np.ndarray) -> np.ndarray:
    """Rows moved to floor(sum / count), with the sums laid out as by `group_sums`; rows without members stay."""
    new, width = old.copy(), old.shape[1]
    for k in range(len(old)):
        *parts, n = sums[k * (width + 1) : (k + 1) * (width + 1)]
        if n:
            new[k] = [s // n for s in parts]
    return new


def joined(values: Iterable) -> str:
    return ",".join(str(int(x)) for x in values)
