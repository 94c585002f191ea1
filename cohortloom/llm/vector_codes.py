"""Short codes of vectors by product quantisation, with Lloyd rounds over active entries only.

A vector is cut into parts; each part position has a codebook, and the code names the nearest entry
of every part. Rows carry their entries and the exact distances to them from round to round. In a
round an entry that the last update left in place is passive: a part whose own entry is passive
keeps its stored distance and meets the moved entries only, since every other passive entry has lost
to its own before. A part whose entry moved meets the whole codebook. Distances are whole numbers, and
of equal ones the lower entry counts, so the result is that of a full search.

A round is one pass that writes the rows anew to the shared folder; the last row of a task carries
the task's sums by entry in a column of its own, so the update reads that column and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch
from .common import drop_path, stage
from .vectors import first_vectors, group_sums, joined, lists, matrix, means, total, whole_vectors

#: Whole numbers up to this size have products and sums of 64 products that a double holds exactly.
DOUBLE = 1 << 22


@dataclass(frozen=True)
class Plan:
    dim: int = 64
    parts: int = 8
    entries: int = 16  # at most 256: a code is one byte a part
    rounds: int = 6
    scale: float = 4096.0

    @property
    def width(self) -> int:
        return self.dim // self.parts


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    if x.shape[1] <= 64 and max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < DOUBLE:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(book)), np.int64)
    for k, entry in enumerate(book):
        out[:, k] = ((x - entry) ** 2).sum(1)
    return out


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every row, the lower one on ties, and its distance."""
    d = squares(x, book)
    entry = d.argmin(1)
    return entry, d[np.arange(len(x)), entry]


def rescan(x: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same after `moved` entries took new places, from the entries and distances before."""
    entry, far = entry.copy(), far.copy()
    active = np.flatnonzero(moved)
    loose = moved[entry]
    held = np.flatnonzero(~loose)
    if len(active) and len(held):
        k, d = scan(x[held], book[active])
        k = active[k]
        win = (d < far[held]) | ((d == far[held]) & (k < entry[held]))
        entry[held[win]], far[held[win]] = k[win], d[win]
    loose = np.flatnonzero(loose)
    if len(loose):
        entry[loose], far[loose] = scan(x[loose], book)
    return entry, far


def _round(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, plan: Plan) -> DataFrame:
    """Rows with entries, distances and, on the last row of each task, the task's sums by part and entry."""
    kept = [f for f in rows.schema.fields if f.name in ("id", "label", "vector")]
    schema = T.StructType([*kept, T.StructField("entries", T.BinaryType()), T.StructField("far", T.ArrayType(T.LongType())),
                           T.StructField("sums", T.ArrayType(T.LongType()))])
    size = len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((plan.parts, size, plan.width + 1), np.int64)

        def done(b: pa.RecordBatch, entry: np.ndarray, far: np.ndarray, last: bool) -> pa.RecordBatch:
            bits = pa.py_buffer(entry.astype(np.uint8).tobytes())
            codes = pa.Array.from_buffers(pa.binary(plan.parts), b.num_rows, [None, bits]).cast(pa.binary())
            tail = [None] * (b.num_rows - 1) + [sums.reshape(-1) if last else None]
            return pa.RecordBatch.from_arrays(
                [*(b.column(f.name) for f in kept), codes, lists(far, pa.int64()), pa.array(tail, pa.list_(pa.int64()))], names=schema.names)

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            if held:
                yield done(*held, False)
            x = matrix(b.column("vector"), plan.dim)
            entry, far = np.empty((2, len(x), plan.parts), np.int64)
            if moved is not None:
                before = np.frombuffer(b"".join(b.column("entries").to_pylist()), np.uint8).reshape(len(x), plan.parts).astype(np.int64)
                stored = matrix(b.column("far"), plan.parts)
            for p in range(plan.parts):
                part = x[:, p * plan.width : (p + 1) * plan.width]
                found = scan(part, books[p]) if moved is None else rescan(part, books[p], moved[p], before[:, p], stored[:, p])
                entry[:, p], far[:, p] = found
                sums[p] += group_sums(found[0], part, size)
            held = b, entry, far
        if held:
            yield done(*held, True)

    columns = [f.name for f in kept] + ([] if moved is None else ["entries", "far"])
    return rows.select(columns).mapInArrow(run, schema)


def compress(
    df: DataFrame, plan: Plan = Plan(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): per kept vector id, label, code (two hex digits a part), error and label_error.

    error is the squared distance to the code's entries, label_error its sum over rows with an equal
    label, null labels together. codebooks: parts x entries x components after the last round, on the
    driver (bounded by the plan).

    Vectors that are null, of another length, or hold a null or a number that is not finite are dropped.
    Codebooks start at the smallest ids, null ids last; ties go by components and rows that repeat count
    each, so a table of copies gives equal entries, of which the lowest is used. Fewer rows than entries
    make shorter codebooks; an empty table gives no rows. Rows without an id are coded like any other.
    Columns besides the three are not read, so their names cannot clash.
    """
    if plan.dim % plan.parts or not 1 <= plan.entries <= 256:
        raise ValueError("parts must divide dim, and a codebook holds 1 to 256 entries")
    spark = df.sparkSession
    rows = whole_vectors(df, plan.dim, plan.scale, F.col(vector_col), id=F.col(id_col), label=F.col(label_col))
    start = first_vectors(rows, plan.dim, [F.col("id").asc_nulls_last()], plan.entries)
    books = start.reshape(len(start), plan.parts, plan.width).transpose(1, 0, 2).copy()
    if not len(start):
        empty = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return empty.withColumn("label_error", F.col("error")), books
    moved, path = None, None
    for k in range(plan.rounds + 1):
        before, path = path, scratch(spark, "vector-codes")
        rows = stage(_round(rows, books, moved, plan), path)
        if before:
            drop_path(spark, before)
        if k == plan.rounds:
            break
        shape = (plan.parts, len(start), plan.width + 1)
        sums = np.array(total(rows, "sums", shape), object).reshape(plan.parts, -1)
        new = np.stack([means(list(s), book) for s, book in zip(sums, books, strict=True)])
        moved = (new != books).any(2)
        books = new
        if not moved.any():  # every later round would repeat this one
            break
    error = F.aggregate("far", F.lit(0).cast("bigint"), lambda s, d: s + d)
    coded = rows.select("id", "label", F.lower(F.hex("entries")).alias("code"), error.alias("error"))
    # One row a label, written first: the rows of a hot label can then be split over tasks.
    by_label = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), scratch(spark, "label-error"))
    by_label = by_label.withColumnRenamed("label", "of")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").drop("of"), books


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components, by part, entry and place."""
    return hashlib.sha256(joined(books.reshape(-1)).encode()).hexdigest()
