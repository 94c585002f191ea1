"""Non-increasing least-squares fits of any length, and lookups in them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import value_positions, with_position

#: Blocks that one task pools.
CHUNK = 65_536


def pool_violators(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Where each block of the non-increasing fit of blocks with weights w and sums s starts."""
    starts: list[int] = []
    weights: list[float] = []
    sums: list[float] = []
    for i in range(len(w)):
        starts.append(i)
        weights.append(float(w[i]))
        sums.append(float(s[i]))
        # Pool while a block lies above the one before it.
        while len(starts) > 1 and sums[-1] * weights[-2] > sums[-2] * weights[-1]:
            starts.pop()
            total, weight = sums.pop(), weights.pop()
            sums[-1] += total
            weights[-1] += weight
    return np.array(starts, np.int64)


def decreasing_fit(df: DataFrame, x: str, v: str, by: list[str] = [], chunk: int = CHUNK) -> DataFrame:
    """(by, x, fit): the non-increasing least-squares fit of v along x; x is unique in its group.

    Neighbouring values that rise are pooled into blocks. Chunks of blocks are pooled apart, then again
    with the seams moved to the middle, until no block rises over a seam: pooling gives the same blocks in
    any order. A group of any length is many chunks. Rows with a null x or v are left out.
    """
    known = df.where(F.col(x).isNotNull() & F.col(v).isNotNull()).select(*by, x, F.col(v).cast("double").alias("_s"))
    placed = cut_lineage(with_position(known, x, x, by, descending=False, name="_at"))
    blocks = placed.select(*by, "_at", F.col("_at").alias("_x"), F.lit(1).cast("bigint").alias("_w"), "_s")
    schema = blocks.select(*by, "_x", "_w", "_s").schema
    names = schema.names

    def pool(t: pa.Table) -> pa.Table:
        t = t.sort_by("_x")
        w, s = t.column("_w").to_numpy(), t.column("_s").to_numpy()
        first = pool_violators(w, s)
        at = pa.array(first)
        sums = [np.add.reduceat(c, first) for c in (w, s)]
        return pa.Table.from_arrays([*(t.column(c).take(at) for c in [*by, "_x"]), *(pa.array(c) for c in sums)], names=names)

    turn = 0
    while True:
        # Half a chunk further every other time, so that a seam lies inside a chunk.
        place = F.floor((F.col("_at") - 1 + (turn % 2) * (chunk // 2)) / chunk)
        pooled = cut_lineage(blocks.withColumn("_c", place).groupBy(*by, "_c").applyInArrow(pool, schema))
        turn += 1
        # Block means in order: a rise is left only where two chunks met.
        ends = with_position(pooled, "_x", "_x", by, descending=False, name="_at")
        blocks = cut_lineage(ends)
        many = blocks.groupBy(*by).agg(F.max("_at").alias("n")).agg(F.max("n")).first()[0] or 0
        if turn == 1 and (placed.groupBy(*by).agg(F.max("_at").alias("n")).agg(F.max("n")).first()[0] or 0) <= chunk:
            break  # no seams
        after = blocks.select(*by, (F.col("_at") - 1).alias("_at"), F.col("_w").alias("_w2"), F.col("_s").alias("_s2"))
        if not many or blocks.join(after, [*by, "_at"]).where("_s2 * _w > _s * _w2").isEmpty():
            break
    fit = blocks.select(*by, F.explode(F.sequence("_x", F.col("_x") + F.col("_w") - 1)).alias("_at"), (F.col("_s") / F.col("_w")).alias("fit"))
    return placed.select(*by, x, "_at").join(fit, [*by, "_at"]).select(*by, x, "fit")


def first_at_most(rows: DataFrame, value: str, curve: DataFrame, x: str, fit: str, name: str) -> DataFrame:
    """The rows with `name`: the smallest x whose fit is not above the value; null where none is.

    The curve does not rise, so that is the x of the largest fit up to the value: values and fits are
    ranked together, values without weight, and meet by rank. Any number of rows and of x.
    """
    levels = curve.where(F.col(fit).isNotNull()).groupBy(F.col(fit).cast("double").alias("_v")).agg(F.min(x).alias(name))
    both = levels.select("_v", F.lit(1).alias("_w")).unionByName(
        rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"), F.lit(0).alias("_w")).distinct())
    pos = value_positions(both, "_v", [], "_w").select("_v", (F.col("below") + F.col("ties")).alias("_r"))
    ranked = cut_lineage(pos)
    at = levels.join(ranked, "_v").select("_r", name)
    found = ranked.join(at, "_r").select(F.col("_v").alias("_key"), name)
    return rows.join(found, F.col(value).cast("double") == F.col("_key"), "left").drop("_key")
