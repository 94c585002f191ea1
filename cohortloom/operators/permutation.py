"""Permutation null of a rank correlation, without making permuted rows.

Rows get a dense position once, in the order of a hash of their key. A permutation is a keyed bijection
of positions: a Feistel network over the next power of four, walked on until it lands inside. Positions
are cut into blocks of one size, each written as a row with its ranks in order of position. A
permutation pairs every full block with the one a shift further and permutes inside the pair; the last,
shorter block is paired with itself. These permutations form a group, so the test is exact. Up to
`block` rows there is one block and the shift is nothing.

What is shuffled is blocks, once per shift; a permutation costs one pass over arrays in memory and returns
one number per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .association import _average_rank
from .ranking import with_position

ROUNDS = 6


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feistel(n: int, key: int) -> np.ndarray:
    """A bijection of 0 .. n - 1 that depends on `key`: the image of every place."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), np.uint64(key & 0xFFFFFFFFFFFFFFFF))

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return (left << shift) | right

    out = step(np.arange(n, dtype=np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = step(out[outside])
    return out.astype(np.int64)


def permuted_products(blocks: DataFrame, full: int, reps: int, shifts: int, seed: int) -> DataFrame:
    """(rep, s): sum over all places of the first rank times the permuted second rank, per permutation.

    `blocks` has block, first and second (arrays by place); blocks 0 to full - 1 are of one size.
    """
    moves = 1 if full < 2 else min(shifts, full, reps)
    rng = np.random.default_rng(seed)
    by = np.array([0]) if moves == 1 else np.sort(rng.choice(full, moves, replace=False))
    own = F.array(*[F.struct(F.lit(i).alias("move"), F.lit(int(s)).alias("by")) for i, s in enumerate(by)])
    inner = F.col("block") < full
    left = blocks.select("block", "first", F.explode(own).alias("m")).select(
        "block", "first", "m.move", F.when(inner, F.pmod(F.col("block") + F.col("m.by"), F.lit(max(full, 1)))).otherwise(F.col("block")).alias("to"))
    # A few hundred permutations a row, so that one block is still work for several tasks.
    share = -(-reps // moves)
    parts = max(1, share // 64)
    pairs = left.join(blocks.select(F.col("block").alias("to"), "second"), "to").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = pairs.repartition("block", "move", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, float] = {}
        for b in batches:
            for i in range(b.num_rows):
                block, move, part = (int(b.column(c)[i].as_py()) for c in ("block", "move", "part"))
                x, y = (b.column(c)[i].values.to_numpy() for c in ("first", "second"))
                for r in range(move, reps, moves):
                    if (r // moves) % parts == part:
                        key = int(_mix(np.array([r], np.uint64) << np.uint64(32), np.uint64(seed * 1_000_003 + block))[0])
                        sums[r] = sums.get(r, 0.0) + float(x @ y[feistel(len(x), key)])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.float64())], names=["rep", "s"])

    return pairs.select("block", "move", "part", "first", "second").mapInArrow(run, "rep int, s double").groupBy("rep").agg(F.sum("s").alias("s"))


def permutation_test(
    df: DataFrame, x: str, y: str, key: str, reps: int = 500, block: int = 65_536, shifts: int = 16, seed: int = 0,
) -> DataFrame:
    """One row (rho, n, p): rank correlation and the share of permutations that reach its size.

    Ranks are average ranks for ties and are made once. Rows with a null x or y are left out; rows with
    the same key keep their own places. Without spread in x or y, rho and p are null.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx, ry = (_average_rank(known, c, [], None, f"_r{c}") for c in dict.fromkeys((x, y)))
    ranked = known.select(x, y, F.xxhash64(F.col(key), F.lit(seed)).alias("_h"), F.struct(F.col(key), x, y).alias("_tie"))
    ranked = ranked.join(rx, x).join(ry, y).select("_h", F.xxhash64("_tie").alias("_t"), F.col(f"_r{x}").alias("a"), F.col(f"_r{y}").alias("b"))
    placed = cut_lineage(with_position(ranked, "_h", "_t", descending=False, name="_at"))
    s = placed.agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    n = s.n
    spread = lambda c, m: F.sum(F.pow(F.col(c) - m, F.lit(2)))
    ma, mb = (s.a / n, s.b / n) if n else (0.0, 0.0)
    centred = placed.select((F.col("_at") - 1).alias("at"), (F.col("a") - ma).alias("a"), (F.col("b") - mb).alias("b"))
    m = placed.agg(spread("a", ma).alias("xx"), spread("b", mb).alias("yy"), F.sum((F.col("a") - ma) * (F.col("b") - mb)).alias("xy")).first()
    spark = df.sparkSession
    schema = "rho double, n bigint, p double"
    if not n or not m.xx or not m.yy:
        return spark.createDataFrame([(None, n, None)], schema)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        return pa.table({"block": t.column("block").slice(0, 1).cast(pa.int64()), "first": pa.array([t.column("a").to_numpy()]), "second": pa.array([t.column("b").to_numpy()])})

    cut = centred.withColumn("block", F.floor(F.col("at") / block))
    blocks = cut_lineage(cut.groupBy("block").applyInArrow(pack, "block bigint, first array<double>, second array<double>"))
    null = permuted_products(blocks, n // block, reps, shifts, seed)
    norm = float(np.sqrt(m.xx) * np.sqrt(m.yy))
    rho = m.xy / norm
    reach = F.avg((F.abs(F.col("s") / norm) >= abs(rho) - 1e-12).cast("double"))
    return null.agg(F.lit(rho).alias("rho"), F.lit(n).cast("bigint").alias("n"), reach.alias("p"))
