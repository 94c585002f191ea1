"""Density maps, styles and labels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.court import GRID_X, GRID_Y, REFERENCE_LINE, cell_zone, contradicts
from ..session import cut_lineage

HEIGHT = GRID_Y[1] - GRID_Y[0] + 1
CELLS = (GRID_X[1] - GRID_X[0] + 1) * HEIGHT


def with_consistent_xy(
    shots: DataFrame, dx: str, dy: str, is_three: str, line: str, corner_line: float | None = None
) -> DataFrame:
    """Adds dx, dy, dist, xy_valid and era-scaled sx, sy; contradicting coordinates are null.

    Distance and verdict are columns of their own, so they are computed once per row.
    """
    d = shots.withColumn("_d", F.hypot(dx, dy))
    d = d.withColumn("_ok", ~contradicts("_d", dx, is_three, line, corner_line))

    def kept(c: Column) -> Column:
        return F.when(F.col("_ok"), c)

    scale = REFERENCE_LINE / F.col(line)
    return d.withColumns(
        {
            "sx": kept(F.col(dx) * scale), "sy": kept(F.col(dy) * scale), "dist": kept(F.col("_d")),
            "xy_valid": F.col("_ok") & F.col(dx).isNotNull(), "dx": kept(F.col(dx)), "dy": kept(F.col(dy)),
        }
    ).drop("_d", "_ok")


def kernel(sigma: float = 1.5, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Gaussian weights by cell offset, cut at `truncate` sigmas and summing to 1."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [(i - radius, w / sum(raw)) for i, w in enumerate(raw)]


def histogram(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, ix, iy, n): counts on the folded one-foot grid, outside points dropped."""
    fx = F.abs(F.col(x))
    # Cells are centred on whole feet; the far edge of the last cell is closed.
    ix = F.when(fx == GRID_X[1] + 0.5, GRID_X[1]).otherwise(F.floor(fx + 0.5)).cast("int")
    iy = F.when(F.col(y) == GRID_Y[1] + 0.5, GRID_Y[1]).otherwise(F.floor(F.col(y) + 0.5)).cast("int")
    # One struct per point: the cell is computed once, not again in every bound below.
    cell = F.explode(F.array(F.struct(ix.alias("ix"), iy.alias("iy"))))
    cells = points.select(key, cell.alias("c")).select(key, "c.ix", "c.iy")
    inside = F.col("ix").between(*GRID_X) & F.col("iy").between(*GRID_Y)
    return cells.where(inside).groupBy(key, "ix", "iy").agg(F.count(F.lit(1)).alias("n"))


def _toeplitz(size: int, sigma: float) -> np.ndarray:
    """Kernel weights from every place of an axis to every other; what falls outside is lost."""
    out = np.zeros((size, size))
    for offset, w in kernel(sigma):
        out += np.diag(np.full(size - abs(offset), w), offset) if abs(offset) < size else 0.0
    return out


def smooth(hist: DataFrame, key: str, sigma: float = 1.5) -> DataFrame:
    """(key, map): separable Gaussian, zero outside the grid, summing to 1: one array of all cells per key.

    The cells of a key meet as one row, at most as long as the grid; a batch of rows is one dense array
    and two matrix products.
    """
    cell = (F.col("ix") * HEIGHT + F.col("iy") - GRID_Y[0]).cast("int")
    rows = hist.groupBy(key).agg(F.collect_list(F.struct(cell.alias("cell"), F.col("n").cast("double").alias("n"))).alias("m"))
    schema = T.StructType([rows.schema[key], T.StructField("map", T.ArrayType(T.DoubleType()))])
    along, across = _toeplitz(CELLS // HEIGHT, sigma), _toeplitz(HEIGHT, sigma)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("m")
            cells = held.flatten()
            grid = np.zeros(b.num_rows * CELLS)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(held).to_numpy())
            np.add.at(grid, row * CELLS + cells.field("cell").to_numpy(), cells.field("n").to_numpy())
            grid = along @ grid.reshape(b.num_rows, -1, HEIGHT) @ across
            grid = grid.reshape(b.num_rows, CELLS)
            grid /= grid.sum(axis=1, keepdims=True)
            ends = pa.array(np.arange(b.num_rows + 1) * CELLS, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(ends, pa.array(grid.reshape(-1)))], names=schema.names)

    return rows.mapInArrow(run, schema)


def density_maps(points: DataFrame, key: str, x: str, y: str, sigma: float = 1.5) -> DataFrame:
    return smooth(histogram(points, key, x, y), key, sigma)


def map_cells(maps: DataFrame, key: str) -> DataFrame:
    """(key, cell, density) of the cells that a map reaches."""
    return maps.select(key, F.posexplode("map").alias("cell", "density")).where("density > 0")


def cell_columns(cell: str = "cell") -> dict[str, Column]:
    """Coordinates, zone, distance and angle of a cell."""
    x = F.floor(F.col(cell) / HEIGHT).cast("double")
    y = (F.pmod(F.col(cell), F.lit(HEIGHT)) + GRID_Y[0]).cast("double")
    return {
        "x": x, "y": y, "zone": cell_zone(x, y), "feet": F.hypot(x, y),
        "angle": F.degrees(F.atan2(F.greatest(y, F.lit(0.0)), x)),
    }


def disambiguate(df: DataFrame, label: str, alternatives: list[Column], name: str) -> DataFrame:
    """Keep a label that is unique; repeat with the next alternative for those that are not."""
    out = df.withColumn(name, F.col(label))
    for alt in alternatives:
        # Counting labels by aggregate keeps one common label from landing in one window task.
        n = out.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(n, name).withColumn(name, F.when(F.col("_n") > 1, alt).otherwise(F.col(name))).drop("_n")
    return out


def elbow(curve: DataFrame, k: str, error: str, least_gain: float = 0.08) -> DataFrame:
    """One row: the k before the first whose relative gain is below `least_gain`, else the last."""
    w = Window.partitionBy(F.lit(1)).orderBy(k)
    gain = 1 - F.col(error) / F.lag(error).over(w)
    small = F.min(F.when(F.col("gain") < least_gain, F.col(k))) - 1
    return curve.withColumn("gain", gain).agg(
        F.greatest(F.coalesce(small, F.max(k)), F.lit(2)).alias("chosen")
    )


def _dense(b: pa.RecordBatch) -> np.ndarray:
    """The maps of a batch in percent, as rows of a matrix."""
    return b.column("map").flatten().to_numpy().reshape(b.num_rows, CELLS) * 100.0


#: Maps that are worked on at a time: their weights stay in a core's cache through all updates.
BLOCK = 2048
#: Shares below this are none. Updates only multiply, so what dies out would pass through numbers too small
#: for a processor's fast path, and the last sweeps took more than twice as long with them.
NONE = 1e-200


def _mixes(top: np.ndarray, gram: np.ndarray, iterations: int) -> np.ndarray:
    """Non-negative weights of each row given V H' and H H', by multiplicative updates from an even start."""
    out = np.empty(top.shape)
    for at in range(0, len(top), BLOCK):
        own = np.ascontiguousarray(top[at : at + BLOCK].T)  # long rows: few components, many maps
        w, below = np.full(own.shape, 0.5), np.empty(own.shape)
        for i in range(1, iterations + 1):
            np.maximum(np.matmul(gram, w, out=below), 1e-12, out=below)
            w *= np.divide(own, below, out=below)
            if i % 10 == 0 or i == iterations:
                w[w < NONE] = 0.0
        out[at : at + BLOCK] = w.T
    return out


def _packed(maps: DataFrame, key: str) -> DataFrame:
    """(key, map) with the map in percent as the bytes of its numbers: read again in every sweep, as one value a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.array([v.tobytes() for v in _dense(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(key), rows], names=[key, "map"])

    return maps.select(key, "map").mapInArrow(run, T.StructType([maps.schema[key], T.StructField("map", T.BinaryType())]))


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(place, packed maps as rows of a matrix), BLOCK rows at a time."""
    for at in range(0, b.num_rows, BLOCK):
        yield at, np.frombuffer(b"".join(b.column("map").slice(at, BLOCK).to_pylist())).reshape(-1, CELLS)


def fit_styles(
    maps: DataFrame, key: str, ranks: list[int], sweeps: int = 200, tol: float = 1e-4, inner: int = 100, seed: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Non-negative factors of the maps for several ranks at once: (weights, components, errors).

    weights (rank, key, w array summing to 1), components (rank, cell, h array), errors (rank, error:
    the norm of what is not explained, zero cells included). A map stays one row with its key, of any
    type; a sweep sends up only sums of rank x cells and rank x rank numbers, which update the
    components. Sweeps end when no rank's error falls by more than `tol` of itself.
    """
    spark = maps.sparkSession
    per = cut_lineage(_packed(maps, key))
    rng = np.random.default_rng(seed)
    h = {r: rng.random((r, CELLS)) + 0.1 for r in ranks}
    last: dict[int, float] = {}

    def sums(parts: dict[int, np.ndarray]):
        def run(batches):
            total = {r: np.zeros(r * CELLS + r * r + 1) for r in parts}
            every = np.vstack(list(parts.values()))  # one product with the maps serves all ranks
            ends = np.cumsum([0, *parts])
            for v in (v for b in batches for _, v in _blocks(b)):
                whole, tops = np.vdot(v, v), v @ every.T
                weights = np.empty(tops.shape)
                for (r, own), at in zip(parts.items(), ends):
                    top, gram = tops[:, at : at + r], own @ own.T
                    w = weights[:, at : at + r] = _mixes(top, gram, inner)
                    ww = w.T @ w
                    total[r][r * CELLS :] += [*ww.ravel(), whole - 2 * (w * top).sum() + (ww * gram).sum()]
                up = weights.T @ v
                for r, at in zip(parts, ends):
                    total[r][: r * CELLS] += up[at : at + r].ravel()
            for r, x in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([x])], names=["rank", "x"])

        rows = per.select("map").mapInArrow(run, "rank int, x array<double>")
        got = rows.select("rank", F.posexplode("x").alias("i", "v")).groupBy("rank", "i").agg(F.sum("v").alias("v")).toArrow()
        out = {r: np.zeros(r * CELLS + r * r + 1) for r in parts}
        rank, place, value = (got.column(c).to_numpy() for c in ("rank", "i", "v"))
        for r in parts:
            out[r][place[rank == r]] = value[rank == r]
        return out

    active = dict(h)
    for _ in range(sweeps):
        for r, x in sums(active).items():
            error = float(np.sqrt(max(x[-1], 0.0)))
            if r in last and last[r] - error <= tol * last[r]:
                last[r] = error
                del active[r]
                continue
            last[r] = error
            up, ww = x[: r * CELLS].reshape(r, CELLS), x[r * CELLS : -1].reshape(r, r)
            own = h[r]
            for _ in range(10):
                own = own * up / np.maximum(ww @ own, 1e-12)
                own[own < NONE] = 0.0
            h[r] = active[r] = own
        if not active:
            break
    schema = T.StructType([T.StructField("rank", T.IntegerType()), maps.schema[key], T.StructField("w", T.ArrayType(T.DoubleType()))])

    def solve(batches):
        for b in batches:
            for at, v in _blocks(b):
                for r, own in h.items():
                    w = _mixes(v @ own.T, own @ own.T, inner)
                    w = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r] * len(v), pa.int32()), b.column(key).slice(at, BLOCK), pa.array(list(w), pa.list_(pa.float64()))], names=schema.names)

    weights = per.mapInArrow(solve, schema)
    rows = [(r, c, own[:, c].tolist()) for r, own in h.items() for c in range(CELLS)]  # one row per rank and grid cell
    components = spark.createDataFrame(rows, "rank int, cell int, h array<double>")
    errors = spark.createDataFrame([(r, last[r]) for r in ranks], "rank int, error double")
    return weights, components, errors


def describe_styles(components: DataFrame) -> DataFrame:
    """(style, label, avg_ft, avg_angle, mass per zone): components labelled by where mass sits."""
    from ..functions.court import ZONES

    # Style label per zone.
    labels = {
        "rim": "Rim attacker", "short_mid": "Paint / floater", "long_mid": "Midrange",
        "corner_three": "Corner spacer", "above_break_three": "Above-the-break shooter",
    }
    long = components.withColumns(cell_columns()).select("zone", "feet", "angle", F.posexplode("h").alias("style", "m"))
    total = F.sum("m")
    g = long.groupBy("style").agg(
        F.try_divide(F.sum(F.col("feet") * F.col("m")), total).alias("avg_ft"),
        F.try_divide(F.sum(F.col("angle") * F.col("m")), total).alias("avg_angle"),
        *[F.try_divide(F.sum(F.when(F.col("zone") == z, F.col("m")).otherwise(0.0)), total).alias(z) for z in ZONES],
    )
    order = F.reverse(F.array_sort(F.array(*[F.struct(F.col(z).alias("m"), F.lit(-i).alias("i"), F.lit(labels[z]).alias("l")) for i, z in enumerate(ZONES)])))
    g = g.withColumn("_o", order).withColumn("_l", F.col("_o")[0]["l"])
    second = F.concat_ws(" + ", "_l", F.lower(F.col("_o")[1]["l"]))
    side = F.concat_ws(", ", second, F.when(F.col("avg_angle") < 45, "baseline side").otherwise("middle"))
    far = F.concat(side, F.format_string(" (%.0f ft)", "avg_ft"))
    return disambiguate(g, "_l", [second, side, far], "label").drop("_o", "_l")


def project_styles(maps: DataFrame, components: DataFrame, key: str, iterations: int = 200) -> DataFrame:
    """(key, w): mixes of fitted components for new maps, components held fixed.

    The component table has one row per grid cell, a fixed number, so it travels with the task.
    """
    rows = components.orderBy("cell").collect()  # one row per grid cell
    h = np.array([r["h"] for r in rows], dtype=float).T
    schema = T.StructType([maps.schema[key], T.StructField("w", T.ArrayType(T.DoubleType()))])

    def solve(batches):
        for b in batches:
            w = _mixes(_dense(b) @ h.T, h @ h.T, iterations)
            w = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(list(w), pa.list_(pa.float64()))], names=schema.names)

    return maps.select(key, "map").mapInArrow(solve, schema)
