"""Dense entity x period panels and what accumulates along them.

Per-entity windows are safe: after aggregation an entity has one row per period, a bounded
number, however many raw rows it had. All windows share one exchange on the entity.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import attach, with_position


def spine(
    entities: DataFrame, cohort: str, last_period: int, n: str = "n", period: str = "period"
) -> DataFrame:
    """One row per entity and period after its cohort, through the last complete period."""
    observed = F.lit(last_period) - F.col(cohort)
    return (
        entities.where(F.col(cohort).isNotNull() & (observed >= 1))
        .withColumn(n, F.explode(F.sequence(F.lit(1), observed.cast("int"))))
        .withColumn(period, (F.col(cohort) + F.col(n)).cast("int"))
    )


def dense_panel(
    entities: DataFrame, seasons: DataFrame, entity: str, cohort: str, last_period: int,
    measures: list[str], flags: list[str] = [], period: str = "period", n: str = "n",
) -> DataFrame:
    """Spine with the season rows attached; absence is 0 or false, `active` says which."""
    s = seasons.select(entity, period, *measures, *flags, F.lit(True).alias("active"))
    out = spine(entities, cohort, last_period, n, period).join(s, [entity, period], "left")
    return out.withColumns(
        {
            **{m: F.coalesce(m, F.lit(0.0)) for m in measures},
            **{f: F.coalesce(f, F.lit(False)) for f in [*flags, "active"]},
        }
    )


def along(entity: str | list[str], order: str, first: int | None = None, last: int = 0):
    keys = [entity] if isinstance(entity, str) else entity
    start = Window.unboundedPreceding if first is None else first
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(start, last)


def running(c: Column | str, entity: str, order: str) -> Column:
    return F.sum(c).over(along(entity, order))


def running_count(cond: Column, entity: str, order: str) -> Column:
    return F.sum(cond.cast("int")).over(along(entity, order))


def with_rolling_peak(
    df: DataFrame, value: str, entity: str | list[str], order: str, name: str, width: int = 3
) -> DataFrame:
    """Best trailing `width`-period sum so far, always divided by `width`."""
    trailing = F.sum(value).over(along(entity, order, -(width - 1))) / width
    return (
        df.withColumn("_trail", trailing)
        .withColumn(name, F.max("_trail").over(along(entity, order)))
        .drop("_trail")
    )


def training_stats(df: DataFrame, metrics: list[str], training: Column, by: list[str] = []) -> DataFrame:
    """Mean and sample sd of training rows, one pass, for standardising everyone."""
    ref = df.where(training)
    aggs = [f(m).alias(f"{m}_{tag}") for m in metrics for f, tag in ((F.avg, "mu"), (F.stddev_samp, "sd"))]
    return ref.groupBy(*by).agg(*aggs) if by else ref.agg(*aggs)


def season_blend(df: DataFrame, a: str, b: str, training: Column, po_a: str, po_b: str) -> DataFrame:
    """`value`: mean z of two metrics less what an all-zero period would get, and
    `value_extra`: the extra metrics on the same scale without shift (none adds 0)."""
    stats = training_stats(df, [a, b], training)
    out = attach(df, stats, [], [f"{m}_{t}" for m in (a, b) for t in ("mu", "sd")])

    def z(x: Column, m: str) -> Column:
        return (x - F.col(f"{m}_mu")) / F.col(f"{m}_sd")

    blend = (z(F.col(a), a) + z(F.col(b), b)) / 2
    zero = (z(F.lit(0.0), a) + z(F.lit(0.0), b)) / 2
    extra = (
        F.coalesce(po_a, F.lit(0.0)) / F.col(f"{a}_sd") + F.coalesce(po_b, F.lit(0.0)) / F.col(f"{b}_sd")
    ) / 2
    drop = [f"{m}_{t}" for m in (a, b) for t in ("mu", "sd")]
    return out.withColumns({"value": blend - zero, "value_extra": extra}).drop(*drop)


def same_point_composite(
    df: DataFrame, parts: dict[str, float], training: Column, n: str = "n", name: str = "composite"
) -> DataFrame:
    """Weighted z-scores against training rows at the same n; sd 0 gives null."""
    metrics = list(parts)
    stats = training_stats(df, metrics, training, [n])
    out = df.join(stats, n, "left")
    total = None
    for m, w in parts.items():
        zed = (F.col(m) - F.col(f"{m}_mu")) / F.nullif(F.col(f"{m}_sd"), F.lit(0.0))
        total = w * zed if total is None else total + w * zed
    return out.withColumn(name, total).drop(*[f"{m}_{t}" for m in metrics for t in ("mu", "sd")])


def graded_peak(peak: Column, honours: Column, star: Column, solid: Column, cuts: list[float]) -> Column:
    """Peak floored just above a cut by what was won; greatest() ignores nulls."""
    floor = F.when(honours, cuts[4] + 1e-6).when(star, cuts[3] + 1e-6).when(solid, cuts[2] + 1e-6)
    return F.greatest(peak, floor)


def fold_states(df: DataFrame, entity: str, order: list[str], source: str, target: str, block: int = 4096) -> DataFrame:
    """(entity, source, target): where each holder's entity ends up after all its moves, in order.

    A move counts only when the holder is its `source`. Moves of an entity get dense places by the one or
    two `order` columns; a block of places is folded from its end, which gives each source in it the holder
    that it ends with. Block maps compose, so neighbours are joined pairwise, holder by holder, in as many
    rounds as the blocks have bits: no task needs all moves, or all holders, of an entity. Moves without a
    source, a target, an entity or an order are left out; holders without a row end where they start.
    """
    known = F.col(source).isNotNull() & F.col(target).isNotNull() & F.col(entity).isNotNull()
    moves = df.where(known).select(
        entity, *dict.fromkeys(order), F.col(source).alias("_from"), F.col(target).alias("_to"))
    placed = with_position(moves, order[0], order[-1], [entity], descending=False, name="_at").where(F.col("_at").isNotNull())
    blocks = placed.select(entity, F.expr(f"(_at - 1) div {block}").alias("_b"), "_at", "_from", "_to")
    schema = blocks.select(entity, "_b", "_from", "_to").schema

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by("_at")
        ends: dict = {}
        for a, b in zip(reversed(t.column("_from").to_pylist()), reversed(t.column("_to").to_pylist()), strict=True):
            ends[a] = ends.get(b, b)
        same = [pa.array([t.column(c)[0].as_py()] * len(ends), t.schema.field(c).type) for c in (entity, "_b")]
        held = [pa.array(list(v), t.schema.field("_from").type) for v in (ends.keys(), ends.values())]
        return pa.Table.from_arrays([*same, *held], names=schema.names)

    maps = cut_lineage(blocks.groupBy(entity, "_b").applyInArrow(walk, schema))
    last = maps.agg(F.max("_b")).first()[0] or 0
    while last:
        on = [entity, "_b"]
        pair = F.expr("_b div 2").alias("_b")
        one = maps.where("_b % 2 = 0").select(entity, pair, "_from", "_to")
        two = maps.where("_b % 2 = 1").select(entity, pair, "_from", "_to")
        through = one.join(two.select(*on, F.col("_from").alias("_to"), F.col("_to").alias("_end")), [*on, "_to"], "left").select(
            *on, "_from", F.coalesce("_end", "_to").alias("_to"))
        only = two.join(one.select(*on, "_from"), [*on, "_from"], "left_anti").select(*on, "_from", "_to")
        maps = cut_lineage(through.unionByName(only))
        last //= 2
    return maps.select(entity, F.col("_from").alias(source), F.col("_to").alias(target))


def final_holder(entities: DataFrame, ends: DataFrame, entity: str, start: str, name: str) -> DataFrame:
    """Each entity's holder in the end, from fold_states and its starting holder."""
    key, source, target = ends.columns
    found = ends.select(F.col(key).alias(entity), F.col(source).alias(start), F.col(target).alias("_end"))
    return entities.join(found, [entity, start], "left").select(*entities.columns, F.coalesce("_end", start).alias(name))
