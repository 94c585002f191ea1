"""Join shapes: flags, checked lookups, band joins, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_flag(df: DataFrame, keys_df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Existence join: is this key in the set? A null key is not."""
    present = keys_df.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(present, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Left lookup that stays one row per input row: duplicate keys in `table` raise at run time.

    Whether the table is broadcast is left to its measured size.
    """
    checked = table.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in cols], F.count(F.lit(1)).alias("_dup")
    )
    checked = checked.withColumn(
        "_ok", F.assert_true(F.col("_dup") == 1, F.lit("lookup table has duplicate keys"))
    ).where(F.col("_ok").isNull())
    return df.join(checked.drop("_dup", "_ok"), keys, "left")


def band_join(
    left: DataFrame, right: DataFrame, on: list[str], left_value: str, right_value: str,
    width: int, how: str = "inner",
) -> DataFrame:
    """Rows with |left_value - right_value| <= width, as an equi-join.

    The right side is repeated for each integer offset, so no range condition reaches the join.
    """
    spread = right.withColumn(
        "_at", F.explode(F.sequence(F.col(right_value) - width, F.col(right_value) + width))
    )
    return left.withColumn("_at", F.col(left_value)).join(spread, [*on, "_at"], how).drop("_at")


def pivot_first(df: DataFrame, keys: list[str], label: str, value: str, labels: list[str]) -> DataFrame:
    """Long to wide with a fixed label list, one aggregate instead of one join per label."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(label) == v, F.col(value))).alias(str(v)) for v in labels]
    )


def apply_overrides(
    df: DataFrame, overrides: DataFrame, key: str, fields: list[str], method: dict[str, str] = {}
) -> DataFrame:
    """Replace or clear fields from (key, field, value) rows; a blank value clears.

    `method` names the column set to 'manual' when its field is overridden.
    """
    wide = overrides.groupBy(key).agg(
        *[
            F.max(F.when(F.col("field") == f, F.struct(F.col("value").alias("v")))).alias(f"_o_{f}")
            for f in fields
        ]
    )
    out = df.join(wide, key, "left")
    for f in fields:
        has = F.col(f"_o_{f}").isNotNull()
        new = F.nullif(F.col(f"_o_{f}.v"), F.lit("")).try_cast(df.schema[f].dataType.simpleString())
        out = out.withColumn(f, F.when(has, new).otherwise(F.col(f)))
        if f in method:
            out = out.withColumn(method[f], F.when(has, F.lit("manual")).otherwise(F.col(method[f])))
    return out.drop(*[f"_o_{f}" for f in fields])


def unknown_overrides(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Overrides whose key does not exist, to be reported."""
    return overrides.join(df.select(key), key, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ordered_changes(
    df: DataFrame, table: DataFrame, keys: list[str], year: str, table_year: str, who: str,
    offsets: range, name: str,
) -> DataFrame:
    """How often `who` changes over year + offsets, ignoring years without an entry."""
    entity = [c for c in df.columns if c not in (year,)]
    spread = df.select(*entity, year, F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o"))
    seen = spread.join(
        table.select(*keys, F.col(table_year).alias("_y"), F.col(who).alias("_who")),
        (F.col(year) + F.col("_o") == F.col("_y"))
        & _same(spread, table, keys),
        "left",
    ).select(*[spread[c] for c in (*entity, year)], "_o", "_who")
    steps = seen.groupBy(*entity, year).agg(
        F.filter(
            F.transform(F.array_sort(F.collect_list(F.struct("_o", "_who"))), lambda s: s["_who"]),
            lambda v: v.isNotNull(),
        ).alias("_seq")
    )
    later = F.slice("_seq", F.lit(2), F.greatest(F.size("_seq") - 1, F.lit(0)))
    earlier = F.slice("_seq", F.lit(1), F.greatest(F.size("_seq") - 1, F.lit(0)))
    moved = F.filter(F.zip_with(earlier, later, lambda a, b: a != b), lambda m: m)
    return steps.withColumn(name, F.size(moved)).drop("_seq")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (left[k] == right[k])
    return out
