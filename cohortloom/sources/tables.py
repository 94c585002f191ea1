"""Layered tables: raw, staging, modeled."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LAYERS = ("raw", "staging", "modeled")


def table_path(root: str, layer: str, source: str, name: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer}")
    return f"{root}/{layer}/{source}/{name}.parquet"


def identifier(*parts: str) -> str:
    """Catalog name of a table: letters, digits and underscores only."""
    return "__".join(re.sub(r"[^A-Za-z0-9_]", "_", p) for p in parts)


def read_table(spark: SparkSession, root: str, layer: str, source: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(root, layer, source, name))


def write_table(df: DataFrame, root: str, layer: str, source: str, name: str, partition_by: list[str] = []) -> int:
    """Full overwrite; the row count is observed during the write, not by a second pass."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(table_path(root, layer, source, name))
    return seen.get["rows"]


def scan_periods(spark: SparkSession, path: str) -> DataFrame:
    """Every period of a partitioned table at once; the period is a partition column, so a filter
    on it prunes files."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def register_layer(spark: SparkSession, tables: dict[tuple[str, str, str], str]) -> list[str]:
    """(layer, source, stem) -> path: one temp view `layer__source__stem` per table."""
    names = []
    for (layer, source, stem), path in tables.items():
        name = identifier(layer, source, stem)
        spark.read.parquet(path).createOrReplaceTempView(name)
        names.append(name)
    return names


def export(df: DataFrame, path: str, columns: list[str] | None = None, grid: str = r"^c\d+$") -> None:
    """Pruned copy of a table: the columns that exist, grid columns in single precision."""
    keep = [c for c in (columns or df.columns) if c in df.columns]
    small = [F.col(c).cast("float").alias(c) if re.match(grid, c) else F.col(c) for c in keep]
    df.select(*small).write.mode("overwrite").parquet(path)


def export_bundle(
    spark: SparkSession, root: str, bundle: str, entries: list[tuple[str, str, list[str] | None]], params: dict[str, str] | None = None,
    limit: int | None = None, layer: str = "modeled",
) -> DataFrame:
    """(source, name, columns, rows, bytes) of what was written: every listed table pruned, cast and copied, then `params`.

    An entry is (source, table, columns or None for all); columns that a table lacks are left out. Params
    become a table of one row. Rows are counted while they are written. Raises if the files are larger
    together than `limit` bytes.
    """
    done = []
    for source, name, columns in entries:
        df = read_table(spark, root, layer, source, name)
        done.append((source, name, _exported(df, f"{bundle}/{source}/{name}.parquet", columns)))
    if params:
        row = spark.createDataFrame([tuple(params.values())], ", ".join(f"`{c}` string" for c in params))
        done.append(("outcomes", "params", _exported(row, f"{bundle}/outcomes/params.parquet", None)))
    sizes = [(source, name, columns, rows, _bytes(spark, f"{bundle}/{source}/{name}.parquet")) for source, name, (columns, rows) in done]
    total = sum(r[-1] for r in sizes)
    if limit is not None and total > limit:
        raise ValueError(f"the bundle has {total} bytes, more than {limit}")
    return spark.createDataFrame(sizes, "source string, name string, columns int, rows long, bytes long")  # one row an entry


def _exported(df: DataFrame, path: str, columns: list[str] | None) -> tuple[int, int]:
    seen = Observation()
    export(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, columns)
    return len([c for c in (columns or df.columns) if c in df.columns]), seen.get["rows"]


def _bytes(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def write_report(df: DataFrame, path: str, places: int = 4) -> None:
    """Rounded summary as CSV."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    df.withColumns({c: F.round(c, places) for c in doubles}).write.mode("overwrite").option("header", True).csv(path)


def early_periods(df: DataFrame, entity: str, period: str, first: int = 4) -> DataFrame:
    """First `first` periods of each entity."""
    from ..operators.ranking import top_k

    return top_k(df, [entity], [F.col(period)], first, "nth")


def universe(drafted: DataFrame, index: DataFrame, key: str, late: Column) -> DataFrame:
    """Keys to fetch: drafted ones and index ones that satisfy `late`."""
    return drafted.select(key).union(index.where(late).select(key)).distinct()
