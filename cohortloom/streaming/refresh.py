"""Incremental refresh of a period-partitioned table, and the live tracker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tracker(bands: DataFrame, current: DataFrame, entity: str, full_length: Column) -> DataFrame:
    """Value to date, full-length pace and status of each entity against its projected range.

    bands: entity, floor, ceiling; current: entity, games, value so far. Works on a batch frame or
    inside foreachBatch: there is no event-time rule.
    """
    d = bands.join(current, entity, "left").withColumns(
        {"games": F.coalesce("games", F.lit(0.0)), "_len": full_length}
    )
    d = d.withColumn("pace", F.when(F.col("games") > 0, F.col("value") * F.col("_len") / F.col("games")))
    status = (
        F.when(F.col("games") == 0, "no games yet")
        .when(F.col("pace") > F.col("ceiling"), "pacing above ceiling")
        .when(F.col("pace") < F.col("floor"), "pacing below floor")
        .otherwise("within range")
    )
    return d.select(entity, "games", "value", "pace", status.alias("status"))


def _held(spark: SparkSession, table: str, partition: str, touched: list) -> DataFrame | None:
    """Rows of some partitions; None if there is no table yet. Any other failure must not pass for an empty table."""
    try:
        return spark.read.parquet(table).where(F.col(partition).isin(touched))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _overwrite(rows: DataFrame, table: str, partition: str, staged: str) -> None:
    """Replace the partitions that `rows` has. Staged first, because the table may be read for them."""
    rows.write.mode("overwrite").partitionBy(partition).parquet(staged)
    (
        rows.sparkSession.read.parquet(staged).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(table)
    )


def replace_rows(changed: DataFrame, batch_id: int, table: str, key: str, state: str, buckets: int = 16) -> None:
    """Put the changed rows of an update-mode batch in place of those with the same key.

    The table is partitioned by a hash of the key; only buckets with a change are rewritten. A batch
    that is replayed writes the same rows again.
    """
    spark = changed.sparkSession
    new = changed.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return
    old = _held(spark, table, "_bucket", touched)
    if old is not None:
        new = old.join(new.select(key), key, "left_anti").unionByName(new)
    _overwrite(new, table, "_bucket", f"{state}/staged/{batch_id}")


def refresh_partitions(
    stream: DataFrame, table: str, partition: str, keys: list[str], merge: dict[str, Callable], state: str
) -> StreamingQuery:
    """Fold arriving rows into a table partitioned by `partition`, one overwrite per partition.

    Each micro-batch is pre-aggregated, merged with the partitions it touches and written over
    them only. `merge` maps a measure to the function that combines two partial values (F.sum,
    F.max, ...). A batch seen twice after a failure is recognised by the batch id stored with
    each row, partition by partition: a replay finishes what is missing and leaves the rest. A
    table that cannot be read is an error, and nothing is written.
    """
    spark = stream.sparkSession

    def upsert(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(partition, *keys).agg(*[f(m).alias(m) for m, f in merge.items()])
        touched = [r[0] for r in part.select(partition).distinct().collect()]  # a few partitions
        if not touched:
            return
        old = _held(spark, table, partition, touched)
        if old is not None:
            # A batch that came to some of its partitions before it failed goes on with the others.
            done = old.where(F.col("_batch") >= batch_id).select(partition).distinct().collect()
            seen = [r[0] for r in done]
            if len(seen) == len(touched):
                return
            part = part.where(~F.col(partition).isin(seen)) if seen else part
            old = old.where(~F.col(partition).isin(seen)) if seen else old
            part = old.drop("_batch").unionByName(part).groupBy(partition, *keys).agg(
                *[f(m).alias(m) for m, f in merge.items()]
            )
        _overwrite(part.withColumn("_batch", F.lit(batch_id)), table, partition, f"{state}/staged/{batch_id}")

    return (
        stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{state}/offsets")
        .trigger(availableNow=True).start()
    )


def running_totals(stream: DataFrame, entity: str, measures: dict[str, Column]) -> DataFrame:
    """Per-entity running sums, for update-mode output joined to static bands."""
    return stream.groupBy(entity).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
