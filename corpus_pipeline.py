"""A corpus from raw documents: quality, near-duplicates, repeated passages, benchmark leaks, mixture.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the documents that
go on, with their columns. `run` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

import functools
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortloom.llm import decontaminate, mixing, near_dedup, quality_rules, suffix_dedup  # noqa: E402
from cohortloom.llm.common import stage, table  # noqa: E402
from cohortloom.session import scratch, ship_package  # noqa: E402


#: Columns that stages read or write.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def aside(function):
    """Give the stage every other column under a name of its own, so that none can clash, and the names back."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = docs.toDF(*[c if c in OWN else f"other_{i}" for i, c in enumerate(docs.columns)])
        return function(spark, held, sf_dir).toDF(*docs.columns)

    return run


@aside
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and none of the learned rules against low quality.

    A null or empty text fails the base limits; rows that repeat are judged alike; without labels only the
    base limits count; an empty table stays empty; other columns keep their names and values.
    """
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select(docs.columns)


@aside
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8).

    That with the smallest id stays; rows with the same id and text are one document. Null and empty texts
    are linked with nothing. Without any id in a group, the smallest text stands for it. An empty table
    stays empty; other columns keep their names and values (of one of the rows that repeat).
    """
    ship_package(spark)
    found = near_dedup.near_duplicates(docs, near_dedup.Plan(words=5, similarity=80))
    # A row that repeats is one document: rows are known by id and text, so that rows without an id stay apart.
    chosen = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    # Without any id in a group, the smallest text stands for it.
    keyed = docs.withColumn("_k", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    joined = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")))
    return joined.dropDuplicates(["doc_id", "_k"]).select(docs.columns)


@aside
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 200 that the corpus holds twice; texts that lose all their words go.

    Null and short texts lose nothing and stay; a text that lost bytes gets a new n_chars. An empty table
    stays empty; other columns keep their names and values.
    """
    ship_package(spark)
    names = docs.columns
    cut = suffix_dedup.remove_repeats(docs, names, length=200)
    lost = F.col("n_removed") > 0
    text = F.when(lost, F.col("kept_text")).otherwise(F.col("text"))
    left = cut.withColumn("text", text).withColumn(
        "n_chars", F.when(lost, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.where(~lost | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(names)


@aside
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts have none and stay; rows that repeat are judged alike; an empty table, or an empty
    benchmark, drops nothing; other columns keep their names and values.
    """
    ship_package(spark)
    names = docs.columns
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=names)
    return found.where("n_hit = 0").select(names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards square-root weights of their sources, dealt out by a random key.

    A null source is a source; an empty table stays empty; other columns keep their names and values, but
    for `copy` and `shuffle_key`, which are the stage's own.
    """
    names = docs.columns
    held = docs.toDF(*[c if c in OWN else f"other_{i}" for i, c in enumerate(names)])
    mixed = mixing.mix(held)
    back = [F.col(c).alias(n) for c, n in zip(held.columns, names, strict=True) if n not in ("copy", "shuffle_key")]
    return mixed.select(*back, "copy", "shuffle_key")


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("source mixture", mix_sources),
]

#: Learned rules and their order are not SQL: tests/llm compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = stage(function(spark, docs, sf_dir), scratch(spark, f"pipeline-{k}"))
    return docs
