"""Mixing sources to target weights by Poisson replication.

A source with share w of the mix and n of the corpus is repeated w * total / n times on average:
each document is copied a Poisson number of times with that mean, found by inverting the
distribution at a uniform number that a hash of the seed and the document gives. Copies are then
shuffled globally by another hash. The outcome does not depend on partitions or on lost tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .common import stage

#: A mean above this is split into equal parts that are drawn one by one and added.
PART = 16.0
#: Entries of a distribution: beyond these nothing that a double can tell is left at a mean of PART.
ENTRIES = math.ceil(PART + 40 * math.sqrt(PART + 1) + 40)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as a rising array that ends in 1; the mean is at most PART."""
    zero = F.exp(-mean)
    start = F.struct(zero.alias("term"), zero.alias("total"), F.array(zero).alias("out"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * mean / k
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"), F.array_append(s["out"], s["total"] + term).alias("out"))

    # No drawn number lies above the largest double below 1: entries from there on need not be carried.
    return F.aggregate(F.sequence(F.lit(1), F.lit(ENTRIES)), start, step, lambda s: F.array_append(
        F.filter(s["out"], lambda c: c < 1 - 2**-53), F.lit(1.0)))


def uniform(seed: str, key: Column) -> Column:
    """In (0, 1), from 52 bits of md5 of the seed and the key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(2**52)


def source_sizes(docs: DataFrame, size: Column, source_col: str = "source") -> DataFrame:
    """(source, n): size of each source over all documents; null is a source."""
    return docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("n"))


def power_weights(sizes: DataFrame, exponent: float = 0.5) -> DataFrame:
    """(source, weight): shares in proportion to a power of the size; 1 keeps the corpus, 0 makes sources equal."""
    # Summed as decimals, so that the total does not depend on the order.
    raw = sizes.select("source", F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(float(exponent)))).otherwise(0.0).alias("raw"))
    total = raw.agg(F.sum(F.col("raw").cast("decimal(38,9)")).cast("double").alias("t")).scalar()
    return raw.select("source", F.coalesce(F.try_divide("raw", total), F.lit(0.0)).alias("weight"))


def repetition_rates(sizes: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """(source, parts, cdf) of every source: in how many equal parts its mean is drawn, and their distribution.

    A source without bytes has no distribution; one without a weight has weight 0.
    """
    whole = sizes.agg(F.sum("n").cast("double").alias("t")).scalar() if total is None else F.lit(float(total))
    both = sizes.join(weights.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")), "left")
    mean = F.when(F.col("n") > 0, F.coalesce("weight", F.lit(0.0)) * whole / F.col("n"))
    cut = both.select("source", mean.alias("mean")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / PART).cast("int")))
    return cut.select("source", "parts", F.when(F.col("mean").isNotNull(), poisson_cdf(F.col("mean") / F.col("parts"))).alias("cdf"))


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, seed: str = "mix", id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", exponent: float = 0.5, total: float | None = None,
) -> DataFrame:
    """Copies of the documents with `copy` (1, 2, ...) and `shuffle_key` added.

    Rows are dealt to tasks by the key and lie in its order inside each task. `weights` are target shares
    of UTF-8 bytes by source (null is a source; default: power_weights of the corpus with `exponent`); a
    source without a weight has weight 0 and does not come out. `total` is the size aimed at (default:
    that of the corpus). Sources without bytes cannot be repeated to a weight: their documents are kept
    once. Any number of sources will do: their rates are a table that is joined. Rows that repeat draw
    the same number. A null id is replaced by the text's digest in draws. An empty table gives an empty
    result; columns named copy or shuffle_key are replaced.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0))
    sizes = source_sizes(docs, size, source_col)
    given = power_weights(sizes, exponent) if weights is None else spark.createDataFrame(
        [(s, float(w)) for s, w in weights.items()], "source string, weight double")
    # One row a source, written first: the documents of a hot source can then be split over tasks.
    rates = stage(repetition_rates(sizes, given, total), scratch(spark, "mixing"))
    plan = rates.select(F.col("source").alias("_source"), F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf"))
    own = docs.select(*[F.col(f"`{c}`") for c in names])
    joined = own.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col("_source")))
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    draw = lambda j: F.size(F.filter(
        F.col("_cdf"), lambda c: c < uniform(seed, F.concat(key, F.lit(":"), j.cast("string")))))
    one_part = F.size(F.filter(F.col("_cdf"), lambda c: c < F.col("_u")))
    many = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda n, j: n + draw(j))
    drawn = joined.withColumn("_u", uniform(seed, F.concat(key, F.lit(":1")))).withColumn(
        "_n", F.when(F.col("_cdf").isNull(), 1).when(F.col("_parts") == 1, one_part).otherwise(many)
    ).where(F.col("_n") > 0)
    copies = drawn.select(*names, key.alias("_key"), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    order = F.conv(F.substring(F.md5(F.concat(
        F.lit(seed + ":order:"), F.col("_key"), F.lit(":"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("bigint")
    keyed = copies.withColumn("shuffle_key", order).drop("_key")
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key", "copy")
