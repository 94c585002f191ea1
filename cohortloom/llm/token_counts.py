"""Token counts behind a digest cache.

The key of a count is the digest of the normalised content with the digest of the tokenizer file.
Contents that the cache holds are never encoded again; the others are encoded once per distinct
content and appended. Normalising must not change a count, so the only rule is that null is empty.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .common import batch, path_exists, slices, stage

#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space with the word after it: byte-level BPE never merges across the end of a word.
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Distinct pieces a worker remembers, and characters it works on at once.
REMEMBERED, AT_ONCE = 400_000, 2_000_000
CACHE = "content_digest binary, tokenizer_digest string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def splits_at_words(spec: dict) -> bool:
    """True if tokens never reach over the end of a word, so that counts of pieces add up."""
    pre = spec.get("pre_tokenizer") or {}
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(f"[{WHITE}]", t["content"])
        for t in spec.get("added_tokens", [])
    )
    return bool(byte_level and added and not spec.get("normalizer"))


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts for a list of texts; kept by the worker between tasks."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path) as f:
        if not splits_at_words(json.load(f)):
            return encode
    known: dict[str, int] = {}

    def by_piece(texts: list[str]) -> list[int]:
        cut = [PIECE.findall(t) for t in texts]
        missing = list(set().union(*cut).difference(known))
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = list(set().union(*cut))
        known.update(zip(missing, encode(missing), strict=True))
        return [sum(map(known.__getitem__, pieces)) for pieces in cut]

    return by_piece


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("content_digest", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            counts: list[int] = []
            for _, texts in slices((t.as_py() for t in b.column("content")), AT_ONCE):
                counts += count(texts)
            yield batch(schema, {"content_digest": b.column("content_digest"), "n_tokens": counts})

    return run


def _keyed(docs: DataFrame, text_col: str, *more) -> DataFrame:
    content = docs.select(*more, F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    return content.withColumn("content_digest", F.unhex(F.sha2("content", 256)))


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_dir: str, text_col: str = "text") -> None:
    """Encode the distinct contents of `docs` that the cache lacks and append their counts to it."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    misses = _keyed(docs, text_col)
    if path_exists(spark, cache_dir):
        known = spark.read.schema(CACHE).parquet(cache_dir).where(F.col("tokenizer_digest") == version)
        misses = misses.join(known, "content_digest", "left_anti")
    (
        misses.dropDuplicates(["content_digest"]).select("content_digest", "content")
        .mapInArrow(_encode(tokenizer_path), "content_digest binary, n_tokens bigint")
        .select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens")
        .write.mode("append").parquet(cache_dir)
    )


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_dir: str, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 512,
) -> DataFrame:
    """One row per row of `docs`: id, n_bytes (UTF-8), n_tokens, over_limit, content_digest.

    Only the id and the text are read, whatever other columns there are. A null text counts as
    empty (0 tokens), a null id stays null, repeated rows each keep a row, an empty table gives an
    empty result. `cache_dir` is a folder of the shared store; it may hold counts of earlier runs
    and of other tokenizers. Only distinct contents are moved, and copies meet in map-side
    aggregation first.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    fill_cache(docs, tokenizer_path, cache_dir, text_col)
    keyed = _keyed(docs, text_col, F.col(id_col).alias("id"))
    # Runs that share a cache may both have added a content: one row per digest all the same. Written
    # out, so that the join reads it plainly and a digest with very many rows can be split.
    counts = stage(
        spark.read.schema(CACHE).parquet(cache_dir).where(F.col("tokenizer_digest") == version)
        .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")),
        scratch(spark, "token-counts"),
    )
    rows = keyed.select("id", "content_digest", F.octet_length("content").cast("bigint").alias("n_bytes"))
    return rows.join(counts, "content_digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
        F.lower(F.hex("content_digest")).alias("content_digest"),
    )
