"""Text rules and helpers that the corpus operators share."""

from __future__ import annotations

import gc
import hashlib
import io
import mmap
import os
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte table that lower-cases A-Z and leaves every other byte.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: A word is a run of characters outside this class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_bytes(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text as UTF-8; bytes.split cuts at exactly x20 and x09-x0D."""
    return text.encode().translate(LOWER_BYTES).split() if text else []


def bucket_of(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo `modulus`; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection, so it adds no collision)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(MIX[0])
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[2])
    x ^= x >> np.uint64(31)
    return x


def slices(texts: Iterable, limit: int) -> Iterator[tuple[int, list]]:
    """(offset, texts) of consecutive texts with about `limit` characters together."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text or "") + 1
        if size >= limit:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI in the shared folder (file, hdfs, s3, gs) or of a plain path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_arrays(folder: str, arrays: list[np.ndarray]) -> str:
    """Write arrays one after the other to one file of its own in `folder` of the shared store; its path."""
    system, root = store(folder)
    system.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.npy"
    held = io.BytesIO()
    for a in arrays:
        np.save(held, a)
        held.write(bytes(-held.tell() % ALIGNED))
    with system.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(held.getbuffer())
    return f"{folder}/{name}"


def write_array(folder: str, a: np.ndarray) -> str:
    """Write an array to a file of its own in `folder` of the shared store; its path."""
    return write_arrays(folder, [a])


#: Arrays of a file start at multiples of this; files that a worker has mapped at a time. Linux lets a process have
#: 65,530 mappings.
ALIGNED, MAPPED = 64, 16_000


@lru_cache(maxsize=MAPPED)
def mapped_arrays(path: str) -> tuple[np.ndarray, ...]:
    """The arrays of a file, mapped into memory; files of a remote store are copied to the worker's disk first."""
    system, name = store(path)
    if type(system).__name__ != "LocalFileSystem":
        local = os.path.join(tempfile.gettempdir(), "array-" + os.path.basename(name))
        if not os.path.exists(local):
            part = f"{local}.{os.getpid()}"
            with system.open_input_stream(name) as src, open(part, "wb") as dst:
                while data := src.read(1 << 22):
                    dst.write(data)
            os.replace(part, local)
        name = local
    # A mapping needs no open file; before Python 3.13 each holds one.
    untracked = {"trackfd": False} if sys.version_info >= (3, 13) else {}
    with open(name, "rb") as src:
        whole = mmap.mmap(src.fileno(), 0, access=mmap.ACCESS_READ, **untracked)
        out = []
        while src.tell() < len(whole):
            version = np.lib.format.read_magic(src)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, _, dtype = read(src)
            out.append(np.frombuffer(whole, dtype, shape[0], src.tell()))
            end = src.tell() + out[-1].nbytes
            src.seek(end + -end % ALIGNED)
    return tuple(out)


def mapped(path: str) -> np.ndarray:
    """The only array of a file."""
    return mapped_arrays(path)[0]


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write the frame to `path` in the shared folder and read it back, so that its lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs whose frames are gone."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
