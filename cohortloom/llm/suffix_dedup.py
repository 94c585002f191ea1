"""Bytes inside strings of `length` bytes that start more than once in a corpus.

A depth-limited radix sort of all suffixes, most significant digit first; a digit is a hash of a
byte range, and only groups with two suffixes or more go on to the next pass.

1. Suffixes are held as runs, not singly: the consecutive windows of a text whose least gram (by
   hash, leftmost on ties) is at the same place form a block. The gram is the first digit, and equal
   windows have it at the same place. Blocks whose gram occurs once hold no repeated window.
2. The next digit is the whole span of a block. Where all blocks of a gram are equal in it, every
   window of theirs is repeated, and so is every window of a block with an equal one.
3. The last digit is the window itself. Of each group of different blocks one representative sends
   the bytes of its span; windows that are equal at the same place beside the gram are the rest of
   the repeated windows. Groups with very many different blocks are spread window by window.

What comes out are exactly the windows that occur twice. Texts are moved only to read the spans of
step 3 and to cut at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch
from .common import mix64, release, stage

GRAM = 32
#: Bytes that are worked on at once; places in them take 20 bits.
PIECE, PLACE = 1 << 19, np.uint64((1 << 20) - 1)
BASE = 0x9E3779B97F4A7C15
#: Windows compared at once, and different blocks of one gram beyond which windows are spread.
AT_ONCE, SPREAD = 1_500_000, 20_000


def _least_grams(b: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of `width` grams the place of the least one, and the hashes of all grams."""
    h = b.astype(np.uint64) + np.uint64(1)
    base, done = BASE, 1
    while done < gram:  # double the gram's length, or fill it up with an overlap
        step = min(done, gram - done)
        h = mix64(h[: len(h) - step]) * np.uint64(base) + h[step:]
        base = (base * base + 2) % (1 << 64)
        done += step
    h = mix64(h)
    key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    p = 1
    while p * 2 <= width:
        key = np.minimum(key[: len(key) - p], key[p:])
        p *= 2
    if p < width:
        key = np.minimum(key[: len(key) - (width - p)], key[width - p :])
    return (key & PLACE).astype(np.int64), h


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Buffers of (text, offset, bytes); a long text is cut so that every window is in one piece."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            piece = text[at : at + PIECE + length - 1]
            if held and size + len(piece) > 2 * PIECE - 1:
                yield held
                held, size = [], 0
            held.append((k, at, piece))
            size += len(piece)
    if held:
        yield held


def blocks_of(texts: list[bytes], length: int, gram: int = GRAM) -> list[np.ndarray]:
    """Blocks of some texts: text, first window, place of the gram in it, windows, gram and span digits."""
    gram = min(gram, length)
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    for pieces in _pieces(texts, length):
        raw = b"".join(p for _, _, p in pieces)
        starts = np.cumsum([0, *[len(p) for _, _, p in pieces]])
        at, h = _least_grams(np.frombuffer(raw, np.uint8), length - gram + 1, gram)
        own = np.searchsorted(starts, np.arange(len(at)), side="right") - 1
        inside = np.arange(len(at)) + length <= starts[own + 1]
        turn = np.ones(len(at), bool)
        turn[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(turn)
        many = np.diff(np.append(first, len(at)))
        first, many = first[inside[first]], many[inside[first]]
        off = at[first] - first
        view = memoryview(raw)
        digest = xxhash.xxh3_64_intdigest
        span = np.fromiter(
            (digest(view[s : s + n + length - 1], o) for s, n, o in zip(first.tolist(), many.tolist(), off.tolist(), strict=True)),
            np.uint64, len(first))
        piece = own[first]
        text = np.array([k for k, _, _ in pieces])[piece]
        place = first - starts[piece] + np.array([a for _, a, _ in pieces])[piece]
        for column, value in zip(out, (text, place, off, many, h[at[first]].view(np.int64), span.view(np.int64)), strict=True):
            column.append(value)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, and a random number for each byte."""
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), mix64(np.arange(256, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(3))


def windows_of(spans: list[bytes], grams: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, window, key) of every window of some spans: equal keys are equal windows beside equal grams."""
    raw = np.frombuffer(b"".join(spans), np.uint8)
    sizes = np.array([len(s) for s in spans])
    many = sizes - length + 1
    up, down, values = _powers(1 << max(16, int(len(raw)).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * down[: len(raw)], out=sums[1:])
    owner = np.repeat(np.arange(len(spans)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(np.cumsum(sizes) - sizes, many) + nth
    key = (sums[at + length] - sums[at]) * up[at]
    place = (offs[owner] - nth).astype(np.uint64)  # of the gram in the window
    return owner, nth, mix64(mix64(key) ^ grams.view(np.uint64)[owner] ^ mix64(place))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_BLOCK = "id {id}, th bigint, s bigint, off int, cnt int, gram bigint, blk bigint"
_RUN = pa.list_(pa.int32())


def _block_rows(length: int, gram: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("th", pa.int64()), ("s", pa.int64()), ("off", pa.int32()),
                        ("cnt", pa.int32()), ("gram", pa.int64()), ("blk", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                part = b.slice(at, 2_000)
                texts = [(t.as_py() or "").encode() for t in part.column("text")]
                text, *rest = blocks_of(texts, length, gram)
                index = pa.array(text, pa.int64())
                arrays = [part.column("id").take(index), part.column("th").take(index)]
                arrays += [pa.array(x, f.type) for x, f in zip(rest, list(schema)[2:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _span_rows(length: int):
    """Bytes of the spans that a text's representatives send."""
    schema = pa.schema([("gram", pa.int64()), ("blk", pa.int64()), ("off", pa.int32()), ("weight", pa.int32()),
                        ("hot", pa.bool_()), ("span", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows: list[tuple] = []
                for r in b.slice(at, 500).to_pylist():
                    data = r["text"].encode()
                    rows += [(x["gram"], x["blk"], x["off"], x["weight"], x["hot"], data[x["s"] : x["s"] + x["cnt"] + length - 1])
                             for x in r["sends"]]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _matched(length: int):
    """Runs of repeated windows per block; rows come sorted by gram, a gram's rows together."""
    schema = pa.schema([("gram", pa.int64()), ("blk", pa.int64()), ("starts", _RUN), ("ends", _RUN)])

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        weight = t.column("weight").to_numpy()
        owner, nth, key = windows_of(
            [x.as_py() for x in t.column("span")], t.column("gram").to_numpy(), t.column("off").to_numpy(), length)
        order = np.argsort(key, kind="stable")
        turn = np.ones(len(key), bool)
        turn[1:] = key[order][1:] != key[order][:-1]
        first = np.flatnonzero(turn)
        total = np.add.reduceat(weight[owner][order], first)
        again = np.empty(len(key), bool)
        again[order] = np.repeat(total > 1, np.diff(np.append(first, len(key))))
        ends = np.searchsorted(owner, np.arange(t.num_rows + 1))
        runs = [_runs(again[ends[i] : ends[i + 1]]) for i in range(t.num_rows)]
        return pa.RecordBatch.from_arrays(
            [t.column("gram").chunk(0), t.column("blk").chunk(0), pa.array([a for a, _ in runs], _RUN), pa.array([b for _, b in runs], _RUN)],
            schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b])
            held = table if held is None else pa.concat_tables([held, table])
            grams = held.column("gram").to_numpy()
            cut = int(np.searchsorted(grams, grams[-1]))  # the last gram may go on in the next batch
            if cut and held.column("span").nbytes > AT_ONCE:
                yield solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held)

    return run


def _spread(length: int):
    """One row per window, for grams with very many different blocks."""
    schema = pa.schema([("gram", pa.int64()), ("blk", pa.int64()), ("weight", pa.int32()), ("nth", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                part = b.slice(at, 2_000)
                owner, nth, key = windows_of(
                    [x.as_py() for x in part.column("span")], part.column("gram").to_numpy(), part.column("off").to_numpy(), length)
                index = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(index) for c in ("gram", "blk", "weight")], pa.array(nth, pa.int32()), pa.array(key.view(np.int64))],
                    schema=schema)

    return run


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text",
                   gram: int = GRAM, spread: int = SPREAD) -> DataFrame:
    """(id, th, spans) of the texts that hold a repeated window; th is xxhash64 of the text.

    spans lists [start, end) byte ranges that together are the covered bytes; ranges may overlap.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "suffixes")
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    large = texts.where(F.octet_length("text") >= length)
    blocks = large.mapInArrow(_block_rows(length, gram, to_arrow_type(kind)), _BLOCK.format(id=kind.simpleString()))

    # First digit: grams that occur twice or more, and whether their spans differ.
    found = blocks.groupBy("gram").agg(F.count("*").alias("n"), F.min("blk").alias("lo"), F.max("blk").alias("hi"))
    again = stage(found.where("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed")), f"{folder}/grams")
    release(spark)
    held = stage(blocks.join(again, "gram"), f"{folder}/blocks")
    release(spark)

    # Second digit: blocks with an equal one, and one representative of each different block.
    mixed = held.where("mixed")
    classes = stage(
        mixed.groupBy("gram", "blk").agg(
            F.least(F.count("*"), F.lit(2)).cast("int").alias("weight"), F.min(F.struct("id", "th", "s", "off", "cnt")).alias("at")
        ), f"{folder}/classes")
    hot = classes.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > spread).select("gram", F.lit(True).alias("hot"))
    sends = classes.join(hot, "gram", "left").groupBy(F.col("at.id").alias("id"), F.col("at.th").alias("th")).agg(
        F.collect_list(F.struct("gram", "blk", F.col("at.s").alias("s"), F.col("at.off").alias("off"), F.col("at.cnt").alias("cnt"),
                                "weight", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("sends"))
    s = sends.alias("s")
    one_each = large.alias("d").join(s, F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.th") == F.col("s.th"))).select("d.text", "s.sends")
    spans = stage(one_each.mapInArrow(_span_rows(length), "gram bigint, blk bigint, off int, weight int, hot boolean, span binary"), f"{folder}/spans")
    release(spark)

    # Last digit: windows, beside the same gram at the same place. A repeated row sends a span twice.
    one = spans.dropDuplicates(["gram", "blk"])
    near = one.where("not hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(
        _matched(length), "gram bigint, blk bigint, starts array<int>, ends array<int>")
    wide = one.where("hot").mapInArrow(_spread(length), "gram bigint, blk bigint, weight int, nth int, key bigint")
    twice = wide.groupBy("gram", "key").agg(F.sum("weight").alias("n")).where("n > 1").select("gram", "key")
    far = wide.join(twice, ["gram", "key"]).groupBy("gram", "blk").agg(F.collect_list("nth").alias("starts")).select(
        "gram", "blk", "starts", F.transform("starts", lambda x: x + 1).alias("ends"))
    runs = stage(near.unionByName(far), f"{folder}/runs")
    release(spark)

    def span(start, end):
        return F.struct((F.col("s") + start).cast("bigint").alias("start"), (F.col("s") + end + (length - 1)).cast("bigint").alias("end"))

    whole = held.where("not mixed").select("id", "th", span(F.lit(0), F.col("cnt")).alias("x"))
    parts = mixed.join(runs, ["gram", "blk"]).select("id", "th", "s", F.explode(F.arrays_zip("starts", "ends")).alias("r")).select(
        "id", "th", span(F.col("r.starts"), F.col("r.ends")).alias("x"))
    # The different spans of one text: bounded by its length, however many rows hold it.
    return whole.unionByName(parts).distinct().groupBy("id", "th").agg(F.collect_list("x").alias("spans"))


def remove_repeats(docs: DataFrame, keep: list[str], length: int = 200, id_col: str = "doc_id", text_col: str = "text",
                   digest: bool = False, gram: int = GRAM, spread: int = SPREAD) -> DataFrame:
    """Columns `keep` of `docs` with n_bytes, n_removed, n_spans and what is left of the text.

    Each byte (UTF-8) covered by a string of `length` bytes that starts anywhere else in the corpus too
    is removed; texts are judged as they came. With `digest`, kept_sha256 of the remaining bytes; else
    kept_text, without the other bytes of characters that lost some. A null text is empty (kept_text
    null); shorter texts lose nothing. Rows that repeat are copies of each other and lose what they
    share. An empty table stays empty; `keep` columns with the names of added ones are replaced.
    """
    spans = repeated_spans(docs, length, id_col, text_col, gram, spread).select(
        F.col("id").alias("_span_id"), F.col("th").alias("_span_th"), F.col("spans.start").alias("_starts"), F.col("spans.end").alias("_ends"))
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept_text"]
    names = [c for c in keep if c not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"),
                       F.col(text_col).alias("_text"))
    joined = rows.join(spans, F.col("_id").eqNullSafe(F.col("_span_id")) & (F.col("_th") == F.col("_span_th")), "left").select(
        *[F.col(f"`{c}`") for c in names], "_text", "_starts", "_ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, starts, ends in zip(b.column("_text"), b.column("_starts"), b.column("_ends"), strict=True):
                data = (text.as_py() or "").encode()
                depth = np.zeros(len(data) + 1, np.int64)
                if starts.is_valid:
                    np.add.at(depth, starts.values.to_numpy(), 1)
                    np.add.at(depth, ends.values.to_numpy(), -1)
                gone = np.cumsum(depth)[:-1] > 0
                first, _ = _runs(gone)
                left = np.frombuffer(data, np.uint8)[~gone].tobytes() if len(first) else data
                kept = hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "ignore") if text.is_valid else None
                for column, value in zip(out, (len(data), int(gone.sum()), len(first), kept), strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *arrays], names=[*names, *added])

    fields = [docs.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in added[:3]] + [T.StructField(added[3], T.StringType())]
    return joined.mapInArrow(run, T.StructType(fields))
