"""Interpolated modified Kneser-Ney language model, counted in Spark and read from sorted hash arrays.

Tasks count the distinct words and n-grams of their texts and send them, sorted and packed, to
shards chosen by a hash of the whole n-gram, so that no context, however common, fills a shard.
A shard task merges its packs, writes one sorted array of keys and one of counts, and passes on what
the next lower order needs: for each distinct n-gram one continuation of its last words, and the
statistics of its context. Scoring workers map the arrays into memory and look keys up by binary
search. The number of shards follows the size of the corpus; files are written once per attempt
under names of their own, and only names that Spark commits to a manifest are read.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, mapped_arrays, mix64, release, slices, word_bytes, write_arrays

#: Neither can be a word: words hold no spaces.
START, END = b" start", b" end"
UNSEEN = np.uint32(0xFFFFFFFF)
#: Discounts where counts of counts cannot give any.
FALLBACK = (0.5, 1.0, 1.5)
#: Text bytes a shard stands for, and characters that a task takes at a time.
SHARD_BYTES, SLICE_CHARS = 16 << 20, 3_000_000


# ---- packed arrays -----------------------------------------------------------------------------


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length; the first is sorted and stored as differences."""
    first = np.diff(arrays[0], prepend=arrays[0][:1] * 0) if len(arrays[0]) else arrays[0]
    raw = io.BytesIO()
    for a in [first, *arrays[1:]]:
        # Byte planes: the high bytes of small numbers are runs of zeros.
        raw.write(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(raw.getvalue())


def _unpack(data: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for k in kinds:
        size = np.dtype(k).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(k))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def _merge(keys: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Sorted distinct keys, the sums of their values, and the place of one row of each."""
    order = np.argsort(keys)  # rows of one key are alike: their order does not matter, and numpy sorts faster without it
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], [np.add.reduceat(s[order], first) if len(first) else s for s in sums], order[first]


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0x5A5A)) % np.uint64(shards)).astype(np.int64)


def gram_key(ids: np.ndarray) -> np.ndarray:
    """64-bit key of n-grams (rows of word ids): exact up to two words, a hash beyond."""
    key = ids[:, 0].astype(np.uint64) if ids.shape[1] else np.zeros(len(ids), np.uint64)
    for j in range(1, ids.shape[1]):
        key = (key << np.uint64(32) if j == 1 else mix64(key) * np.uint64(0xD1342543DE82EF95)) + ids[:, j].astype(np.uint64)
    return key


# ---- files -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Arrays:
    """Sorted keys with `width` values beside them, a file a shard: whole, or (`narrow`) each value as _narrow makes it.

    A worker maps all shards, so a shard is one file: a process may have a bounded number of them.
    """

    shards: int
    by_range: bool
    files: dict[int, str] = field(hash=False)
    width: int
    narrow: bool = False

    def find(self, keys: np.ndarray, *, ranks: bool = False) -> list[np.ndarray]:
        """Values at the keys (zeros where a key is missing); with `ranks` the place in the shard (or -1) first."""
        if self.by_range:
            shard = ((keys >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)
        else:
            shard = _shard_of(keys, self.shards)
        step = 3 if self.narrow else 1
        out = [np.zeros(len(keys), np.int64) for _ in range(self.width)]
        place = np.full(len(keys), -1, np.int64)
        order = np.argsort(keys)
        order = order[np.argsort(shard[order].astype(np.int16 if self.shards < 1 << 15 else np.int64), kind="stable")]
        ends = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(ends)):
            if k not in self.files:
                continue
            at = order[ends[k] : ends[k + 1]]
            own, *files = mapped_arrays(self.files[k])
            p = np.searchsorted(own, keys[at])
            ok = p < len(own)
            ok[ok] = own[p[ok]] == keys[at][ok]
            place[at[ok]] = p[ok]
            for i, column in enumerate(out):
                values = files[i * step]
                column[at[ok]] = values[p[ok]]
                if self.narrow and len(files[i * step + 1]):
                    much = ok.copy()
                    much[ok] = values[p[ok]] == 255
                    column[at[much]] = files[i * step + 2][np.searchsorted(files[i * step + 1], p[much])]
        return [place, *out] if ranks else out


# ---- words -------------------------------------------------------------------------------------


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class _Ids(dict):
    """Ids of words by way of the mapped vocabulary, remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self) > 400_000:
            self.clear()
        new = list(set().union(*texts, (START, END)).difference(self)) if texts else []
        ids = self.vocabulary.ids(np.array([word_hash(w) for w in new], np.uint64))
        self.update(zip(new, ids.tolist(), strict=True))
        get = self.__getitem__
        return [np.fromiter(map(get, words), np.uint32, len(words)) for words in texts]


@dataclass(frozen=True)
class Vocabulary:
    """Word hashes in sorted shards with training counts; an id is the place over all shards."""

    arrays: Arrays
    offsets: np.ndarray = field(hash=False)
    tokens: int = 0
    types: int = 0

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        place = self.arrays.find(hashes, ranks=True)[0]
        shard = ((hashes >> np.uint64(32)) * np.uint64(self.arrays.shards) >> np.uint64(32)).astype(np.int64)
        return np.where(place >= 0, place + self.offsets[shard], UNSEEN).astype(np.uint32)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.offsets, ids, side="right") - 1
        for k in np.unique(shard[ids != UNSEEN]):
            at = np.flatnonzero((shard == k) & (ids != UNSEEN))
            out[at] = mapped_arrays(self.arrays.files[k])[1][ids[at] - self.offsets[k]]
        return out


_PACK = "level int, kind string, shard int, n bigint, data binary"
_PACKS = pa.schema([("level", pa.int32()), ("kind", pa.string()), ("shard", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
_DONE = "level int, kind string, shard int, n bigint, file string, stats array<bigint>, pack binary"


def _packs(level: int, kind: str, shard: np.ndarray, arrays: list[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    """One pack per shard of rows whose first array is sorted."""
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(ends)):
        at = order[ends[k] : ends[k + 1]]
        data = _pack([a[at] for a in arrays])
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], f.type) for x, f in zip((level, kind, int(k), len(at), data), _PACKS, strict=True)], schema=_PACKS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, about SLICE_CHARS at a time."""
    for b in batches:
        for _, texts in slices((t.as_py() for t in b.column("text")), SLICE_CHARS):
            yield [word_bytes(t) for t in texts]


def _count_words(shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.array([word_hash(w) for w in held], np.uint64)
            keys, (counts,), _ = _merge(keys, [np.fromiter(held.values(), np.int64, len(held))])
            shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            yield from _packs(0, "words", shard, [keys, counts], shards)

        for texts in _runs(batches):
            for words in texts:
                held.update(words)
            held[END] += len(texts)
            if len(held) > 800_000:
                yield from flush()
                held.clear()
        held.setdefault(START, 0)
        yield from flush()

    return run


def _merged(packs: list[tuple[int, bytes]], kinds: list[str], key: Callable) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of some packs by key: (keys, arrays), sums in the arrays after the key's."""
    parts = [_unpack(data, n, kinds) for n, data in packs]
    return key([np.concatenate(column) for column in zip(*parts, strict=True)])


def _shard_tasks(packs: DataFrame, work: Callable[[int, int, dict[str, list[tuple[int, bytes]]]], Iterator[tuple]]) -> DataFrame:
    """Run `work` once for each (level, shard) with all its packs by kind; rows as in _DONE."""
    schema = pa.schema([
        ("level", pa.int32()), ("kind", pa.string()), ("shard", pa.int32()), ("n", pa.int64()),
        ("file", pa.string()), ("stats", pa.list_(pa.int64())), ("pack", pa.binary()),
    ])

    def run(part: pa.Table) -> pa.Table:
        level, shard = (part.column(c)[0].as_py() for c in ("level", "shard"))
        got: dict[str, list[tuple[int, bytes]]] = {}
        for kind, n, data in zip(*(part.column(c).to_pylist() for c in ("kind", "n", "data")), strict=True):
            got.setdefault(kind, []).append((n, data))
        rows = list(work(level, shard, got))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return packs.groupBy("level", "shard").applyInArrow(run, _DONE)


def _word_shards(folder: str) -> Callable:
    def work(level: int, shard: int, packs: dict) -> Iterator[tuple]:
        keys, counts = _merged(packs["words"], ["u8", "i8"], lambda a: (lambda k, s, _: (k, s[0]))(*_merge(a[0], a[1:])))
        yield level, "words", shard, len(keys), write_arrays(folder, [keys, counts]), [int(counts.sum()), int((counts > 0).sum())], None

    return work


# ---- n-grams -----------------------------------------------------------------------------------


def _gram_packs(level: int, keys: np.ndarray, rows: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Packs of distinct n-grams by shard.

    Up to two words the key is the n-gram. Longer ones are sent without their key, which is a hash and
    does not compress: rows are sorted by their first two words, stored as differences, and the shard
    makes the key again.
    """
    shard = _shard_of(keys, shards)
    if level > 2:
        head = gram_key(rows[:, :2])
        order = np.argsort(head)
        rows, counts, shard = rows[order], counts[order], shard[order]
        yield from _packs(level, "grams", shard, [head[order], *rows.T[2:], counts], shards)
    else:
        yield from _packs(level, "grams", shard, [keys, counts], shards)


def _unpacked_grams(level: int, packs: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, word ids and summed counts of the packs of a shard."""
    names = ["u8", *["u4"] * max(level - 2, 0), "i8"]
    columns = [np.concatenate(c) for c in zip(*[_unpack(data, n, names) for n, data in packs], strict=True)]
    first = _words_of(columns[0], min(level, 2))
    rows = np.column_stack([first, *columns[1:-1]]) if level > 2 else first
    keys, (counts,), one = _merge(gram_key(rows), [columns[-1]])
    return keys, rows[one], counts


def _count_grams(vocabulary: Vocabulary, order: int, shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(vocabulary)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            keys, (counts,), first = _merge(gram_key(rows), [np.ones(len(rows), np.int64)])
            yield from _gram_packs(order, keys, rows[first], counts, shards)

        for texts in _runs(batches):
            pad = [START] * (order - 1)
            found = ids.of([[*pad, *words, END] for words in texts])
            seq = np.concatenate(found)
            last = np.cumsum([len(f) for f in found])
            inside = np.ones(len(seq), bool)
            for e in range(1, order):  # a gram may not run over the end of its text
                inside[last - e] = False
            at = np.flatnonzero(inside)
            held.append(np.stack([seq[at + j] for j in range(order)], axis=1))
            size += len(at)
            if size > 6_000_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _gram_shards(folder: str, order: int, shards: int) -> Callable:
    """Merge n-grams of a level with the contexts of the level above, which are n-grams of this length too.

    One array of keys serves both: beside it the counts, and below the highest level total and numbers of
    words after the context. Packs of contexts and of continuations go to the next lower level.
    """

    def work(level: int, shard: int, packs: dict) -> Iterator[tuple]:
        keys, rows, counts = _unpacked_grams(level, packs["grams"]) if "grams" in packs else (
            np.zeros(0, np.uint64), np.zeros((0, level), np.uint32), np.zeros(0, np.int64))
        values, every = [counts], keys
        if level < order:
            after, sums = _merged(packs["contexts"], ["u8", *["i8"] * 4], lambda a: _merge(a[0], a[1:])[:2]) if "contexts" in packs else (
                np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 4)
            every = np.union1d(keys, after)
            own, theirs = np.searchsorted(every, keys), np.searchsorted(every, after)
            values = []
            for at, v in [(own, counts), *[(theirs, v) for v in sums]]:
                values.append(np.zeros(len(every), np.int64))
                values[-1][at] = v
        file = write_arrays(folder, [every, *[part for v in values for part in _narrow(v)]])
        of_counts = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        yield level, "grams", shard, len(keys), file, [int(counts.sum()), int((counts >= 3).sum()), *of_counts], None
        if level == 1:
            return
        context = gram_key(rows[:, :-1])
        seen = [counts, *[(counts == 1), (counts == 2), (counts >= 3)]]
        context, sums, _ = _merge(context, [s.astype(np.int64) for s in seen])
        for b in _packs(level - 1, "contexts", _shard_of(context, shards), [context, *sums], shards):
            yield _passed(b)
        tail = rows[:, 1:]
        key, (many,), one = _merge(gram_key(tail), [np.ones(len(tail), np.int64)])
        tail = tail[one]
        for b in _gram_packs(level - 1, key, tail, many, shards):
            yield _passed(b)

    return work


def _passed(b: pa.RecordBatch) -> tuple:
    level, kind, shard, n, data = (c[0].as_py() for c in b.columns)
    return level, kind, shard, n, None, None, data


def _narrow(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in a byte each; those of 255 and more by their place, whole."""
    large = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8), large, counts[large]


def _words_of(keys: np.ndarray, level: int) -> np.ndarray:
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return low[:, None] if level == 1 else np.stack([(keys >> np.uint64(32)).astype(np.uint32), low], axis=1)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from the numbers of n-grams seen once to four times."""
    if not all(n):
        return FALLBACK
    y = n[0] / (n[0] + 2 * n[1])
    d = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return d if all(0 < v <= k for k, v in enumerate(d, 1)) else FALLBACK


@dataclass(frozen=True)
class Level:
    """`table` has the counts of its n-grams, and what follows them as contexts of the level above."""

    table: Arrays
    discounts: tuple[float, float, float]
    total: int
    seen: tuple[int, int, int]  # n-grams with count 1, 2, 3 or more


@dataclass(frozen=True)
class Model:
    order: int
    vocabulary: Vocabulary
    levels: dict[int, Level] = field(hash=False)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Of the last word of each row of ids (order words), given the words before it."""
        low = self.levels[1]
        types = self.vocabulary.types
        p = np.full(len(rows), 1.0 / (types + 1))
        if not low.total:
            return p
        for k in range(1, self.order + 1):
            level = self.levels[k]
            part = rows[:, self.order - k :]
            count = level.table.find(gram_key(part))[0]
            count[(part == UNSEEN).any(axis=1)] = 0
            d = np.array([0.0, *level.discounts])[np.minimum(count, 3)]
            if k == 1:
                total = np.full(len(rows), low.total, np.int64)
                spare = np.full(len(rows), float(np.dot(level.discounts, level.seen)))
            else:
                total, n1, n2, n3 = self.levels[k - 1].table.find(gram_key(part[:, :-1]))[1:]
                total[(part[:, :-1] == UNSEEN).any(axis=1)] = 0
                spare = level.discounts[0] * n1 + level.discounts[1] * n2 + level.discounts[2] * n3
            known = total > 0
            whole = np.where(known, total, 1)
            p = np.where(known, (count - d) / whole + spare / whole * p, p)
        return p


def fit(docs: DataFrame, folder: str, order: int = 3, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count all of `docs` and write the model's arrays into `folder`, a new path in the shared store.

    A null text is an empty one: its end is its only token. Without documents the model knows
    nothing, and every word has probability 1 / (0 types + 1).
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    done = kept(_shard_tasks(texts.mapInArrow(_count_words(shards), _PACK), _word_shards(f"{folder}/arrays")), "words")
    release(spark)
    rows = done.collect()  # one per shard
    sizes = np.zeros(shards + 1, np.int64)
    for r in rows:
        sizes[r.shard + 1] = r.n
    vocabulary = Vocabulary(
        Arrays(shards, True, {r.shard: r.file for r in rows}, 1), np.cumsum(sizes)[:-1],
        sum(r.stats[0] for r in rows), sum(r.stats[1] for r in rows))
    if int(sizes.sum()) >= int(UNSEEN):
        raise ValueError("more distinct words than ids")
    packs = texts.mapInArrow(_count_grams(vocabulary, order, shards), _PACK)
    levels: dict[int, Level] = {}
    for level in range(order, 0, -1):
        done = kept(_shard_tasks(packs, _gram_shards(f"{folder}/arrays", order, shards)), f"level-{level}")
        rows = done.where("pack is null").drop("pack").collect()  # one per shard
        stats = [sum(r.stats[k] for r in rows) for k in range(6)]
        levels[level] = Level(
            Arrays(shards, False, {r.shard: r.file for r in rows}, 1 if level == order else 5, narrow=True), discounts(stats[2:]), stats[0], (stats[2], stats[3], stats[1]))
        release(spark)
        if level < order:  # the packs of the level above are merged and written
            drop_path(spark, f"{folder}/level-{level + 1}")
        packs = done.where("pack is not null").select("level", "kind", "shard", "n", F.col("pack").alias("data"))
    return Model(order, vocabulary, levels)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` of `docs` with n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Scores are sums of log10 probabilities over the words of the whole text and its end; base_score
    is that of the add-one unigram model. A null text is empty. Rows that repeat score alike; an empty
    table stays empty; columns of `docs` with those names are replaced.
    """
    added = {"n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double",
             "score": "double", "perplexity": "double"}
    names = [c for c in keep if c not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # paths and totals; the arrays stay in files
    fields = [docs.schema[c] for c in names] + [T.StructField(c, T.LongType() if k == "bigint" else T.DoubleType()) for c, k in added.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vocabulary, order = model.vocabulary, model.order
        ids = _Ids(vocabulary)
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for _, texts in slices((t.as_py() for t in b.column("_text")), SLICE_CHARS):
                found = ids.of([[*[START] * (order - 1), *word_bytes(t), END] for t in texts])
                seq = np.concatenate(found)
                sizes = np.array([len(f) - order + 1 for f in found])
                first = np.cumsum([0, *[len(f) for f in found]])[:-1]
                at = np.repeat(first - np.cumsum([0, *sizes])[:-1], sizes) + np.arange(sizes.sum())
                grams = np.stack([seq[at + j] for j in range(order)], axis=1)
                keys = gram_key(grams)
                order_of = np.argsort(keys)
                keys = keys[order_of]
                new = np.concatenate([[True], keys[1:] != keys[:-1]])
                logs = np.empty(len(grams))
                logs[order_of] = np.log10(model.probabilities(grams[order_of[new]]))[np.cumsum(new) - 1]
                count = vocabulary.counts(grams[:, -1])
                base = np.log10((count + 1.0) / (vocabulary.tokens + vocabulary.types + 1.0))
                starts = np.cumsum([0, *sizes])[:-1]
                for column, value in zip(out, (sizes, np.add.reduceat((count > 0).astype(np.int64), starts),
                                               np.add.reduceat(base, starts), np.add.reduceat(logs, starts)), strict=True):
                    column.append(value)
            n, known, base, total = (np.concatenate(c) if c else np.zeros(0) for c in out)
            perplexity = 10 ** (-total / np.maximum(n, 1))
            arrays = [pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                      pa.array(np.full(len(n), vocabulary.tokens), pa.int64()), pa.array(base, pa.float64()),
                      pa.array(total, pa.float64()), pa.array(perplexity, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *arrays], names=[*names, *added])

    return rows.mapInArrow(run, T.StructType(fields))
