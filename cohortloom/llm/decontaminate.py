"""Passages of a benchmark in a corpus, by a prefix-filtered set join.

Every item is cut into windows of `width` consecutive words (a shorter item is one window). A
window is a set of (word, place) tokens that must be contained whole, so its necessary prefix is
one token: its rarest word, by frequencies counted over the whole corpus. Corpus words are joined
to prefix tokens only; length and positional bounds drop candidates that would start before or end
after the text; what is left is verified word by word.

The benchmark is cut into blocks of bounded size. A block travels with the tasks; a larger
benchmark means more passes over the corpus, never a larger block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, batch, slices

#: Bytes outside words (x00-x2F, x3A-x60, x7B-x7F after lower-casing A-Z) become spaces.
_BREAK = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
WORD_TABLE = bytes.maketrans(
    bytes(b for b in _BREAK if chr(b) not in UPPER) + UPPER.encode(),
    b" " * sum(chr(b) not in UPPER for b in _BREAK) + LOWER.encode(),
)
#: Item words that one block may hold: bounds what is sent to a task.
BLOCK_WORDS = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_TABLE).split() if text else []


class Block:
    """Windows of some items as arrays: word ids by window, padded with -1, and their owners."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int) -> None:
        self.ids: dict[bytes, int] = {}
        rows, owner = [], []
        self.items = [item for item, _ in items]
        for k, (_, words) in enumerate(items):
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words]
            for s in range(max(1, len(seq) - width + 1)):
                part = seq[s : s + width]
                rows.append(part + [-1] * (width - len(part)))
                owner.append(k)
        self.windows = np.array(rows, np.int32).reshape(-1, width)
        self.owner = np.array(owner, np.int32)
        self.lengths = (self.windows >= 0).sum(1)

    def order_by_rarity(self, counts: dict[int, int]) -> None:
        """Choose each window's rarest word and its place, and group windows by that word."""
        rarity = np.array([counts.get(i, 0) for i in range(len(self.ids))], np.int64)
        cost = np.where(self.windows >= 0, rarity[self.windows], np.iinfo(np.int64).max)
        self.place = cost.argmin(1)
        prefix = self.windows[np.arange(len(self.windows)), self.place]
        self.by_prefix = np.argsort(prefix, kind="stable")
        ends = np.searchsorted(prefix[self.by_prefix], np.arange(len(self.ids) + 1))
        self.first, self.many = ends[:-1], np.diff(ends)

    def encode(self, words: list[bytes]) -> np.ndarray:
        get = self.ids.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))

    def matches(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every occurrence of a window in a text's word ids."""
        spots = np.flatnonzero(seq >= 0)
        many = self.many[seq[spots]]
        spots, many = spots[many > 0], many[many > 0]
        starts, windows = [], []
        step = np.cumsum(many)
        at = 0
        while at < len(spots):  # bounded candidates at a time, however often a prefix word occurs
            to = max(at + 1, int(np.searchsorted(step, (step[at - 1] if at else 0) + 1_000_000)))
            p, m = spots[at:to], many[at:to]
            reps = np.repeat(np.arange(len(p)), m)
            nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            w = self.by_prefix[self.first[seq[p]][reps] + nth]
            s = p[reps] - self.place[w]
            ok = (s >= 0) & (s + self.lengths[w] <= len(seq))
            s, w = s[ok], w[ok]
            for k in range(self.windows.shape[1]):
                want = self.windows[w, k]
                same = (want < 0) | (seq[np.minimum(s + k, len(seq) - 1)] == want)
                s, w = s[same], w[same]
            starts.append(s)
            windows.append(w)
            at = to
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *windows])


def _blocks(items: DataFrame, width: int, limit: int) -> Iterator[Block]:
    """Items as blocks of at most `limit` words (one longer item is a block alone)."""
    held, size = [], 0
    for item, text in items.toLocalIterator():
        words = words_of(text)
        if held and size + len(words) > limit:
            yield Block(held, width)
            held, size = [], 0
        if words:
            held.append((item, words))
            size += len(words)
    if held:
        yield Block(held, width)


def _frequencies(texts: DataFrame, block: Block) -> dict[int, int]:
    """How often each word of the block occurs in the whole corpus."""
    shared = texts.sparkSession.sparkContext.broadcast(block)
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own.ids) + 1, np.int64)
        for b in batches:
            for _, part in slices((t.as_py() for t in b.column(0)), 4_000_000):
                seen = np.concatenate([own.encode(words_of(t)) for t in part])
                total += np.bincount(seen + 1, minlength=len(total))
        words = np.flatnonzero(total[1:])
        yield batch(schema, {"word": words, "n": total[1:][words]})

    counts = texts.mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counts.toLocalIterator()}


#: What a pass adds to a row: number of words, hit spans [start, end), items found.
_ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("_starts", T.ArrayType(T.IntegerType())),
    T.StructField("_ends", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType())),
])
_KINDS = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]


def _pass(docs: DataFrame, text_col: str, block: Block, keep: list[str]) -> DataFrame:
    """Each row with the hits of one block added to those of the blocks before it."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    again = "_starts" in docs.columns
    names = [*keep, *_ADDED.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i, text in enumerate(b.column(text_col)):
                seq = own.encode(words_of(text.as_py()))
                s, w = own.matches(seq)
                items = {own.items[k] for k in np.unique(own.owner[w])}
                ends = s + own.lengths[w]
                if again:
                    s = np.concatenate([s, b.column("_starts")[i].values.to_numpy()])
                    ends = np.concatenate([ends, b.column("_ends")[i].values.to_numpy()])
                    items.update(b.column("items")[i].as_py())
                depth = np.zeros(len(seq) + 1, np.int32)
                np.add.at(depth, s, 1)
                np.add.at(depth, ends, -1)
                edge = np.diff((np.cumsum(depth) > 0).astype(np.int8), prepend=np.int8(0))
                for column, value in zip(
                    out, (len(seq), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), sorted(items)), strict=True
                ):
                    column.append(value)
            added = [pa.array(column, kind) for column, kind in zip(out, _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + added, names=names)

    fields = [docs.schema[c] for c in keep] + list(_ADDED)
    return docs.mapInArrow(run, T.StructType(fields))


def contamination(
    docs: DataFrame, items: DataFrame, width: int = 10, text_col: str = "text", keep: list[str] | None = None,
    item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of `docs` with n_words, n_hit, n_items, items (sorted as strings) added.

    `keep` names the columns that come along (all, unless given); columns of `docs` with the names of
    added ones are replaced. A word is hit if it lies inside any occurrence of a window. A null or
    empty text has no words; items without words have no window; items with the same id count as one
    item, a null item id as ''. Repeated rows stay. Empty tables on either side give zero counts. No
    shuffle is needed: rows pass through the blocks one after the other.
    """
    added = ("n_words", "n_hit", "n_items", "items", "_starts", "_ends")
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*dict.fromkeys([*names, text_col]))
    chosen = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(item_text_col))
    blocks = list(_blocks(chosen, width, block_words)) or [Block([], width)]
    for k, block in enumerate(blocks):
        block.order_by_rarity(_frequencies(docs.select(text_col), block))
        last = k == len(blocks) - 1
        rows = _pass(rows, text_col, block, names if last else list(dict.fromkeys([*names, text_col])))
    spans = F.arrays_zip("_starts", "_ends")
    hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + x["_ends"] - x["_starts"])
    return rows.select(
        *names, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.array_sort("items").alias("items"),
    )
