"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

A text is its set of word shingles. Texts with the same set are one class at once. A class has a
signature of `hashes` minima, `bits` bits each; two classes at similarity J differ in a minimum with
probability 1 - J, so a pair at the limit differs in more than `plan.distance` of them with
probability below `miss`. The signature is split into chunks: by pigeonhole a pair within the
distance has a chunk with at most `plan.errors` differing minima, and all ways of leaving that many
out of a chunk are enumerated as keys. So every pair within the distance shares a key.

Tasks get the classes of a key together, compare their signatures, and confirm what is within the
distance on the full shingle sets, unless the pair hangs together already. A pair is looked at under
the first key that it shares only. What leaves a task are links that join two groups, so a key that
holds many copies gives no more rows than it has classes. Signatures and sets lie in the shared
folder as arrays by class and are mapped into memory, so that a class has one row per key, not one
copy of its set per key. Keys with very many classes are cut into tiles that share some classes; tiles
meet each other only if their classes are still apart after that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import scratch, size_files
from .common import drop_path, mapped, mix64, release, stage, word_bytes, write_array


@dataclass(frozen=True)
class Plan:
    """Signature layout: `hashes` minima of `bits` bits in chunks of `chunk` minima."""

    similarity: int = 80  # per cent
    words: int = 5
    hashes: int = 80
    bits: int = 16
    chunk: int = 5
    miss: float = 1e-4
    seed: int = 1

    @property
    def chunks(self) -> int:
        return -(-self.hashes // self.chunk)

    @property
    def distance(self) -> int:
        """Fewest differing minima that a pair at the limit exceeds with probability below `miss`."""
        p, below = 1 - self.similarity / 100, 0.0
        for d in range(self.hashes + 1):
            below += comb(self.hashes, d) * p**d * (1 - p) ** (self.hashes - d)
            if 1 - below < self.miss:
                return d
        return self.hashes

    @property
    def errors(self) -> int:
        """Differing minima that some chunk of a pair within the distance never exceeds."""
        return self.distance // self.chunks

    @property
    def ways(self) -> list[tuple[int, list[list[int]]]]:
        """(chunk, places that stay of it) for all ways of leaving `errors` of its minima out."""
        out = []
        for c in range(self.chunks):
            places = range(c * self.chunk, min(self.hashes, (c + 1) * self.chunk))
            out.append((c, [list(x) for x in combinations(places, max(0, len(places) - self.errors))]))
        return out

    @property
    def most_ways(self) -> int:
        return comb(self.chunk, min(self.errors, self.chunk))

    def keys(self, sig: Column) -> Column:
        """Hashes of what stays of each chunk, for every chunk and way."""
        return F.array(*[
            F.xxhash64(F.lit(c), F.lit(k), *[sig[i] for i in kept]) for c, ways in self.ways for k, kept in enumerate(ways)])

    def kind(self, place: Column) -> Column:
        """Number of the chunk and way of the key at a place of `keys`."""
        kinds = [c * self.most_ways + k for c, ways in self.ways for k in range(len(ways))]
        return F.element_at(F.lit(kinds), place + 1)


#: Classes that one file of arrays holds; classes of a large key that lie in all its tiles, about.
SHARD_NODES, COMMON = 100_000, 16


class _Hashes(dict):
    """Hash by word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(words: list[bytes], k: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle, none is an empty set."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    if not width:
        return h
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        acc = mix64(acc ^ h[j : len(h) - width + 1 + j])
    return np.unique(acc)


def _minima(u: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (u >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 4096):
        best = np.minimum(best, (x[s : s + 4096, None] * a + b).min(axis=0))
    return best


def _signatures(plan: Plan, id_type: pa.DataType):
    schema = pa.schema([
        ("id", id_type), ("text_key", pa.binary()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
        ("sig", pa.list_(pa.int32())),
    ])
    rng = np.random.default_rng(plan.seed)
    a = rng.integers(0, 1 << 32, plan.hashes, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, plan.hashes, dtype=np.uint32)
    mask = np.uint64((1 << plan.bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for rb in batches:
            n, h1, h2, sigs = [], [], [], []
            for text in rb.column("text"):
                u = shingle_set(word_bytes(text.as_py()), plan.words, hashes)
                n.append(len(u))
                h1.append(int(u.sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(mix64(u ^ np.uint64(plan.seed)).sum(dtype=np.uint64).astype(np.int64)))
                sigs.append((mix64(_minima(u, a, b)) & mask).astype(np.int32) if len(u) else None)
            arrays = [rb.column("id"), rb.column("text_key")]
            arrays += [pa.array(x, f.type) for x, f in zip((n, h1, h2, sigs), list(schema)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _set_rows(plan: Plan):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.uint64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for rb in batches:
            for s in range(0, rb.num_rows, 500):
                part = rb.slice(s, 500)
                sets = [shingle_set(word_bytes(t.as_py()), plan.words, hashes) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=schema.names)

    return run


@dataclass(frozen=True)
class ByNode:
    """Rows of variable length by node: per shard the sorted nodes, where their rows start, and all values."""

    files: dict[int, tuple[str, str, str]] = field(hash=False)
    shards: int = 1

    def places(self, nodes: np.ndarray) -> list[tuple[int, int]]:
        """(shard, place) of each node."""
        shard = (nodes % self.shards).astype(np.int64)
        place = np.zeros(len(nodes), np.int64)
        for k in np.unique(shard):
            at = shard == k
            place[at] = np.searchsorted(mapped(self.files[int(k)][0]), nodes[at])
        return list(zip(shard.tolist(), place.tolist(), strict=True))

    def row(self, at: tuple[int, int]) -> np.ndarray:
        _, starts, values = (mapped(f) for f in self.files[at[0]])
        return values[starts[at[1]] : starts[at[1] + 1]]

    def matrix(self, nodes: np.ndarray, width: int) -> np.ndarray:
        """Rows of one width as a matrix."""
        shard = nodes % self.shards
        out = None
        for k in np.unique(shard):
            own, _, values = (mapped(f) for f in self.files[int(k)])
            at = np.flatnonzero(shard == k)
            rows = values.reshape(-1, width)[np.searchsorted(own, nodes[at])]
            out = np.empty((len(nodes), width), values.dtype) if out is None else out
            out[at] = rows
        return np.zeros((0, width), np.uint16) if out is None else out


def keep_by_node(rows: DataFrame, folder: str, shards: int, dtype: str) -> ByNode:
    """Write (node, values array<bigint>) rows as arrays by node; `rows` has one row per node."""

    def write(part: pa.Table) -> pa.Table:
        nodes = part.column("node").to_numpy()
        order = np.argsort(nodes)
        lists = part.column("values").combine_chunks().take(pa.array(order))
        starts = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()[starts[0] : starts[-1]]
        kept = (nodes[order], starts - starts[0], values.view(np.uint64) if dtype == "uint64" else values.astype(dtype))
        return pa.table({"shard": [int(nodes[0] % shards)], "files": [[write_array(folder, a) for a in kept]]})

    placed = rows.withColumn("shard", F.pmod("node", F.lit(shards)))
    done = placed.groupBy("shard").applyInArrow(write, "shard bigint, files array<string>")
    done.write.parquet(f"{folder}/manifest")
    got = rows.sparkSession.read.parquet(f"{folder}/manifest").collect()  # one row per shard
    return ByNode({r.shard: tuple(r.files) for r in got}, shards)


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], rows: int = 30_000) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups (equal key and tile) of a sorted partition, some groups at a time."""
    held: list[np.ndarray] | None = None
    for b in batches:
        new = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]) > rows:
            turn = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
            if len(turn):
                cut = turn[-1] + 1
                yield [x[:cut] for x in held]
                held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _pairs(key: np.ndarray, tile: np.ndarray, at_once: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs inside groups of sorted rows, a bounded number at a time."""
    n = len(key)
    turn = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(tile) != 0)]))
    end = np.repeat(np.append(turn[1:], n), np.diff(np.append(turn, n)))
    many = end - np.arange(n) - 1
    total = np.cumsum(many)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + at_once, side="right")))
        left = np.repeat(np.arange(at, to), many[at:to])
        nth = np.arange(len(left)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to])
        yield left, left + 1 + nth
        at = to


def _close(block: list[np.ndarray], sigs: ByNode, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, distance) places of pairs within the distance that are due under this key.

    A row is (key, tile, kind, node, root, side); classes that hang together, or lie on one side where
    sides are given, are no pair.
    """
    key, tile, kind, node, root, side = block
    own, back = np.unique(node, return_inverse=True)
    sig = sigs.matrix(own, plan.hashes)
    chunk, way = kind // plan.most_ways, kind % plan.most_ways

    def agree(left: np.ndarray, right: np.ndarray, places: list[int] | slice) -> np.ndarray:
        return sig[back[left], places] == sig[back[right], places]

    for left, right in _pairs(key, tile):
        ok = (root[left] != root[right]) & ((side[left] < 0) | (side[left] != side[right])) & (node[left] != node[right])
        left, right = left[ok], right[ok]
        # A pair is due under its first key: no earlier chunk may agree, and no earlier way in this one.
        for c, ways in plan.ways:
            later = np.flatnonzero(chunk[left] > c)
            if len(later):
                span = slice(ways[0][0], ways[0][0] + len(set().union(*ways)))
                same = agree(left[later], right[later], span).sum(axis=1) >= len(ways[0])
                left, right = np.delete(left, later[same]), np.delete(right, later[same])
            here = chunk[left] == c
            for k, places in enumerate(ways[:-1]):
                after = np.flatnonzero(here & (way[left] > k))
                if len(after):
                    gone = after[agree(left[after][:, None], right[after][:, None], places).all(axis=1)]
                    left, right, here = np.delete(left, gone), np.delete(right, gone), np.delete(here, gone)
        apart = (sig[back[left]] != sig[back[right]]).sum(axis=1)
        ok = apart <= plan.distance
        yield left[ok], right[ok], apart[ok]


_ROW = ("key", "tile", "kind", "node", "root", "side")


def _near_nodes(sigs: ByNode, plan: Plan):
    """Classes with another one within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches, _ROW):
            found = np.zeros(len(block[0]), bool)
            for left, right, _ in _close(block, sigs, plan):
                found[left] = found[right] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(block[3][found]))], names=["node"])

    return run


def _links(sigs: ByNode, sets: ByNode, plan: Plan):
    """Links that join two groups of a block, nearest pairs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches, _ROW):
            node, root = block[3], block[4]
            above: dict[int, int] = {}

            def top(x: int, above=above) -> int:
                while above.get(x, x) != x:
                    above[x] = above.get(above[x], above[x])
                    x = above[x]
                return x

            out: list[tuple[int, int]] = []
            for left, right, apart in _close(block, sigs, plan):
                order = np.argsort(apart, kind="stable")
                ends, back = np.unique(np.concatenate([left[order], right[order]]), return_inverse=True)
                places = sets.places(node[ends])
                for i, j in zip(back[: len(order)].tolist(), back[len(order):].tolist(), strict=True):
                    a, b = top(int(root[ends[i]])), top(int(root[ends[j]]))
                    if a == b:
                        continue
                    x, y = sets.row(places[i]), sets.row(places[j])
                    if min(len(x), len(y)) * 100 < plan.similarity * max(len(x), len(y)):
                        continue
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    inter = int((both[1:] == both[:-1]).sum())
                    if 100 * inter >= plan.similarity * (len(both) - inter):
                        above[max(a, b)] = min(a, b)
                        out.append((int(node[ends[i]]), int(node[ends[j]])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return run


#: Rounds grow with the logarithm of a component's diameter; so many mean a fault.
ROUNDS = 199


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): root is the smallest node of its component.

    Alternating large and small stars: each round hangs neighbours on the smallest one known, until
    nothing changes; rounds grow with the logarithm of a component's diameter. No component is ever
    gathered: a node's neighbours meet in map-side minima only.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = stage(edges.where("a <> b").select(hi.alias("u"), lo.alias("v")).distinct(), f"{folder}/stars-0")
    state = None
    for step in range(1, ROUNDS + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        )
        now = stage(small, f"{folder}/stars-{step}")
        # A sum of 32-bit hashes over any number of edges fits, and names the set of edges.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.sum(F.hash("v", "u").cast("long"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components still change after {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", tile: int = 4096
) -> DataFrame:
    """One row per row of `docs`: id, text_key (md5 of the text), n_shingles, component_id, kept.

    `tile` bounds the classes of a key that one task compares.

    component_id is the smallest id that links reach, kept tells whether it is the row's own. Only the
    id and the text are read. A null or blank text has an empty set and is linked with nothing: it is
    its own component. A null id never is a component_id, unless no text of the group has an id; then
    component_id is null and kept is true. Rows that repeat get the same result each. An empty table gives an
    empty result.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "near")
    size_files(spark)
    source = docs.select(
        F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("text_key"),
        F.col(text_col).alias("text"),
    )
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("text_key", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
        T.StructField("sig", T.ArrayType(T.IntegerType())),
    ])
    signed = stage(source.mapInArrow(_signatures(plan, to_arrow_type(kind)), schema), f"{folder}/signatures")
    classes = stage(
        signed.where("n > 0").groupBy("n", "h1", "h2").agg(
            F.min("id").alias("min_id"), F.min("text_key").alias("text_key"), F.first("sig").alias("sig")
        ).withColumn("node", F.monotonically_increasing_id()),
        f"{folder}/classes",
    )
    shards = max(1, -(-classes.count() // SHARD_NODES))
    sigs = keep_by_node(
        classes.select("node", F.transform("sig", lambda v: v.cast("bigint")).alias("values")), f"{folder}/sig-arrays", shards,
        "uint16" if plan.bits <= 16 else "uint32")
    release(spark)

    keys = classes.select("node", F.posexplode(plan.keys(F.col("sig"))).alias("kind", "key"))
    keys = keys.withColumn("kind", plan.kind(F.col("kind")))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark counts an exploded array as one value, so it takes these keys for a small table; both sides are shuffled.
    met = stage(keys.join(shared.hint("merge"), "key"), f"{folder}/met")
    release(spark)

    # Tiles of a large key share some classes, so that copies hang together across tiles.
    tiles = F.ceil(F.col("n") / tile).cast("int")
    spot = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    anywhere = spot < F.lit(float(COMMON * (1 << 30))) / F.col("n")
    rows = met.withColumn("tile", F.explode(
        F.when(tiles == 1, F.array(F.lit(0))).when(anywhere, F.sequence(F.lit(0), tiles - 1)).otherwise(
            F.array(F.pmod(F.xxhash64(F.lit("tile"), "node"), tiles).cast("int")))))
    own = rows.select("key", "tile", "kind", "node", F.col("node").alias("root"), F.lit(-1).alias("side"))

    def grouped(frame: DataFrame) -> DataFrame:
        return frame.repartition("key", "tile").sortWithinPartitions("key", "tile", "node")

    # Copies of a text meet map-side first, so that one with very many rows moves few.
    texts = source.select("text_key", "text").dropDuplicates(["text_key"])

    def linked(rows: DataFrame, name: str) -> DataFrame:
        """Links among classes that meet in `rows`; only those with another one within the distance get their set written."""
        near = grouped(rows).mapInArrow(_near_nodes(sigs, plan), "node bigint").distinct()
        need = stage(classes.select("node", "text_key").join(near, "node", "left_semi"), f"{folder}/{name}-nodes")
        release(spark)
        sets = keep_by_node(
            texts.join(need, "text_key").select("node", "text").mapInArrow(_set_rows(plan), "node bigint, shingles array<bigint>")
            .withColumnRenamed("shingles", "values"),
            f"{folder}/{name}-sets", shards, "uint64")
        release(spark)
        within = rows.join(need.select("node"), "node", "left_semi")
        out = stage(grouped(within).mapInArrow(_links(sigs, sets, plan), "a bigint, b bigint"), f"{folder}/{name}-links")
        drop_path(spark, f"{folder}/{name}-sets")
        release(spark)
        return out

    links = linked(own, "first")
    known = components(links, f"{folder}/first")

    large = met.where(F.col("n") > tile)
    if not large.isEmpty():
        # Tiles of a key whose classes are still apart meet pair by pair, with all their classes: two that
        # are near each other only may lie in different tiles.
        labelled = large.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        left = labelled.join(apart.select("key"), "key", "left_semi").withColumn("tiles", tiles).withColumn(
            "side", F.pmod(F.xxhash64(F.lit("tile"), "node"), F.col("tiles")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        met_tiles = left.withColumn("other", other).where("other <> side").withColumn(
            "tile", F.least("side", "other") * F.col("tiles") + F.greatest("side", "other"))
        known = components(links.unionByName(linked(met_tiles.select(*_ROW), "second")), f"{folder}/second")

    member = classes.select("n", "h1", "h2", "min_id", "node").join(known, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    least = member.groupBy("root").agg(F.min("min_id").alias("component_id"))
    found = member.join(least.hint("merge"), "root").select("n", "h1", "h2", "component_id")
    out = signed.join(found, ["n", "h1", "h2"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
