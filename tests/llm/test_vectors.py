"""Vector codes and centroids against full searches in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import centroids, vector_codes, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, id int, code string, far double, cluster string"


def rows_of(seed, n, dim, grid):
    """Clustered rows on a coarse grid, so that distances tie, with copies, odd rows and a label that most rows have."""
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        m = middles[min(rng.randrange(12), 5)]
        out.append((i * 3 % 1000, [round((x + rng.gauss(0, 0.2)) * grid) / grid for x in m], rng.choice([1, 1, 1, 2, None])))
    out += [out[2], out[2], (out[1][0], out[3][1], 2)]
    out += [(None, out[0][1], 3), (2001, None, 1), (2002, [math.nan] * dim, 1), (2003, [math.inf] + [0.0] * (dim - 1), None)]
    out += [(2004, [None] + [0.0] * (dim - 1), 1), (2005, [0.0] * (dim - 1), 1), (2006, [], 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "c", 0.5, "k") for r in rows], SCHEMA).repartition(3)


def whole(rows, dim, scale):
    """Kept rows with components as whole numbers."""
    ok = [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in ok]


def dist(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(points, book, rounds):
    """Full search in every round, ties to the lower entry, means rounded down."""
    book = [list(b) for b in book]
    pick = lambda p: min(range(len(book)), key=lambda k: (dist(p, book[k]), k))
    for _ in range(rounds):
        at = [pick(p) for p in points]
        for k in range(len(book)):
            own = [p for p, a in zip(points, at) if a == k]
            if own:
                book[k] = [sum(c) // len(own) for c in zip(*own)]
    return [pick(p) for p in points], book


def by_id(i):
    return (i is None, i or 0)


@pytest.mark.parametrize(("seed", "n", "grid", "rounds"), [(1, 150, 8, 6), (2, 150, 4, 3), (3, 4, 8, 6), (4, 90, 1, 0)])
def test_codes(spark, seed, n, grid, rounds):
    rows = rows_of(seed, n, 8, grid)
    plan = vector_codes.Plan(dim=8, parts=4, entries=9, rounds=rounds, scale=16.0)
    got, books = vector_codes.compress(frame(spark, rows), plan)
    assert got.columns == ["id", "label", "code", "error", "label_error"]
    kept = whole(rows, 8, 16.0)
    first = sorted(kept, key=lambda r: (by_id(r[0]), r[1]))[:9]
    codes, error, flat = [""] * len(kept), [0] * len(kept), []
    for p in range(4):
        cut = slice(2 * p, 2 * p + 2)
        at, book = lloyd([r[1][cut] for r in kept], [r[1][cut] for r in first], rounds)
        flat += [c for b in book for c in b]
        for i, k in enumerate(at):
            codes[i] += f"{k:02x}"
            error[i] += dist(kept[i][1][cut], book[k])
    sums = {}
    for (_, _, label), e in zip(kept, error):
        sums[label] = sums.get(label, 0) + e
    want = sorted(((i, label, c, e, sums[label]) for (i, _, label), c, e in zip(kept, codes, error)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert vector_codes.books_digest(books) == hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def test_active_entries_meet_the_full_search():
    """Rounds with moved entries of any number give the entries and distances of a full scan, ties included."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, book = rng.integers(-3, 4, (40, 3)), rng.integers(-3, 4, (6, 3))
        entry, far = vector_codes.scan(x, book)
        moved = rng.random(6) < rng.choice([0, 0.2, 0.5, 1])
        book = np.where(moved[:, None], rng.integers(-3, 4, (6, 3)), book)
        got, want = vector_codes.rescan(x, book, moved, entry, far), vector_codes.scan(x, book)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_passive_parts_compare_moved_entries_only(monkeypatch):
    seen, plain = [], vector_codes.squares
    monkeypatch.setattr(vector_codes, "squares", lambda x, book: (seen.append((len(x), len(book))), plain(x, book))[1])
    x, book = np.array([[0], [1], [10], [11], [20]]), np.array([[0], [10], [20]])
    entry, far = vector_codes.scan(x, book)
    seen.clear()
    vector_codes.rescan(x, np.array([[0], [10], [21]]), np.array([False, False, True]), entry, far)
    assert seen == [(4, 1), (1, 3)]


def test_distances_are_exact_beyond_doubles():
    x = np.array([[2**26, -(2**26)], [2**26 + 1, 2**26]])
    book = np.array([[-(2**26), 2**26], [2**26, 2**26]])
    assert vector_codes.squares(x, book).tolist() == [[dist(map(int, a), map(int, b)) for b in book] for a in x]


def test_components_that_leave_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(frame(spark, [(1, [1e30] * 8, 1)]), vector_codes.Plan(dim=8, parts=4))


@pytest.mark.parametrize(("seed", "n", "grid"), [(1, 200, 8), (2, 200, 2), (3, 4, 8)])
def test_centroids(spark, seed, n, grid):
    rows = rows_of(seed, n, 8, grid)
    plan = centroids.Plan(dim=8, clusters=6, rounds=3, scale=16.0, pivots=4, pool=9)
    got, centres, inertia = centroids.cluster(frame(spark, rows), plan)
    kept = whole(rows, 8, 16.0)
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else name(r[0]), r[1]))[:6]
    at, book = lloyd([r[1] for r in kept], [r[1] for r in first], 3)
    want = [(i, k, dist(v, book[k])) for (i, v, _), k in zip(kept, at)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert centres.tolist() == book
    assert inertia == {k: sum(d for _, c, d in want if c == k) for k in set(at)}
    assert centroids.centre_digests(centres)[0] == hashlib.sha256(",".join(map(str, book[0])).encode()).hexdigest()


def test_pivots_rule_out_most_centroids():
    rng = np.random.default_rng(7)
    middles = rng.integers(-4000, 4000, (40, 16))
    x = middles[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 16))
    pivots = centroids.choose_pivots(x[:64], 8)
    table = np.stack([centroids.apart(x, p) for p in pivots], 1)
    cluster, far, measured = centroids.nearest(x, table, middles, pivots)
    full = np.stack([centroids.apart(x, c) for c in middles], 1)
    assert (cluster == full.argmin(1)).all() and (far == full.min(1)).all()
    assert measured < 0.2 * full.size


def test_pivots_of_equal_rows():
    x = np.zeros((5, 4), np.int64)
    pivots = centroids.choose_pivots(x, 3)
    assert len(pivots) == 3
    cluster, far, _ = centroids.nearest(x, np.zeros((5, 3), np.int64), np.zeros((4, 4), np.int64), pivots)
    assert cluster.tolist() == [0] * 5 and far.tolist() == [0] * 5


@pytest.mark.parametrize("rows", [[], [(1, None, 2)], [(1, [math.nan] * 64, None)]])
def test_tables_without_vectors(spark, rows):
    coded, books = vector_codes.compress(frame(spark, rows))
    assert coded.columns == ["id", "label", "code", "error", "label_error"] and coded.count() == 0 and not books.size
    grouped, centres, inertia = centroids.cluster(frame(spark, rows))
    assert grouped.columns == ["id", "cluster", "distance"] and grouped.count() == 0 and not centres.size and inertia == {}


def test_copies_of_one_vector(spark):
    """A table of one vector: equal entries, of which the lowest is used."""
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.25)] * 64).alias("embedding"), F.lit(None).cast("int").alias("label"))
    coded, _ = vector_codes.compress(df)
    assert [tuple(r) for r in coded.select("code", "error", "label_error").distinct().collect()] == [("00" * 8, 0, 0)]
    grouped, _, inertia = centroids.cluster(df)
    assert grouped.where("cluster = 0 and distance = 0").count() == 3000 and inertia == {0: 0}


def test_group_sums_and_means():
    sums = vectors.group_sums(np.array([2, 0, 2]), np.array([[1, -3], [5, 5], [2, -4]]), 4)
    assert sums.tolist() == [[5, 5, 1], [0, 0, 0], [3, -7, 2], [0, 0, 0]]
    assert vectors.means(sums.reshape(-1).tolist(), np.full((4, 2), 9)).tolist() == [[5, 5], [9, 9], [1, -4], [9, 9]]
