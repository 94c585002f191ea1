"""Trees and learners with the fold as a key, against plain versions that fit one fold at a time."""

import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import grids as G
from cohortloom.operators import grouped_trees as GT
from cohortloom.operators import learners as L
from cohortloom.operators import neighbours as NB
from cohortloom.operators.resample import replicate_weights

FEATURES = ["a", "b", "c"]
SCHEMA = "fold int, id bigint, cohort int, y double, a double, b double, c double, slot int"


def table(seed=1, folds=(3, 4), n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randint(0, 9), rng.random(), rng.choice([None, 1.0, 2.0])
        y = round(abs(a * (1 if b > 0.5 else 0.2) + (c or 0) + rng.gauss(0, 0.3)), 4)
        rows += [(f, i, i % 3, y if i % 17 else None, float(a), b, c, 1 + a) for f in folds if i % 3 + 1 <= f]
    return rows


def frames(spark, folds=(3, 4), n=160):
    rows = table(folds=folds, n=n)
    test = [(f, 1000 + i, 9, 1.0 + i % 4, float(i % 10), i / 40, [None, 1.0][i % 2], 1 + i % 10) for f in folds for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(test, SCHEMA).repartition(3)


def plain_cuts(values, bins):
    values = [v for v in values if v is not None]
    return np.unique(np.percentile(values, [100 * i / bins for i in range(1, bins)])) if values else np.zeros(0)


def plain_tree(x, y, w, growth, choose, node=0, level=0):
    """Splits {node: (feature, bin)} and {leaf: rows} by trying every cut of every allowed feature."""
    best = None
    if level < growth.depth:
        for j in choose(node):
            for cut in sorted({r[j] for r in x}):
                left = [k for k in range(len(x)) if x[k][j] <= cut]
                wl, w_all = sum(w[k] for k in left), sum(w)
                if wl < growth.min_leaf or w_all - wl < growth.min_leaf:
                    continue
                yl, y_all = sum(w[k] * y[k] for k in left), sum(a * b for a, b in zip(w, y))
                gain = yl**2 / wl + (y_all - yl) ** 2 / (w_all - wl) - y_all**2 / w_all
                if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-12)):
                    best = gain, j, cut
    if best is None:
        return {}
    out = {node: (best[1], best[2])}
    for child, goes_left in ((2 * node + 1, True), (2 * node + 2, False)):
        own = [k for k in range(len(x)) if (x[k][best[1]] <= best[2]) == goes_left]
        out |= plain_tree([x[k] for k in own], [y[k] for k in own], [w[k] for k in own], growth, choose, child, level + 1)
    return out


def bins_of(row, cuts):
    return [0 if v is None else 1 + int(np.searchsorted(c, v, side="left")) for v, c in zip(row, cuts)]


def splits(grove, s, t):
    return {n: (int(f), int(grove.cut[s, t, n])) for n, f in enumerate(grove.feature[s, t]) if f >= 0}


@pytest.mark.parametrize("variants", [None, {"all": FEATURES, "one": ["b"], "two": ["a", "c"]}])
def test_forest_trees(spark, variants):
    growth = GT.Growth(trees=3, depth=3, min_leaf=9, bins=8, share=0.6, seed=5)
    train, _ = frames(spark)
    grove, _ = GT.grow(train, FEATURES, "y", growth, variants=variants)
    assert len(grove.sets) == 2 * len(variants or [1])
    for s, (_, f) in enumerate(grove.sets):
        rows = [r for r in table() if r[0] == grove.folds[f] and r[3] is not None]
        cuts = [plain_cuts([r[4 + j] for r in rows], growth.bins) for j in range(3)]
        assert all(np.allclose(a, b) for a, b in zip(cuts, grove.cuts[f]))
        x = [bins_of(r[4:7], cuts) for r in rows]
        for t in range(growth.trees):
            w = [int(v) for v in replicate_weights(np.array([r[1] for r in rows]), growth.trees, growth.seed)[:, t]]
            assert splits(grove, s, t) == plain_tree(x, [r[3] for r in rows], w, growth, lambda n: grove.chosen(s, t, n))


def test_boosted_trees(spark):
    growth = GT.Growth(trees=4, depth=2, min_leaf=10, bins=8, rate=0.3)
    train, test = frames(spark)
    grove, _ = GT.grow(train, FEATURES, "y", growth)
    got = {(r.fold, r.id): r.prediction for r in GT.predictions(train.unionByName(test), grove, ["id"]).collect()}
    for s, (_, f) in enumerate(grove.sets):
        rows = [r for r in table() if r[0] == grove.folds[f] and r[3] is not None]
        x = [bins_of(r[4:7], grove.cuts[f]) for r in rows]
        guess = [sum(r[3] for r in rows) / len(rows)] * len(rows)
        for t in range(growth.trees):
            left = [r[3] - g for r, g in zip(rows, guess)]
            tree = plain_tree(x, left, [1] * len(rows), growth, lambda n: range(3))
            assert splits(grove, s, t) == tree
            ends = []
            for row in x:
                n = 0
                while n in tree:
                    n = 2 * n + 1 + (row[tree[n][0]] > tree[n][1])
                ends.append(n)
            means = {n: np.mean([v for v, e in zip(left, ends) if e == n]) for n in set(ends)}
            guess = [g + growth.rate * means[e] for g, e in zip(guess, ends)]
        assert all(abs(got[r[0], r[1]] - g) < 1e-5 for r, g in zip(rows, guess))
    shares = grove.importances()["all", 3]
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["a"] > shares["c"]


def test_a_grove_is_the_same_on_any_partitioning(spark):
    train, _ = frames(spark)
    growth = GT.Growth(trees=2, depth=3, min_leaf=5, bins=16)
    one, _ = GT.grow(train.coalesce(1), FEATURES, "y", growth)
    many, _ = GT.grow(train.repartition(17), FEATURES, "y", growth)
    assert (one.feature == many.feature).all() and (one.cut == many.cut).all() and (one.gain == many.gain).all()


def test_forest_grids_are_weighted_quantiles(spark):
    """With one tree and cuts at every outcome, a grid is the leaf's own distribution."""
    rows = [(1, i, 0, float(i), float(i >= 50), 0.0, None, 1) for i in range(100)]
    train = spark.createDataFrame(rows, SCHEMA)
    out = GT.forest_grids(train, train, FEATURES, "y", GT.Growth(trees=1, depth=1, min_leaf=10), points=98).collect()
    for r in out:
        low = 50 * (r.id >= 50)
        assert all(abs(q - (low + 50 * t - 1)) <= 1.0 for q, t in zip(r.grid, G.LEVELS)), (r.id, r.grid)


def test_rows_without_features_outcomes_or_folds(spark):
    train, test = frames(spark)
    odd = [(3, 5000, 0, None, 1.0, 1.0, 1.0, 1), (None, 5001, 0, 1.0, 1.0, 1.0, 1.0, 1), (3, 5002, 0, 1.0, None, None, None, None)]
    growth = GT.Growth(trees=2, depth=2, min_leaf=5, bins=8)
    out = GT.forest_grids(train.unionByName(spark.createDataFrame(odd, SCHEMA)), test.unionByName(spark.createDataFrame(odd, SCHEMA)), FEATURES, "y", growth)
    got = {(r.fold, r.id): r.grid for r in out.collect()}
    assert (3, 5002) in got and (3, 5000) in got and len(got) == 82 and all(len(g) == 19 and None not in g for g in got.values())
    with pytest.raises(ValueError, match="no training row"):
        GT.grow(train.where("y > 1e9"), FEATURES, "y", growth)


def every_learner():
    small = GT.Growth(trees=3, depth=2, min_leaf=5, bins=8, share=0.7)
    base = [L.SlotLearner(k=20), L.NeighbourLearner(FEATURES, 10), L.NeighbourLearner(FEATURES, 10, weighted=True, name="weighted"),
            L.TreeProximityLearner(FEATURES, GT.Growth(trees=3, depth=2, min_leaf=5, bins=8, rate=0.3), 10), L.ForestLearner(FEATURES, small)]
    blend = L.BlendLearner([base[0], base[4]], [1, 1])
    return [*base, blend, L.ConformalLearner(base[0]), L.ConformalLearner(L.BlendLearner([base[0], base[1]], [1, 3], "mix"))]


def jobs_of(spark, run):
    sc = spark.sparkContext
    name = f"jobs-{random.random()}"
    sc.setJobGroup(name, name)
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("learner", every_learner(), ids=lambda x: x.name)
def test_jobs_do_not_grow_with_folds(spark, learner):
    """And every fold's grids are those of a run with that fold alone."""
    # Adaptive plans count a job for every stage that they wait for, broadcasts one for every table below a size.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts, grids = [], []
        for folds in ((3,), (3, 4, 5, 6)):
            train, test = frames(spark, folds)
            out = []
            counts.append(jobs_of(spark, lambda: out.extend(learner.predict(train, test).collect())))
            grids.append({(r.fold, r.id): r.grid for r in out})
        assert len(grids[0]) == 40 and len(grids[1]) == 160
        assert all(len(g) == 19 for g in grids[1].values())
        assert all(np.allclose(sorted(grids[1][key]), sorted(g)) for key, g in grids[0].items())
        assert counts[0] == counts[1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_slot_learner_is_the_slot_model(spark):
    train, test = frames(spark)
    got = {(r.fold, r.id): r.grid for r in L.SlotLearner(k=15).predict(train, test).collect()}
    rows = [r for r in table() if r[3] is not None]
    for r in test.collect():
        near = sorted((round(abs(math.log(x[7]) - math.log(r.slot)) * 1e9), x[1], x[3]) for x in rows if x[0] == r.fold)[:15]
        assert np.allclose(got[r.fold, r.id], np.percentile([y for _, _, y in near], [100 * t for t in G.LEVELS]))


def test_ridge_weights_by_fold(spark):
    """Against a dense solution per fold with leave-one-out by refitting."""
    train, _ = frames(spark, n=60)
    train = train.where("y is not null")
    got = L.ridge_weights(train, FEATURES, [0.1, 1.0, 100.0])
    for fold in (3, 4):
        rows = [r for r in table(n=60) if r[0] == fold and r[3] is not None]
        x = np.array([[np.nan if v is None else v for v in r[4:7]] for r in rows], float)
        x = np.nan_to_num((x - np.nanmean(x, 0)) / np.nanstd(x, 0, ddof=1))
        y = np.array([r[3] for r in rows])

        def solve(x, y, a):
            mx, my = x.mean(0), y.mean()
            return mx, my, np.linalg.solve((x - mx).T @ (x - mx) + a * np.eye(3), (x - mx).T @ (y - my))

        loss = []
        for a in (0.1, 1.0, 100.0):
            e = 0.0
            for i in range(len(y)):
                mx, my, w = solve(np.delete(x, i, 0), np.delete(y, i), a)
                e += (y[i] - my - (x[i] - mx) @ w) ** 2
            loss.append(e)
        w = np.abs(solve(x, y, (0.1, 1.0, 100.0)[int(np.argmin(loss))])[2])
        assert np.allclose(got[fold], w / w.sum() * math.sqrt(3), rtol=1e-6)


def test_conformal_covers_the_held_out_cohort(spark):
    """The shift is the held-out residuals' quantile at the conformal level, per level."""
    train, test = frames(spark, folds=(4,))
    learner = L.SlotLearner(k=20)
    got = {r.id: r.grid for r in L.ConformalLearner(learner).predict(train, test).collect()}
    fit, held = train.where("cohort < 2"), train.where("cohort = 2 and y is not null")
    inner = {r.id: sorted(r.grid) for r in learner.predict(fit, test.unionByName(held)).collect()}
    resid = [[r.y - q for q in inner[r.id]] for r in held.collect()]
    n = len(resid)
    for i, tau in enumerate(G.LEVELS):
        delta = np.quantile([e[i] for e in resid], min(math.ceil((n + 1) * tau) / n, 1.0))
        for r in test.collect():
            assert abs(got[r.id][i] - max(inner[r.id][i] + delta, 0.0)) < 1e-9


def test_backtest_and_comparisons(spark):
    train, test = frames(spark)
    slot, near = L.SlotLearner(k=20), L.NeighbourLearner(FEATURES, 10)
    out = L.backtest([slot, near, L.BlendLearner([slot, near], [1, 1])], train, test)
    grids = {(r.model, r.fold, r.id): r.grid for r in out.collect()}
    assert len(grids) == 3 * 80
    for (model, fold, i), g in grids.items():
        if model == "blend":
            assert np.allclose(g, (np.array(grids["slot", fold, i]) + np.array(grids["stats neighbours", fold, i])) / 2)
    scored = out.withColumn("crps", G.crps("y", "grid"))
    pairs = {"near vs slot": ("stats neighbours", "slot"), "slot vs slot": ("slot", "slot"), "none": ("slot", "absent")}
    got = {r.comparison: r for r in L.compare(scored, pairs, 200).collect()}
    mean = {r.model: r.m for r in scored.groupBy("model").agg(F.avg("crps").alias("m")).collect()}
    assert set(got) == {"near vs slot", "slot vs slot"}
    assert abs(got["near vs slot"].diff - (mean["stats neighbours"] - mean["slot"])) < 1e-9
    assert got["slot vs slot"].verdict == "no detectable difference" and got["near vs slot"].lo <= got["near vs slot"].diff <= got["near vs slot"].hi


def test_learners_are_fitted_side_by_side(spark):
    """Learners that wait for each other's fit: one after the other they would never meet."""
    train, test = frames(spark)
    met = threading.Barrier(3)

    class Waiting(L.SlotLearner):
        def predict(self, train, test):
            met.wait(60)
            return super().predict(train, test)

    parts = [Waiting(k=20, name=n) for n in "abc"]
    out = L.backtest([L.BlendLearner(parts[:2], [1, 1]), *parts], train, test)
    assert {r.model: r.n for r in out.groupBy("model").agg(F.count("grid").alias("n")).collect()} == dict.fromkeys(["blend", "a", "b", "c"], 80)
    L.ConformalLearner(L.BlendLearner(parts, [1, 1, 1])).predict(train, test)


# ---- replicates and permutations of ranks ----


def average_ranks(v, w):
    v, w = np.array(v, float), np.array(w, float)
    return np.array([w[v < a].sum() + (w[v == a].sum() + 1) / 2 for a in v])


@pytest.mark.parametrize("buckets", [2, 64])
def test_spearman_replicates(spark, buckets):
    """Against ranks of copies per replicate; ties, a hot value, nulls, a group without spread."""
    from cohortloom.operators import association as AS

    rng = random.Random(4)
    rows = [(g, i + 1000 * j, float(rng.choice([0, 0, 0, 1, 2, 5, rng.random()])), float(rng.randint(0, 6)) if rng.random() > 0.05 else None)
            for j, g in enumerate(["a", "b", None]) for i in range(90)]
    rows += [("flat", 9000 + i, 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, id bigint, v double, u double").repartition(7)
    got = {}
    for r in AS.spearman_replicates(df, "v", "u", "id", ["g"], 25, seed=3, buckets=buckets).collect():
        got[r.g, r.rep] = r.rho
    for g in ("a", "b", "flat"):
        own = [r for r in rows if r[0] == g and r[3] is not None]
        w = replicate_weights(np.array([r[1] for r in own]), 25, 3)
        for rep in range(1, 26):
            a, b, c = average_ranks([r[2] for r in own], w[:, rep - 1]), average_ranks([r[3] for r in own], w[:, rep - 1]), w[:, rep - 1].astype(float)
            a, b = a - (c @ a) / max(c.sum(), 1), b - (c @ b) / max(c.sum(), 1)
            xx, yy = c @ (a * a), c @ (b * b)
            want = c @ (a * b) / math.sqrt(xx * yy) if xx > 1e-9 and yy > 1e-9 else None
            assert (got[g, rep] is None) == (want is None) and (want is None or abs(got[g, rep] - want) < 1e-9), (g, rep)


def test_spearman_replicates_make_no_rows_per_replicate(spark):
    from cohortloom.operators import association as AS

    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"), (F.col("id") % 11).alias("u"))
    plan = AS.spearman_replicates(df, "v", "u", "id", [], 300)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_bijection(n):
    from cohortloom.operators.permutation import feistel

    images = [feistel(n, key) for key in range(8)]
    assert all(sorted(i.tolist()) == list(range(n)) for i in images)
    assert n < 5 or len({tuple(i.tolist()) for i in images}) == 8


def test_feistel_spreads_evenly():
    """Every place goes to every place about equally often."""
    from cohortloom.operators.permutation import feistel

    seen = np.zeros((6, 6))
    for key in range(6000):
        seen[np.arange(6), feistel(6, key * 7919 + 13)] += 1
    assert abs(seen - 1000).max() < 150


@pytest.mark.parametrize("block", [65_536, 32])
def test_permutation_null(spark, block):
    from cohortloom.operators.permutation import permutation_test

    rng = np.random.default_rng(2)
    n = 300
    x = rng.normal(size=n)
    rows = [(i, float(x[i]), float(x[i] * 0.18 + rng.normal()), float(rng.integers(0, 4)), None if i % 3 else 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, z double, u double").repartition(5)
    for other, signal in (("y", True), ("z", False)):
        out = permutation_test(df, "x", other, "id", 400, block=block).first()
        values = np.array([r[2 if other == "y" else 3] for r in rows])
        one = np.ones(n)
        a, b = average_ranks(x, one), average_ranks(values, one)
        rho = np.corrcoef(a, b)[0, 1]
        null = [np.corrcoef(a, rng.permutation(b))[0, 1] for _ in range(4000)]
        p = np.mean(np.abs(null) >= abs(rho))
        assert out.n == n and abs(out.rho - rho) < 1e-9 and abs(out.p - p) < 4 * math.sqrt(max(p * (1 - p), 0.002) / 400)
        assert (out.p < 0.05) == signal
    assert tuple(permutation_test(df, "x", "u", "id", 50).first()) == (None, 100, None)
    assert tuple(permutation_test(df.limit(0), "x", "y", "id", 50).first()) == (None, 0, None)


def test_products_of_permutations(spark):
    """Blocks, shifts and the short block give each second rank once."""
    from cohortloom.operators.permutation import permuted_products

    first, second = np.ones(23), np.arange(23.0)
    rows = [(k, first[5 * k : 5 * k + 5].tolist(), second[5 * k : 5 * k + 5].tolist()) for k in range(5)]
    blocks = spark.createDataFrame(rows, "block bigint, first array<double>, second array<double>")
    out = permuted_products(blocks, 4, 30, 3, 1).collect()
    assert len(out) == 30 and all(r.s == second.sum() for r in out)
    blocks = blocks.withColumn("first", F.col("second"))
    assert len({r.s for r in permuted_products(blocks, 4, 30, 3, 1).collect()}) > 20


def test_boxes_of_cells_come_from_batches(spark):
    """Sides of boxes of unit vectors of many dimensions, missing values left out (F14: norms were made anew for every element)."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=(60, 5))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:20, 3] = np.nan
    cells = np.arange(60) % 3
    cells[:20] = 7
    df = spark.createDataFrame([(int(c), i, [None if np.isnan(v) else float(v) for v in r]) for i, (c, r) in enumerate(zip(cells, x))],
                               "_cell long, id long, vec array<double>")
    for space, scaled in ((NB.Space(weights=[1.0, 2.0, 0.0, 1.0, 3.0]), x * np.array([1.0, 2.0, 0.0, 1.0, 3.0])), (NB.Space(), x)):
        got = {(r["_cell"], r["_d"]): r for r in NB.cell_dimensions(df, space, []).collect()}
        for c in set(cells.tolist()):
            for d in range(5):
                v, r = scaled[cells == c, d], got[c, d]
                known = v[~np.isnan(v)]
                assert r["n"] == len(v) and r["always"] == (len(known) == len(v))
                assert (r["lo"], r["hi"]) == ((None, None) if not len(known) else (known.min(), known.max()))


def test_rows_that_must_agree_meet_first(spark):
    """F6, F16: subjects meet the rows that agree with them; only those without k of them meet the others."""
    rng = np.random.default_rng(32)
    n = 240
    x, pos = rng.normal(size=(n, 2)), rng.integers(0, 8, n)
    pos[:2] = 90  # two rows of their own
    kind = [None if i % 40 == 3 else str(q) for i, q in enumerate(pos)]
    rows = spark.createDataFrame([(i, [float(v) for v in r], q) for i, (r, q) in enumerate(zip(x, kind))], "id long, vec array<double>, pos string")
    meter = spark.sparkContext.accumulator(0)
    got = NB.nearest(rows, rows, NB.Space(same=["pos"]), 3, [], "id", pivots=4, tile=64, meter=meter).toPandas()
    for i in range(n):
        d = np.sqrt(((x - x[i]) ** 2).sum(1)) + 1000.0 * np.array([a != kind[i] for a in kind])
        d = np.round(d, 9)
        d[i] = np.inf
        g = got[got.id == i].sort_values("rank")
        assert list(g.neighbour) == list(np.argsort(d, kind="stable")[:3])
    assert meter.value < n * n / 3
