"""Neighbours, style vectors and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import court as X
from ..functions import grids as G
from ..operators import aggregates as A
from ..operators import grouped_trees as GT
from ..operators import learners as L
from ..operators import neighbours as NB
from ..operators import pair_quantiles as PQ
from ..operators import ranking as RK
from ..operators import spatial as SP
from .bindings import CTES, FOLDS, HORIZON, slot_model_ctes
from .cleaning import _XY, _ZONE, court_shots
from .registry import query
from .statistics import FEATURES, fold_rows

k = F.col


@query("sim1_slot_neighbours", "SELECT fold, slot, grid[1] AS q05, grid[10] AS q50, grid[18] AS q90 FROM sm_pred", "sm_pred", ints="fold slot", rnd="q05 q50 q90")
def _(t):
    f = t.model().fit(t.tgt)
    return f.select("fold", "slot", k("grid")[0].alias("q05"), k("grid")[9].alias("q50"), k("grid")[17].alias("q90"))


CTES.update(slot_model_ctes("ak", "tgt", HORIZON, FOLDS, k=60, adaptive=True))


@query("sim2_adaptive_k", "SELECT fold, slot, grid[5] AS q25, grid[10] AS q50 FROM ak_pred", "ak_pred", ints="fold slot", rnd="q25 q50")
def _(t):
    from dataclasses import replace

    f = replace(t.model(), adaptive=True).fit(t.tgt)
    return f.select("fold", "slot", k("grid")[4].alias("q25"), k("grid")[9].alias("q50"))


def spaces(t, features=FEATURES, extra=()):
    """(subjects, pool) of the folds with z-scored feature vectors."""
    train, test = fold_rows(t)
    cols = ["fold", "id", "vec", "y", *extra]
    pool = NB.standardised(train, features, ["fold"], train).select(*cols)
    subj = NB.standardised(test, features, ["fold"], train).select(*cols)
    return subj, pool


def _z(f: str, alias: str) -> str:
    return f"({alias}.{f} - m_{f}) / coalesce(nullif(s_{f}, 0), 1)"


CTES["trn"] = (
    "SELECT f.fold, feat.*, tgt.y, tgt.position FROM feat JOIN tgt USING (entity) JOIN (VALUES (1996), (1997), (1998)) f(fold) ON tgt.cohort + 2 <= f.fold WHERE y IS NOT NULL",
    ["feat", "tgt"],
)
CTES["tst"] = (
    "SELECT tgt.cohort AS fold, feat.*, tgt.y, tgt.position FROM feat JOIN tgt USING (entity) WHERE y IS NOT NULL AND tgt.cohort BETWEEN 1996 AND 1998",
    ["feat", "tgt"],
)
CTES["zst"] = (
    "SELECT fold, " + ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in FEATURES) + " FROM trn GROUP BY 1", ["trn"],
)
_D2 = {f: f"({_z(f, 'a')} - {_z(f, 'b')})" for f in FEATURES}
_SHARED = " + ".join(f"(a.{f} IS NOT NULL AND b.{f} IS NOT NULL)::INT" for f in FEATURES)
_OWN = " + ".join(f"(a.{f} IS NOT NULL)::INT" for f in FEATURES)


def pair_sql(weights=None, guard="0"):
    w = weights or {f: 1.0 for f in FEATURES}
    sq = " + ".join(f"coalesce({w[f]} * {w[f]} * {_D2[f]} * {_D2[f]}, 0)" for f in FEATURES)
    return f"""SELECT a.fold, a.entity AS id, b.entity AS neighbour, b.y, sqrt(4.0 / ({_SHARED}) * ({sq}))
      + CASE WHEN ({_SHARED}) < 0.7 * ({_OWN}) THEN 1000 ELSE 0 END + {guard} AS d, {", ".join(f"abs({w[f]} * {_D2[f]}) AS g_{f}" for f in FEATURES)}
      FROM tst a JOIN trn b ON a.fold = b.fold AND a.entity <> b.entity JOIN zst ON zst.fold = a.fold WHERE ({_SHARED}) > 0"""


CTES["pairs"] = (pair_sql(), ["tst", "trn", "zst"])
CTES["near"] = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, id ORDER BY round(d, 9), neighbour) AS rank FROM pairs) WHERE rank <= 15",
    ["pairs"],
)


def comps(t):
    def build():
        subj, pool = spaces(t)
        return NB.nearest(subj, pool, NB.Space(), 15, ["fold"], "id")

    return t.stage("comps", build)


@query("sim3_feature_neighbours", "SELECT fold, id, rank, neighbour, round(d, 9) AS distance FROM near", "near", ints="fold rank", rnd="distance")
def _(t):
    return comps(t).select("fold", "id", "rank", "neighbour", "distance")


CTES["reasons_"] = (
    """SELECT fold, id, rank, array_to_string(list_transform(list_sort(list_filter([{'g': round(g_f1, 9), 'i': 0, 'v': 'slot'}, {'g': round(g_f2, 9), 'i': 1, 'v': 'first value'},
      {'g': round(g_f3, 9), 'i': 2, 'v': 'minutes'}, {'g': round(g_f4, 9), 'i': 3, 'v': 'price'}], lambda s: s.g IS NOT NULL))[1:3], lambda s: s.v), ', ') AS why FROM near""",
    ["near"],
)
CTES["similar_"] = (
    """SELECT fold, id, rank, round(greatest(0.0, 100 * (1 - round(d, 9) / m)), 1) AS similarity, d >= 1000 AS low_overlap FROM near JOIN
    (SELECT fold, id, median(round(d, 9)) AS m FROM pairs GROUP BY 1, 2) USING (fold, id)""",
    ["near", "pairs"],
)


@query("sim4_driving_features", "SELECT * FROM reasons_", "reasons_", ints="fold rank")
def _(t):
    return reasons(t)


def reasons(t):
    subj, pool = spaces(t)
    n = comps(t).join(subj.select("fold", "id", k("vec").alias("a")), ["fold", "id"]).join(
        pool.select("fold", k("id").alias("neighbour"), k("vec").alias("b")), ["fold", "neighbour"]
    )
    gap = F.transform(NB.gaps(k("a"), k("b")), lambda g: F.round(g, 9))
    why = NB.driving_features(gap, ["slot", "first value", "minutes", "price"])
    return n.select("fold", "id", "rank", why.alias("why"))


@query("sim5_similarity_score", "SELECT * FROM similar_", "similar_", ints="fold rank", rnd="similarity", places=1)
def _(t):
    return similarity_scores(t)


def similarity_scores(t):
    return t.stage("similarity_scores", lambda: _similarity_scores(t))


def _similarity_scores(t):
    subj, pool = spaces(t)
    med = PQ.middle_distances(subj, pool, NB.Space(), ["fold"]).select("fold", "id", k("median").alias("m"))
    d = comps(t).join(med, ["fold", "id"])
    sim = F.round(F.greatest(F.lit(0.0), 100 * (1 - k("distance") / k("m"))), 1)
    return d.select("fold", "id", "rank", sim.alias("similarity"), (k("distance") >= 1000).alias("low_overlap"))


def each_fold(build):
    """One result of `build(fold)` per fold, with the fold as a key."""
    parts = [build(f).withColumn("fold", F.lit(f)) for f in FOLDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("sim6_learned_weights")
def _(t):
    """Neighbours by features weighted with a ridge fit of each fold, all folds in one job (tests/test_learners.py)."""
    train, test = fold_rows(t)
    near = L.NeighbourLearner(FEATURES, 10, weighted=True).neighbours(train, test)
    return near.select("fold", "id", "rank", "neighbour", F.round("distance", 5).alias("distance"))


@query("sim7_tree_proximity")
def _(t):
    """Quantiles of the rows that share most leaves, all folds in one grove (tests/test_learners.py)."""
    train, test = fold_rows(t)
    grids = L.TreeProximityLearner(FEATURES).predict(train, test).join(test.select("fold", "id", "y"), ["fold", "id"])
    return grids.select("fold", "id", F.round(G.crps("y", "grid"), 6).alias("crps"))


CTES["gpairs"] = (
    pair_sql(guard="CASE WHEN a.position <> b.position OR abs(a.f1 - b.f1) > 3 THEN 1000 ELSE 0 END"), ["tst", "trn", "zst"],
)


@query(
    "sim8_guarded_neighbours",
    """SELECT fold, id, rank, neighbour, round(d, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY fold, id ORDER BY round(d, 9), neighbour) AS rank FROM gpairs) WHERE rank <= 5""",
    "gpairs", ints="fold rank", rnd="distance",
)
def _(t):
    subj, pool = spaces(t, extra=("position", "f1"))
    space = NB.Space(same=["position"], within=("f1", 3.0))
    return NB.nearest(subj, pool, space, 5, ["fold"], "id").select("fold", "id", "rank", "neighbour", "distance")


@query("sim9_blended_neighbours")
def _(t):
    """Half stats distance, half guarded profile distance, each over its median eligible distance."""
    subj, pool = spaces(t, extra=("position", "f1"))
    a, b = NB.Space(), NB.Space(same=["position"], within=("f1", 3.0))

    def half(df, lo, n):
        return df.withColumn("vec", F.slice("vec", lo + 1, n))

    found = []
    for lo, space in ((0, a), (2, b)):
        c = PQ.middle_distances(half(subj, lo, 2), half(pool, lo, 2), space, ["fold"], per_subject=False, below=space.penalty)
        found.append({r["fold"]: r["median"] for r in c.collect()})  # one row per fold

    def one(fold):
        at = k("fold") == fold
        mix = NB.Space(parts=[(0, 2, 0.5 / found[0][fold], a), (2, 4, 0.5 / found[1][fold], b)])
        return NB.nearest(subj.where(at), pool.where(at), mix, 10, ["fold"], "id")

    return each_fold(one).select("fold", "id", "rank", "neighbour", F.round("distance", 6).alias("distance"))


def vectors(t):
    return t.embeddings.select(
        k("vec_id").alias("id"), k("embedding").cast("array<double>").alias("vec"), k("label").cast("double").alias("height"),
    )


@query(
    "sim10_cosine_neighbours",
    """SELECT id, rank, neighbour, 1 - d AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), neighbour) AS rank FROM (
      SELECT a.vec_id AS id, b.vec_id AS neighbour, 1 - list_cosine_similarity(a.e, b.e) AS d
      FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) b
      ON a.vec_id <> b.vec_id AND abs(a.label - b.label) <= 3)) WHERE rank <= 5""",
    ints="rank", rnd="similarity", places=6,
)
def _(t):
    v = vectors(t)
    n = NB.nearest(v, v, NB.Space(cosine=True, within=("height", 3.0)), 5, [], "id")
    near = n.where("distance < 1000")
    return near.select("id", "rank", "neighbour", (1 - k("distance")).alias("similarity"))


def augmented(rows, vec, extra, by, weight=0.5):
    """Unit vector plus weight * z(extra) within its group, normalised again; unknown is average."""
    stats = rows.groupBy(*by).agg(F.avg(extra).alias("_m"), F.stddev_samp(extra).alias("_s"))
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda x, v: x + v * v))
    z = F.coalesce((k(extra) - k("_m")) / k("_s"), F.lit(0.0)) * weight
    d = rows.join(stats, by).withColumn("_n", norm(k(vec)))
    d = d.withColumn("_v", F.concat(F.transform(vec, lambda v: v / k("_n")), F.array(z))).withColumn("_n2", norm(k("_v")))
    return d.withColumn(vec, F.transform("_v", lambda v: v / k("_n2"))).drop("_m", "_s", "_n", "_v", "_n2")


CTES["aug"] = (
    """SELECT vec_id AS id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT vec_id, list_append(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))),
      0.5 * coalesce((x0 - avg(x0) OVER (PARTITION BY label)) / stddev_samp(x0) OVER (PARTITION BY label), 0)) AS v FROM (
      SELECT vec_id, label, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 7 <> 0 THEN CAST(vec_id % 13 AS DOUBLE) END AS x0 FROM embeddings))""",
    [],
)


def augmented_vectors(t):
    v = t.embeddings.select(
        k("vec_id").alias("id"), k("embedding").cast("array<double>").alias("vec"), "label",
        F.when(k("vec_id") % 7 != 0, (k("vec_id") % 13).cast("double")).alias("x0"),
    )
    return augmented(v, "vec", "x0", ["label"])


@query("sim11_augmented_vector", "SELECT id, v[1] AS first, v[65] AS last FROM aug", "aug", rnd="first last", places=8)
def _(t):
    return augmented_vectors(t).select("id", k("vec")[0].alias("first"), k("vec")[64].alias("last"))


@query(
    "sim12_similarity_percentile",
    """SELECT id, neighbour, (SELECT count(*) FROM pdist p WHERE p.d > n.d) / (SELECT count(*) FROM pdist) AS pct FROM (
      SELECT id, neighbour, d FROM (SELECT a.id, b.id AS neighbour, round(1 - list_dot_product(a.v, b.v), 9) AS d, row_number() OVER (PARTITION BY a.id ORDER BY round(1 - list_dot_product(a.v, b.v), 9), b.id) AS rn
        FROM aug a JOIN aug b ON a.id <> b.id) WHERE rn <= 2) n""",
    "pdist", rnd="pct", places=7,
)
def _(t):
    """Share of all pairs that are less alike than a row and its neighbour."""
    v = augmented_vectors(t)
    space = NB.Space(cosine=True)
    near = t.stage("augmented_neighbours", lambda: NB.nearest(v, v, space, 2, [], "id").select("id", "neighbour", k("distance").alias("d")))
    # Pairs beyond the farthest neighbour are less alike than every score: only the others are counted one by one.
    farthest = near.agg(F.max("d")).first()[0]
    close = PQ.close_distances(v, space, farthest)
    rows = v.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    # Scores take part with weight 0, so every score finds the pairs up to it.
    both = close.select(k("distance").alias("d"), "n").unionByName(near.select("d", F.lit(0).cast("long").alias("n")))
    pos = RK.value_positions(both, "d", [], "n").select("d", (1 - (k("below") + k("ties")) / (rows * (rows - 1) / 2)).alias("pct"))
    return near.join(pos, "d").select("id", "neighbour", "pct")


CTES["pdist"] = ("SELECT round(1 - list_dot_product(a.v, b.v), 9) AS d FROM aug a JOIN aug b ON a.id < b.id", ["aug"])


# A small table met with a large one by features: the k nearest customers of every supplier.
@query(
    "jn22_knn_join",
    """SELECT id, rank, neighbour, distance FROM (SELECT s_suppkey AS id, c_custkey AS neighbour, d AS distance, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, c_custkey) AS rank FROM (
      SELECT s_suppkey, c_custkey, round(sqrt(((s_acctbal - c_acctbal) / 1000) ** 2 + (s_nationkey - c_nationkey) ** 2), 9) AS d FROM supplier, customer)) WHERE rank <= 5""",
    ints="rank", rnd="distance",
)
def _(t):
    """The k nearest rows of another table."""
    def side(df, p):
        point = F.array((k(f"{p}_acctbal") / 1000).cast("double"), k(f"{p}_nationkey").cast("double"))
        return df.select(k("s_suppkey" if p == "s" else "c_custkey").alias("id"), point.alias("vec"))

    space = NB.Space(exclude_self=False)
    return NB.nearest(side(t.supplier, "s"), side(t.customer, "c"), space, 5, [], "id").select("id", "rank", "neighbour", "distance")

# ------------------------------------------------------------------------------------ maps

KERNEL_SQL = "(VALUES " + ", ".join(f"({o}, {w!r})" for o, w in SP.kernel()) + ") kv(o, w)"
CTES["mapped"] = (
    f"""SELECT key, ix * 35 + iy + 4 AS cell, n / sum(n) OVER (PARTITION BY key) AS density FROM (
      SELECT key, ix, iy + o AS iy, sum(n * w) AS n FROM (SELECT key, ix + o AS ix, iy, sum(n * w) AS n FROM (
        SELECT id AS key, CAST(floor(abs(sx) + 0.5) AS INT) AS ix, CAST(floor(sy + 0.5) AS INT) AS iy, count(*) AS n FROM {_XY}
        WHERE sx IS NOT NULL GROUP BY 1, 2, 3), {KERNEL_SQL} WHERE ix BETWEEN 0 AND 25 AND iy BETWEEN -4 AND 30 AND ix + o BETWEEN 0 AND 25 GROUP BY 1, 2, 3), {KERNEL_SQL}
      WHERE iy + o BETWEEN -4 AND 30 GROUP BY 1, 2, 3)""",
    ["shots"],
)


def maps(t):
    s = court_shots(t).where("xy_valid").withColumnRenamed("id", "key")
    return t.stage("maps", lambda: SP.density_maps(s, "key", "sx", "sy"))


@query("map1_density_map", "SELECT key, cell, density FROM mapped", "mapped", ints="key cell", rnd="density", places=9)
def _(t):
    return SP.map_cells(maps(t), "key")


STYLES, RANKS = 6, list(range(2, 11))
DUNK_FEET = 2.0


def style_fits(t):
    """Weights, components and errors of all ranks, fitted together."""
    made = {}

    def part(i):
        def build():
            if not made:
                made["fits"] = SP.fit_styles(maps(t), "key", RANKS)
            return made["fits"][i]

        return build

    return tuple(t.stage(f"style_{n}", part(i)) for i, n in enumerate(("weights", "components", "errors")))


def styles(t):
    w, h, _ = style_fits(t)
    return w.where(k("rank") == STYLES).drop("rank"), h.where(k("rank") == STYLES).drop("rank")


@query("map2_style_factors")
def _(t):
    """Shares of the styles per entity; each row sums to 1 (checked in tests with the error of the fit)."""
    w, _ = styles(t)
    return w.select("key", *[F.round(k("w")[i], 4).alias(f"style_{i}") for i in range(STYLES)])


@query("map3_choose_rank")
def _(t):
    return SP.elbow(style_fits(t)[2].withColumnRenamed("rank", "k"), "k", "error")


@query("map4_style_labels")
def _(t):
    d = SP.describe_styles(styles(t)[1])
    return d.select("style", "label", *[F.round(c, 4).alias(c) for c in ("avg_ft", "avg_angle", *X.ZONES)])


def other_shots(t):
    """Shots of a second population, on the same court: the suppliers of the line items."""
    dx = F.pmod(k("l_orderkey") * 5 + k("l_linenumber") * 17, F.lit(51)).cast("double") - 25
    dy = F.pmod(k("l_orderkey") * 13 + k("l_quantity").cast("bigint") * 7, F.lit(33)).cast("double") - 3
    return t.lineitem.select(k("l_suppkey").alias("key"), dx.alias("sx"), dy.alias("sy"))


@query("map5_project_styles")
def _(t):
    """Another population's maps in the styles fitted to the first (tests/test_operators.py)."""
    p = SP.project_styles(SP.density_maps(other_shots(t), "key", "sx", "sy"), styles(t)[1], "key")
    return p.select("key", *[F.round(k("w")[i], 4).alias(f"style_{i}") for i in range(STYLES)])


@query("map6_style_layout")
def _(t):
    """Style mix with readable axes, dominant style and a two-axis layout."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    w, h = styles(t)
    labels = SP.describe_styles(h).select("style", "label")
    top = (F.array_position("w", F.array_max("w")) - 1).cast("int")
    v = w.select("key", "w", top.alias("style"), array_to_vector("w").alias("x"))
    xy = PCA(k=2, inputCol="x", outputCol="p").fit(v).transform(v).withColumn("p", vector_to_array("p"))
    s = court_shots(t).where("xy_valid").withColumnRenamed("id", "key")
    axes = A.value_shares(s, ["key"], "zone", X.ZONES, "zone_").select(
        "key", k("zone_rim").alias("rim_share"), (k("zone_corner_three") + k("zone_above_break_three")).alias("three_share")
    )
    rim = k("zone") == "rim"
    # Among attempts at the rim, the closest stand for dunks.
    made = s.groupBy("key").agg(A.share(F.when(rim, k("made"))).alias("rim_made"), A.share(F.when(rim, k("dist") <= DUNK_FEET)).alias("dunk_share"))
    out = xy.join(labels, "style").join(axes, "key").join(made, "key")
    return out.select(
        "key", "label", *[F.round(c, 4).alias(n) for c, n in (
            (k("p")[0], "x"), (k("p")[1], "y"), (k("rim_share"), "rim_share"), (k("three_share"), "three_share"), (k("rim_made"), "rim_made"), (k("dunk_share"), "dunk_share"))]
    )


@query(
    "map7_shot_tables",
    f"""SELECT id, attempts, valid, coverage, rim, corner FROM (SELECT id, count(*) AS attempts, count(dx) AS valid, count(dx) / count(*) AS coverage,
      avg((zone = 'rim')::INT) FILTER (WHERE zone IS NOT NULL) AS rim, avg((zone = 'corner_three')::INT) FILTER (WHERE zone IS NOT NULL) AS corner
      FROM (SELECT *, {_ZONE} AS zone FROM {_XY}) GROUP BY 1) WHERE valid >= 10 AND coverage >= 0.4""",
    "shots", rnd="coverage rim corner",
)
def _(t):
    s = court_shots(t)
    cov = s.groupBy("id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("xy_valid").alias("valid"), A.share(k("xy_valid")).alias("coverage")
    ).where("valid >= 10 AND coverage >= 0.4")
    zones = A.value_shares(s, ["id"], "zone", X.ZONES)
    return cov.join(zones.select("id", "rim", k("corner_three").alias("corner")), "id")


@query("sta26_spatial_features")
def _(t):
    """Forest with zone shares and style weights, styles refitted on each fold's training cohorts; null without a map.

    The forests of all folds are one grove. Styles are fits of their own per fold (tests/test_operators.py).
    """
    train, test = fold_rows(t)
    s = court_shots(t).where("xy_valid").join(t.ent.select(k("entity").alias("id"), "cohort"), "id")
    # Shots up to the year after the cohort only; entities map to a style by their own points.
    s = s.where(k("season") <= k("cohort") + 1)
    known = t.stage("fold_maps", lambda: SP.density_maps(s.withColumnRenamed("id", "key"), "key", "sx", "sy"))
    zones = A.value_shares(s, ["id"], "zone", X.ZONES, "zone_")
    cols = [*FEATURES, *[f"zone_{z}" for z in X.ZONES], *[f"s{i}" for i in range(STYLES)]]

    def one(fold):
        ids = train.where(k("fold") == fold).select(k("id").alias("key"))
        _, h, _ = SP.fit_styles(known.join(ids, "key", "left_semi"), "key", [STYLES])
        return SP.project_styles(known, h, "key").select(k("key").alias("id"), *[k("w")[i].alias(f"s{i}") for i in range(STYLES)])

    styles_of = t.stage("fold_styles", lambda: each_fold(one))
    tr, te = (d.join(zones, "id", "left").join(styles_of, ["fold", "id"], "left") for d in (train, test))
    q = GT.forest_grids(tr, te, cols, "y", GT.Growth(share=1 / 3)).join(test.select("fold", "id", "y"), ["fold", "id"])
    return q.select("fold", "id", F.round(G.crps("y", "grid"), 6).alias("crps"))
