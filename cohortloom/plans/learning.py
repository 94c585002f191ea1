"""Learners through every fold, definition checks and permutation tests on the star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import court as X
from ..functions import grids as G
from ..functions.special import corr_p_value
from ..operators import aggregates as A
from ..operators import association as AS
from ..operators import folds as FO
from ..operators import forecast as FC
from ..operators import grouped_trees as GT
from ..operators import learners as L
from ..operators import neighbours as NB
from ..operators import permutation as PM
from ..operators import ranking as RK
from ..operators import resample as RS
from ..session import together
from .bindings import ALL_COHORTS, BUST_CUT, CTES, HORIZON, LAST, LEVELS_SQL, STAR_CUT
from .cleaning import court_shots
from .registry import query
from .statistics import FEATURES, P_SQL, REPS, bands, feats, fold_rows, with_pit

k = F.col

# --------------------------------------------------------------------------- learners in all folds

PICK, STATS, SHOT = ["f1"], ["f2", "f3", "f4"], [f"zone_{z}" for z in X.ZONES]
#: Feature lists that share one grove per fold.
VARIANTS = {
    "shot": SHOT, "stats": STATS, "stats+shot": STATS + SHOT, "pick+stats": PICK + STATS, "pick+shot": PICK + SHOT,
    "pick+stats+shot": PICK + STATS + SHOT,
}
FOREST = GT.Growth(trees=20, depth=4, min_leaf=20, share=1 / 3)
BOOSTED = GT.Growth(trees=20, depth=3, min_leaf=20, rate=0.1)


def early_zones(t):
    """Zone shares of shots up to the year after the cohort; entities without one have no row."""
    s = court_shots(t).where("xy_valid").join(t.ent.select(k("entity").alias("id"), "cohort"), "id")
    return A.value_shares(s.where(k("season") <= k("cohort") + 1), ["id"], "zone", X.ZONES, "zone_")


def learner_rows(t):
    """(train, test) of the folds with zone shares, null without a map."""
    def build(i):
        return lambda: fold_rows(t)[i].join(early_zones(t), "id", "left")

    t.tgt  # both read it: staged before they part
    names = ("learner_train", "learner_test")
    return tuple(together(t.spark, [partial(t.stage, name, build(i)) for i, name in enumerate(names)]))


def learners():
    slot, near = L.SlotLearner(), L.NeighbourLearner(FEATURES)
    forest = L.ForestLearner(FEATURES, FOREST)
    blend = L.BlendLearner([slot, near, forest], [1, 1, 1], "blend")
    return [
        slot, L.ConformalLearner(slot), near, L.NeighbourLearner(FEATURES, weighted=True, name="weighted neighbours"),
        L.TreeProximityLearner(FEATURES, BOOSTED), forest, blend, L.ConformalLearner(blend),
    ]


def predictions(t):
    """Every learner, the shot neighbours and the forests of all variants, in every fold."""
    def build():
        train, test = learner_rows(t)
        shot = L.NeighbourLearner(SHOT, space=NB.Space(same=["position"]), guards=("position",), name="shot neighbours")
        out, grids = together(t.spark, [
            lambda: L.backtest([*learners(), shot], train, test),
            lambda: GT.forest_grids(L.known(train), test, [*PICK, *STATS, *SHOT], "y", FOREST, variants=VARIANTS)])
        forests = grids.join(test.select("fold", "id", "y"), ["fold", "id"])
        return out.unionByName(forests.select(
            F.concat(F.lit("forest "), "variant").alias("model"), "fold", "id", "y", G.monotone("grid").alias("grid")))

    return t.stage("learner_predictions", build)


def learner_scores(t):
    return t.stage("learner_scores", lambda: FC.entity_scores(predictions(t), "y", STAR_CUT, BUST_CUT))


@query("sta25_learner_backtest")
def _(t):
    """Eight learners, shot neighbours and six forests by fold. Learners are tested one by one in tests/test_learners.py."""
    s = learner_scores(t)
    cols = ("crps", "pinball_floor", "pinball_median", "pinball_ceiling", "brier_star", "brier_bust", "below_floor", "above_ceiling", "y")
    return s.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in cols])


BASES = ["slot", "stats neighbours"]


def against_bases(scores):
    """(model, base, n, crps, diff, lo, hi): all models against both baselines, on the same resamples."""
    pairs = RS.paired_scores(scores.select("model", "id", "crps"), "id", "crps", BASES)
    out = RS.bootstrap_mean(pairs, "id", ["crps", "diff"], ["model", "base"], REPS)
    return out.select("model", "base", "n", "crps", "diff", k("diff_lo").alias("lo"), k("diff_hi").alias("hi"))


@query("sta15_learner_summary")
def _(t):
    """Every model against two baselines; the three that SQL can express are checked in sta15_two_baselines."""
    out = against_bases(learner_scores(t))
    return out.select("model", "base", "n", *[F.round(c, 6).alias(c) for c in ("crps", "diff", "lo", "hi")])


PAIRS = {
    "H1: pick+stats+shot vs pick+stats": ("forest pick+stats+shot", "forest pick+stats"),
    "H2a: shot vs stats (no pick)": ("forest shot", "forest stats"),
    "H2b: stats+shot vs stats (no pick)": ("forest stats+shot", "forest stats"),
    "H2c: neighbours by shot vs by stats": ("shot neighbours", "stats neighbours"),
    "H3: pick+stats+shot vs pick only": ("forest pick+stats+shot", "slot + conformal"),
    "H3: pick+shot vs pick only": ("forest pick+shot", "slot + conformal"),
}


@query("sta16_preregistered_pairs")
def _(t):
    """Six pairs in one bootstrap job (tests/test_learners.py)."""
    out = L.compare(learner_scores(t), PAIRS, REPS)
    return out.select("comparison", "n", *[F.round(c, 6).alias(c) for c in ("diff", "lo", "hi")], "verdict")


CTES["kn"] = (
    f"""SELECT fold, id, quantile_cont(y, {LEVELS_SQL}) AS grid FROM (
      SELECT *, row_number() OVER (PARTITION BY fold, id ORDER BY round(d, 9), neighbour) AS rank FROM pairs) WHERE rank <= 30 GROUP BY 1, 2""",
    ["pairs"],
)
CTES["three"] = (
    f"""SELECT *, 2 * list_avg(list_transform(range(1, 20), lambda i: greatest({LEVELS_SQL}[i] * (y - grid[i]), ({LEVELS_SQL}[i] - 1) * (y - grid[i])))) AS crps FROM (
      SELECT 'slot' AS model, cohort AS fold, entity AS id, y, grid FROM sp UNION ALL SELECT 'slot + conformal', cohort, entity, y, grid FROM cp
      UNION ALL SELECT 'stats neighbours', kn.fold, kn.id, tgt.y, list_sort(kn.grid) FROM kn JOIN tgt ON tgt.entity = kn.id)""",
    ["sp", "cp", "kn", "tgt"],
)
THREE = ("slot", "slot + conformal", "stats neighbours")


@query(
    "sta25_three_models", "SELECT model, fold, count(*) AS n, avg(crps) AS crps, avg(y) AS y FROM three GROUP BY 1, 2",
    "three", ints="fold", rnd="crps y", places=7,
)
def _(t):
    s = learner_scores(t).where(k("model").isin(*THREE))
    return s.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("crps").alias("crps"), F.avg("y").alias("y"))


@query(
    "sta15_two_baselines",
    f"""SELECT model, base, n, crps, diff, lo, hi FROM (
      SELECT a.model, b.model AS base, count(*) AS n, avg(a.crps) AS crps, avg(a.crps - b.crps) AS diff FROM three a JOIN three b ON a.id = b.id AND b.model <> 'slot + conformal' GROUP BY 1, 2)
    JOIN (SELECT model, base, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (
      SELECT a.model, b.model AS base, w.rep, sum(w.w * (a.crps - b.crps)) / sum(w.w) AS m FROM three a JOIN three b ON a.id = b.id AND b.model <> 'slot + conformal'
      JOIN (SELECT id, rep, {RS.weight_sql('id', 'rep')} AS w FROM (SELECT DISTINCT id FROM three), range(1, {REPS + 1}) r(rep)) w ON w.id = a.id
      GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (model, base)""",
    "three", rnd="crps diff lo hi", places=7,
)
def _(t):
    return against_bases(learner_scores(t).where(k("model").isin(*THREE)))


@dataclass(frozen=True)
class ClimateLearner:
    """A learner as a caller would add one: every test row gets the quantiles of its fold's training outcomes."""

    name: str = "climate"

    def predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        grids = RK.quantile_grid(L.known(train), "y", G.LEVELS, ["fold"])
        return test.select("fold", "id").join(grids, "fold")


@query(
    "udf6_learner_protocol",
    f"""SELECT x.entity AS id, x.cohort AS fold, g[5] AS floor, g[10] AS median, g[18] AS ceiling FROM tgt x JOIN (
      SELECT fold, quantile_cont(y, {LEVELS_SQL}) AS g FROM trn GROUP BY 1) q ON q.fold = x.cohort WHERE x.y IS NOT NULL""",
    "trn tgt", ints="fold", rnd="floor median ceiling",
)
def _(t):
    train, test = fold_rows(t)
    p = L.backtest([ClimateLearner()], train, test)
    return p.select("id", "fold", G.at_level("grid", G.FLOOR).alias("floor"), G.at_level("grid", G.MEDIAN).alias("median"), G.at_level("grid", G.CEILING).alias("ceiling"))


@query("sta24_forest_quantiles")
def _(t):
    """Quantile forests of all folds grown together (tests/test_learners.py)."""
    train, test = fold_rows(t)
    q = GT.forest_grids(train, test, FEATURES, "y", FOREST).join(test.select("fold", "id", "y"), ["fold", "id"])
    return q.select("fold", "id", F.round(G.crps("y", "grid"), 6).alias("crps"), *[c.alias(n) for n, c in G.to_columns("grid").items()])


# ------------------------------------------------------------------- one feature against a residual


@query("sta27_confirmation_test")
def _(t):
    """Does f2 explain the residual of a forest without it, and does adding it lower the CRPS?

    Both forests are variants of one grove; the interval of the rank correlation comes from
    replicate vectors (tests/test_learners.py).
    """
    def build():
        train, test = fold_rows(t)
        test = test.where(k("f2").isNotNull())
        g = GT.forest_grids(train, test, ["f1", "f2", "f4"], "y", FOREST, variants={"base": ["f1", "f4"], "plus": ["f1", "f2", "f4"]})
        wide = g.groupBy("fold", "id").agg(*[F.max(F.when(k("variant") == v, k("grid"))).alias(v) for v in ("base", "plus")])
        return wide.join(test.select("fold", "id", "y", "f2"), ["fold", "id"])

    d = t.stage("confirmation_rows", build)
    d = d.withColumns({"resid": k("y") - G.at_level("base", G.MEDIAN), "diff": G.crps("y", "plus") - G.crps("y", "base")})
    d = t.stage("confirmation_tests", lambda: d.withColumn("one", F.lit(1)).select("one", "id", "f2", "resid", "diff"))
    rho = AS.spearman(d, "f2", "resid", ["one"])
    reps = AS.spearman_replicates(d, "f2", "resid", "id", ["one"], REPS)
    ci = RS.interval(reps, ["one"], "rho", "rho_lo", "rho_hi")
    gain = RS.bootstrap_mean(d, "id", ["diff"], ["one"], REPS).drop("n")
    out = rho.join(ci, "one").join(gain, "one").withColumn("confirmed", (k("rho_lo") > 0) & (k("diff_hi") < 0))
    cols = ("rho", "rho_lo", "rho_hi", "diff", "diff_lo", "diff_hi")
    return out.select("n", *[F.round(c, 6).alias(c) for c in cols], "confirmed")


@query(
    "sta27_readiness",
    f"""SELECT cohort, count(f2) AS entities, cohort + {HORIZON} <= {LAST} AS ready, concat(cohort + {HORIZON} - 1, '-', lpad(CAST((cohort + {HORIZON}) % 100 AS VARCHAR), 2, '0')) AS testable_after
    FROM feat GROUP BY 1""",
    "feat", ints="cohort",
)
def _(t):
    """Per cohort how many entities have the feature, and whether their outcome is known yet."""
    at = k("cohort") + HORIZON
    after = F.concat((at - 1).cast("string"), F.lit("-"), F.lpad((at % 100).cast("string"), 2, "0"))
    return feats(t).groupBy("cohort").agg(F.count("f2").alias("entities")).select("cohort", "entities", (at <= LAST).alias("ready"), after.alias("testable_after"))


# -------------------------------------------------------------------------- checks of a definition

CHECKS = {  # name: (target, which candidates, kind)
    "auc: ever league": ("leagues", "career", "auc"),
    "auc: ever star": ("stars", "career", "auc"),
    "rank: star seasons": ("stars", "career", "rho"),
    "rank: peak pay share": ("peak_pay", "career", "rho"),
    "rank: second pay share vs early value": ("second_pay", "early", "rho"),
}
CANDIDATES = ["peak", "total", "blend"]
CAREER_N, EARLY_N = 4, 2


def definition_rows(t):
    """Entities seen through n = 4: candidates at 4 and at 2, honours, and pay as a share of the period's total."""
    def build():
        blend = F.round(0.75 * k("peak") + 0.25 * k("total"), 6)
        o = t.otn.withColumn("blend", blend)
        at = o.where(k("n") == CAREER_N).select("entity", "leagues", "stars", *[k(c).alias(f"career_{c}") for c in CANDIDATES])
        early = o.where(k("n") == EARLY_N).select("entity", *[k(c).alias(f"early_{c}") for c in CANDIDATES])
        cap = t.seasons.groupBy("period").agg(F.round(F.sum("a"), 6).alias("cap"))
        pay = t.seasons.join(cap, "period").withColumns({"n": k("period") - k("cohort"), "share": F.round(k("a") / k("cap"), 12)})
        pays = pay.where(k("n").between(EARLY_N + 1, CAREER_N)).groupBy("entity").agg(
            F.max("share").alias("peak_pay"), F.round(F.sum("share") / 2, 12).alias("second_pay"))
        return at.join(early, "entity").join(pays, "entity", "left").fillna(0.0, ["peak_pay", "second_pay"])

    return t.stage("definition_rows", build)


def checked(t):
    """(check, kind, candidate, entity, v, target) of all checks in one frame."""
    d = definition_rows(t)
    cells = [F.struct(F.lit(name).alias("check"), F.lit(kind).alias("kind"), F.lit(c).alias("candidate"),
                      k(f"{prefix}_{c}").cast("double").alias("v"), k(target).cast("double").alias("target"))
             for name, (target, prefix, kind) in CHECKS.items() for c in CANDIDATES]
    return d.select("entity", F.explode(F.array(*cells)).alias("c")).select("entity", "c.*")


def estimates(rows, by):
    hits = rows.where("kind = 'auc'").withColumn("hit", k("target") > 0)
    auc = AS.auc(hits, "v", "hit", by).select(*by, k("auc").alias("estimate"))
    return auc.unionByName(AS.spearman(rows.where("kind = 'rho'"), "v", "target", by).select(*by, k("rho").alias("estimate")))


_BLEND = "round(0.75 * {0}.peak + 0.25 * {0}.total, 6)"
CTES["defs"] = (
    f"""SELECT a.entity, a.leagues, a.stars, a.peak AS career_peak, a.total AS career_total, {_BLEND.format('a')} AS career_blend, e.peak AS early_peak,
      e.total AS early_total, {_BLEND.format('e')} AS early_blend, coalesce(p.peak_pay, 0.0) AS peak_pay, coalesce(p.second_pay, 0.0) AS second_pay
    FROM otn a JOIN otn e ON e.entity = a.entity AND a.n = {CAREER_N} AND e.n = {EARLY_N} LEFT JOIN (
      SELECT entity, max(share) AS peak_pay, round(sum(share) / 2, 12) AS second_pay FROM (SELECT entity, period - cohort AS n, round(a / cap, 12) AS share
        FROM seasons JOIN (SELECT period, round(sum(a), 6) AS cap FROM seasons GROUP BY 1) USING (period)) WHERE n BETWEEN {EARLY_N + 1} AND {CAREER_N} GROUP BY 1) p ON p.entity = a.entity""",
    ["otn", "seasons"],
)
_CELLS = " UNION ALL ".join(
    f"SELECT entity, '{name}' AS \"check\", '{kind}' AS kind, '{c}' AS candidate, CAST({prefix}_{c} AS DOUBLE) AS v, CAST({target} AS DOUBLE) AS target FROM defs"
    for name, (target, prefix, kind) in CHECKS.items() for c in CANDIDATES)
CTES["defcells"] = (_CELLS, ["defs"])


def estimate_sql(rows: str, by: str) -> str:
    """SQL: AUC or rank correlation of v and target by the groups."""
    rank = "rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2"
    return f"""SELECT {by}, CASE WHEN any_value(kind) = 'rho' THEN corr(rx, ry) ELSE (sum(CASE WHEN target > 0 THEN rx END) - sum((target > 0)::INT) * (sum((target > 0)::INT) + 1) / 2)
      / nullif(sum((target > 0)::INT) * sum((target <= 0)::INT), 0) END AS estimate
    FROM (SELECT *, {rank.format(by=by, c='v')} AS rx, {rank.format(by=by, c='target')} AS ry FROM {rows}) GROUP BY {by}"""


@query("sta30_validation_checks", estimate_sql("defcells", '"check", candidate'), "defcells", rnd="estimate", places=7)
def _(t):
    """Five checks of three candidate definitions."""
    return estimates(checked(t), ["check", "candidate"])


VALIDATION_REPS = 1000


def _validation_replicates(t):
    rows, by = checked(t), ["check", "candidate"]
    hits = rows.where("kind = 'auc'").withColumn("hit", k("target") > 0)
    auc = AS.auc_replicates(hits, "v", "hit", "entity", by, VALIDATION_REPS).select(*by, "rep", k("auc").alias("e"))
    rho = AS.spearman_replicates(rows.where("kind = 'rho'"), "v", "target", "entity", by, VALIDATION_REPS)
    return auc.unionByName(rho.select(*by, "rep", k("rho").alias("e")))


_REPLICATED = f"""(SELECT "check", candidate, rep, CASE WHEN any_value(kind) = 'rho' THEN (sum(w) * sum(w * rx * ry) - sum(w * rx) * sum(w * ry)) / nullif(
      sqrt(sum(w) * sum(w * rx * rx) - sum(w * rx) ** 2) * sqrt(sum(w) * sum(w * ry * ry) - sum(w * ry) ** 2), 0)
    ELSE (sum(w * rx) FILTER (WHERE target > 0) - sum(w) FILTER (WHERE target > 0) * (sum(w) FILTER (WHERE target > 0) + 1) / 2)
      / nullif(sum(w) FILTER (WHERE target > 0) * sum(w) FILTER (WHERE target <= 0), 0) END AS e FROM (
    SELECT *, coalesce(sum(w) OVER (PARTITION BY "check", candidate, rep ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
        - (sum(w) OVER (PARTITION BY "check", candidate, rep, v) - 1) / 2 AS rx,
      sum(w) OVER (PARTITION BY "check", candidate, rep ORDER BY target RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        - (sum(w) OVER (PARTITION BY "check", candidate, rep, target) - 1) / 2 AS ry
    FROM (SELECT *, CAST({RS.weight_sql('entity', 'rep')} AS DOUBLE) AS w FROM defcells, range(1, {VALIDATION_REPS + 1}) r(rep))) GROUP BY 1, 2, 3)"""


@query(
    "sta30_check_intervals",
    f"""SELECT "check", candidate, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi, avg(e - b) AS diff, quantile_cont(e - b, 0.025) AS diff_lo, quantile_cont(e - b, 0.975) AS diff_hi
    FROM (SELECT *, max(CASE WHEN candidate = 'peak' THEN e END) OVER (PARTITION BY "check", rep) AS b FROM {_REPLICATED}) GROUP BY 1, 2""",
    "defcells", rnd="lo hi diff diff_lo diff_hi", places=7,
)
def _(t):
    """Bootstrap intervals of every check and candidate, and of the difference from `peak` on the same resamples."""
    a = t.stage("validation_replicates", lambda: _validation_replicates(t))
    base = a.where("candidate = 'peak'").select("check", "rep", k("e").alias("b"))
    a = a.join(base, ["check", "rep"]).withColumn("d", k("e") - k("b"))
    ends = F.array(F.lit(0.025), F.lit(0.975))
    g = a.groupBy("check", "candidate").agg(F.percentile("e", ends).alias("q"), F.avg("d").alias("diff"), F.percentile("d", ends).alias("r"))
    return g.select("check", "candidate", k("q")[0].alias("lo"), k("q")[1].alias("hi"), "diff", k("r")[0].alias("diff_lo"), k("r")[1].alias("diff_hi"))


_WEIGHTED = " UNION ALL ".join(
    f"""SELECT entity, '{name}' AS "check", '{kind}' AS kind, '{label}' AS definition, CAST({col} AS DOUBLE) AS v, CAST({target} AS DOUBLE) AS target FROM defs"""
    for name, (target, prefix, kind) in CHECKS.items() if prefix == "career"
    for label, col in (("peak only", "career_peak"), ("total only", "career_total"), ("composite", "career_blend")))


@query("sta30_weight_check", estimate_sql(f"({_WEIGHTED})", '"check", definition'), "defs", rnd="estimate", places=7)
def _(t):
    """Does the composite beat its parts? Career checks of peak, total and both."""
    label = F.element_at(F.create_map(*[F.lit(v) for p in (("peak", "peak only"), ("total", "total only"), ("blend", "composite")) for v in p]), k("candidate"))
    rows = checked(t).where(~k("check").isin(*[n for n, c in CHECKS.items() if c[1] != "career"]))
    return estimates(rows.withColumn("definition", label), ["check", "definition"])


# ----------------------------------------------------------------------- predicting the surprise


def surprise_rows(t, judged):
    d = judged.select(k("entity").alias("id"), "cohort", "pit")
    return d.join(feats(t).select(k("entity").alias("id"), *FEATURES), "id")


GROUPS = 5


def _cohort_groups(t):
    """Out-of-fold predictions: cohorts dealt to groups, each group predicted from the other four."""
    d = surprise_rows(t, with_pit(t)).withColumn("g", F.pmod("cohort", F.lit(GROUPS)))
    others = F.filter(F.array(*[F.lit(i) for i in range(GROUPS)]), lambda i: i != k("g"))
    grove, _ = GT.grow(d.withColumn("fold", F.explode(others)), FEATURES, "pit", BOOSTED)
    test = d.withColumn("fold", k("g"))
    return GT.predictions(test, grove, ["id"]).join(d.select("id", "cohort", "pit"), "id").select("id", "cohort", "pit", "prediction")


@query("sta38_overperformance")
def _(t):
    """Out-of-fold rank correlation and R2 by cohort groups, with a permutation p value (tests/test_learners.py)."""
    oof = t.stage("surprise_oof", lambda: _cohort_groups(t))
    test = PM.permutation_test(oof, "prediction", "pit", "id", 500)
    r2 = oof.agg((1 - F.sum(F.pow(k("pit") - k("prediction"), F.lit(2))) / (F.var_pop("pit") * F.count(F.lit(1)))).alias("r2"))
    return RK.attach(test, r2, [], ["r2"]).select(F.round("rho", 4).alias("rho"), F.round("r2", 4).alias("r2"), "p", "n")


@query("sta38_importances")
def _(t):
    """Share of the splits' gain by feature of a model of all rows, and the sign of the feature's rank correlation."""
    d = surprise_rows(t, with_pit(t)).withColumn("fold", F.lit(0))
    grove, _ = GT.grow(d, FEATURES, "pit", BOOSTED)
    shares = grove.importances()["all", 0]
    p = GT.predictions(d, grove, ["id"]).join(d.select("id", *FEATURES), "id")
    long = p.unpivot(["id", "prediction"], FEATURES, "feature", "v")
    rho = AS.spearman(long, "v", "prediction", ["feature"]).select("feature", F.round("rho", 4).alias("direction"))
    rows = t.spark.createDataFrame([(f, round(v, 6)) for f, v in shares.items()], "feature string, importance double")
    return rows.join(rho, "feature", "left")


def _rolling(t):
    """Predictions of each cohort's PIT at horizon 1 from cohorts whose outcome was known by then."""
    d = surprise_rows(t, bands(t, 1))
    train = FO.assign_folds(d, "cohort", 1, ALL_COHORTS[0], ALL_COHORTS[-1])
    grove, _ = GT.grow(train, FEATURES, "pit", BOOSTED)
    test = d.withColumn("fold", k("cohort"))
    return GT.predictions(test, grove, ["id"]).join(d.select("id", "pit"), "id").select("id", "fold", "pit", "prediction")


def surprise_rolling(t):
    return t.stage("surprise_rolling", lambda: _rolling(t))


@query("sta38_rolling_by_cohort")
def _(t):
    """The strict version by cohort: rank correlation of predictions made from known outcomes only."""
    out = AS.spearman(surprise_rolling(t), "prediction", "pit", ["fold"])
    return out.select(k("fold").alias("cohort"), "n", F.round("rho", 4).alias("rho"))


@query("sta38_rolling_pooled")
def _(t):
    out = PM.permutation_test(surprise_rolling(t), "prediction", "pit", "id", 1000)
    return out.select(F.round("rho", 4).alias("rho"), "n", "p")


# ------------------------------------------------------------------------ recruits at two horizons

CTES["rh"] = (
    " UNION ALL ".join(
        f"""SELECT {h} AS horizon, scope, entity, slot, round(pit, 9) AS pit, CASE WHEN 2 * slot - 1 <= 10 THEN 'RSCI 1-10' WHEN 2 * slot - 1 <= 25 THEN 'RSCI 11-25'
          WHEN 2 * slot - 1 <= 50 THEN 'RSCI 26-50' ELSE 'Unranked' END AS grp FROM b{h}, (VALUES ('all'), ('first round')) s(scope) WHERE scope = 'all' OR slot <= 30"""
        for h in (1, 2)),
    ["b1", "b2"],
)


def recruit_rows(t):
    """Both horizons and both scopes as key columns of one frame."""
    cols = ["horizon", "entity", "slot", "pit"]
    both = bands(t, 1).select(*cols).unionByName(bands(t, 2).select(*cols))
    rank = 2 * k("slot") - 1
    d = both.withColumns({"pit": F.round("pit", 9), "grp": B.recruit_group(F.when(rank <= 50, rank)),
                          "order": B.digitize(rank, B.RECRUIT_EDGES[1:4], True)})
    d = d.withColumn("scope", F.explode(F.array(F.lit("all"), F.when(k("slot") <= 30, "first round"))))
    return d.where(k("scope").isNotNull())


@query(
    "sta43_recruit_horizons",
    f"""SELECT horizon, scope, grp, n, mean_pit, lo, hi, beat, avg_slot, round(lo, 9) > 0.5 OR round(hi, 9) < 0.5 AS differs FROM (
      SELECT horizon, scope, grp, count(*) AS n, avg(pit) AS mean_pit, avg((pit > 0.5)::INT) AS beat, avg(slot) AS avg_slot FROM rh GROUP BY 1, 2, 3)
    JOIN (SELECT horizon, scope, grp, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT horizon, scope, grp, rep, sum(w * pit) / nullif(sum(w), 0) AS m
      FROM (SELECT *, {RS.weight_sql('entity', 'rep')} AS w FROM rh, range(1, {REPS + 1}) x(rep)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) USING (horizon, scope, grp)""",
    "rh", ints="horizon", rnd="mean_pit lo hi beat avg_slot", places=7,
)
def _(t):
    d = recruit_rows(t).withColumns({"beat": (k("pit") > 0.5).cast("double"), "at": k("slot").cast("double")})
    out = RS.bootstrap_mean(d, "entity", ["pit", "beat", "at"], ["horizon", "scope", "grp"], REPS)
    lo, hi = k("pit_lo"), k("pit_hi")
    return out.select("horizon", "scope", "grp", "n", k("pit").alias("mean_pit"), lo.alias("lo"), hi.alias("hi"), "beat", k("at").alias("avg_slot"),
                      ((F.round(lo, 9) > 0.5) | (F.round(hi, 9) < 0.5)).alias("differs"))


@query(
    "sta43_recruit_tests",
    f"""SELECT horizon, scope, rho, {P_SQL} AS p_value, n FROM (SELECT *, n - 2 AS m, asin(least(abs(rho), 1)) AS th FROM (
      SELECT horizon, scope, corr(rx, ry) AS rho, count(*) AS n FROM (
        SELECT horizon, scope, rank() OVER (PARTITION BY horizon, scope ORDER BY grp) + (count(*) OVER (PARTITION BY horizon, scope, grp) - 1) / 2 AS rx,
          rank() OVER (PARTITION BY horizon, scope ORDER BY pit) + (count(*) OVER (PARTITION BY horizon, scope, pit) - 1) / 2 AS ry
        FROM (SELECT * REPLACE (CASE grp WHEN 'RSCI 1-10' THEN 0 WHEN 'RSCI 11-25' THEN 1 WHEN 'RSCI 26-50' THEN 2 ELSE 3 END AS grp) FROM rh)) GROUP BY 1, 2))""",
    "rh", ints="horizon", rnd="rho:7 p_value:5",
)
def _(t):
    """Rank trend of the PIT by recruit group at both horizons and scopes, with its p value."""
    r = AS.spearman(recruit_rows(t), "order", "pit", ["horizon", "scope"])
    return r.select("horizon", "scope", "rho", corr_p_value("rho", k("n").cast("double")).alias("p_value"), "n")
