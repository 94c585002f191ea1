"""Quantile forecasts, scores, survival, pooling, weighting and class strength."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import grids as G
from ..functions import rates as R
from ..functions.common import ladder
from ..functions.special import corr_p_value
from ..operators import aggregates as A
from ..operators import association as AS
from ..operators import causal as CA
from ..operators import folds as FO
from ..operators import forecast as FC
from ..operators import groups as GR
from ..operators import monotone as MO
from ..operators import panel as P
from ..operators import ranking as RK
from ..operators import resample as RS
from ..operators import shrink as SH
from ..operators import survival as SV
from ..operators import trees as TR
from .bindings import (
    ALL_COHORTS, BUST_CUT, CUTS, FOLDS, HORIZON, LAST, LEVELS_SQL, STAR_CUT, TRAIN_LAST, CTES, slot_model_ctes,
)
from .registry import query
from .relational import slot_curve

k = F.col
REPS = 2000
TAUS_SQL = "[0.0, " + LEVELS_SQL[1:-1] + ", 1.0]"


def cdf_sql(src: str, t: str, out: str, grid: str = "grid") -> str:
    """SQL text: `src` with the grid's CDF at `t` as `out`."""
    x = f"list_concat([{grid}[1] - ({grid}[2] - {grid}[1]) - 1e-9], {grid}, [{grid}[19] + ({grid}[19] - {grid}[18]) + 1e-9])"
    return f"""(SELECT * EXCLUDE (xx, ii, tt), least(greatest(CASE WHEN ii = 0 THEN 0.0 WHEN ii >= 21 THEN 1.0
      WHEN xx[ii + 1] > xx[ii] THEN {TAUS_SQL}[ii] + ({TAUS_SQL}[ii + 1] - {TAUS_SQL}[ii]) * (tt - xx[ii]) / (xx[ii + 1] - xx[ii])
      ELSE {TAUS_SQL}[ii + 1] END, 0.0), 1.0) AS {out}
      FROM (SELECT *, len(list_filter(xx, lambda v: v <= tt)) AS ii FROM (SELECT *, {x} AS xx, {t} AS tt FROM {src})))"""


def pit_sql(src: str, y: str = "y") -> str:
    return f"(SELECT * EXCLUDE (hi_, lo_), (hi_ + lo_) / 2 AS pit FROM {cdf_sql(cdf_sql(src, y, 'hi_'), f'{y} - 1e-9', 'lo_')})"


CTES["cpit"] = ("SELECT * FROM " + pit_sql("cp"), ["cp"])
CTES["scored"] = (
    f"""SELECT *, greatest(0.25 * (y - grid[5]), -0.75 * (y - grid[5])) AS pinball_floor,
      greatest(0.5 * (y - grid[10]), -0.5 * (y - grid[10])) AS pinball_median,
      greatest(0.9 * (y - grid[18]), -0.1 * (y - grid[18])) AS pinball_ceiling,
      ((1 - c_star) - (y >= {STAR_CUT})::INT) ** 2 AS brier_star, (c_bust - (y < {BUST_CUT})::INT) ** 2 AS brier_bust,
      (y < grid[5])::INT + 0.5 * (y = grid[5])::INT AS below_floor, (y > grid[18])::INT + 0.5 * (y = grid[18])::INT AS above_ceiling,
      2 * list_avg(list_transform(range(1, 20), lambda i: greatest({LEVELS_SQL}[i] * (y - grid[i]), ({LEVELS_SQL}[i] - 1) * (y - grid[i])))) AS crps
    FROM """
    + cdf_sql(cdf_sql("(SELECT 'slot' AS model, * FROM sp UNION ALL SELECT 'slot + conformal', * FROM cp)", str(STAR_CUT), "c_star"), str(BUST_CUT), "c_bust"),
    ["sp", "cp"],
)


def scored(t):
    return t.stage("scores", lambda: _scored(t))


def _scored(t):
    both = t.slot_predictions().select(F.lit("slot").alias("model"), "entity", "cohort", "slot", "position", "franchise", "y", "grid")
    conf = t.slot_predictions(True).select(F.lit("slot + conformal").alias("model"), *both.columns[1:])
    return FC.entity_scores(both.unionByName(conf), "y", STAR_CUT, BUST_CUT)


def with_pit(t):
    return t.stage("pits", lambda: _with_pit(t))


def _with_pit(t):
    p = t.slot_predictions(True)
    return p.withColumn("pit", G.pit("grid", "y")).withColumn(
        "verdict", G.verdict("y", G.at_level("grid", G.FLOOR), G.at_level("grid", G.CEILING))
    )


VERDICT_SQL = "CASE WHEN y > grid[18] THEN 'beat ceiling' WHEN y < grid[5] THEN 'below floor' ELSE 'within band' END"

# ------------------------------------------------------------------ empirical Bayes, factor

RATE_SQL = """(SELECT l_suppkey AS id, year(l_shipdate) AS season, l_returnflag AS zone,
  count(*) FILTER (WHERE l_linestatus = 'F') AS made, count(*) AS att FROM lineitem GROUP BY 1, 2, 3)"""
PRIOR_SQL = f"""SELECT season, zone, m AS mean, greatest(m * (1 - m) / greatest(obs - m * (1 - m) * n / a, 1e-6) - 1, 1) AS kappa, n
  FROM (SELECT season, zone, any_value(m) AS m, sum(att * (made / att - m) ** 2) / sum(att) AS obs, count(*) AS n, sum(att) AS a FROM (
    SELECT *, sum(made) OVER (PARTITION BY season, zone) / sum(att) OVER (PARTITION BY season, zone) AS m
    FROM {RATE_SQL} WHERE att >= 5) GROUP BY 1, 2)"""


def rates(t):
    return t.lineitem.groupBy(
        k("l_suppkey").alias("id"), F.year("l_shipdate").alias("season"), k("l_returnflag").alias("zone")
    ).agg(F.count_if(k("l_linestatus") == "F").alias("made"), F.count(F.lit(1)).alias("att"))


@query("sta1_beta_prior", PRIOR_SQL, ints="season n", rnd="mean kappa", places=6)
def _(t):
    return SH.beta_priors(rates(t), ["season", "zone"], "made", "att", 5)


@query(
    "sta2_season_priors",
    f"""SELECT season, max(CASE WHEN zone = 'A' THEN mean END) AS a_mean, max(CASE WHEN zone = 'A' THEN kappa END) AS a_kappa,
      max(CASE WHEN zone = 'R' THEN mean END) AS r_mean, any_value(mix) AS r_mix FROM ({PRIOR_SQL}) JOIN
      (SELECT season, sum(CASE WHEN zone = 'R' THEN att ELSE 0 END) / sum(att) AS mix FROM {RATE_SQL} GROUP BY 1) USING (season) GROUP BY 1""",
    ints="season", rnd="a_mean a_kappa r_mean r_mix", places=6,
)
def _(t):
    r = rates(t)
    p = SH.beta_priors(r, ["season", "zone"], "made", "att", 5)
    wide = p.groupBy("season").agg(
        F.max(F.when(k("zone") == "A", k("mean"))).alias("a_mean"), F.max(F.when(k("zone") == "A", k("kappa"))).alias("a_kappa"),
        F.max(F.when(k("zone") == "R", k("mean"))).alias("r_mean"),
    )
    mix = r.groupBy("season").agg((F.sum(F.when(k("zone") == "R", k("att")).otherwise(0)) / F.sum("att")).alias("r_mix"))
    return wide.join(mix, "season")


@query(
    "sta3_shrunk_rates",
    f"""SELECT id, season, zone, (made + mean * kappa) / (att + kappa) AS eb, (made + mean * kappa) / (att + kappa) - mean AS eb_rel
    FROM {RATE_SQL} JOIN ({PRIOR_SQL}) USING (season, zone)""",
    ints="season", rnd="eb eb_rel", places=6,
)
def _(t):
    r = rates(t)
    d = r.join(SH.beta_priors(r, ["season", "zone"], "made", "att", 5), ["season", "zone"])
    eb = SH.shrunk_rate(k("made"), k("att"), k("mean"), k("kappa"))
    return d.select("id", "season", "zone", eb.alias("eb"), (eb - k("mean")).alias("eb_rel"))


@query(
    "sta4_minutes_shrink",
    "SELECT entity, n, (value * minutes - 2 * 500) / (minutes + 500) AS shrunk FROM panel",
    "panel", ints="n", rnd="shrunk",
)
def _(t):
    return t.panel.select("entity", "n", R.shrink_to("value", "minutes", -2.0, 500).alias("shrunk"))


@query("sta5_season_blend", "SELECT entity, period, value, value_extra FROM vals", "vals", ints="period", rnd="value value_extra")
def _(t):
    return t.vals.select("entity", "period", "value", "value_extra")


@query("sta6_one_factor")
def _(t):
    s = t.vals.withColumn("start_share", F.try_divide("starts", "games"))
    zero = {"a": 0.0, "b": 0.0, "minutes": 0.0, "start_share": 0.0, "po_a": 0.0}
    out = SH.one_factor(s, list(zero), k("cohort") <= TRAIN_LAST, zero)
    return out.select("entity", "period", F.round("factor", 6).alias("factor"))


# ---------------------------------------------------------------------- tiers and outcomes

CTES["anchored"] = (
    f"""SELECT entity, peak, CASE WHEN leagues > 0 THEN 5 WHEN stars > 0 THEN 4 WHEN best_starts >= 3 AND best_minutes >= 1800 THEN 3
      WHEN best_minutes >= 1000 THEN 2 WHEN sum_minutes >= 1000 THEN 1 ELSE 0 END AS anchor
    FROM otn WHERE period = {LAST} AND cohort <= {TRAIN_LAST}""",
    ["otn"],
)


def anchored(t):
    o = t.otn.where((k("period") == LAST) & (k("cohort") <= TRAIN_LAST))
    starts = k("best_starts") / 3 * 41  # a start here is one line item
    return o.select("entity", "peak", B.role_anchor(k("leagues"), k("stars"), starts, k("best_minutes"), k("sum_minutes")).alias("anchor"))


def tier_cuts(rows, value, anchor):
    """(tier, cut): best balanced accuracy between neighbouring anchors, forced to rise.

    Candidates are distinct values; counts below them come from exact positions, so neither side of
    a cut is gathered.
    """
    up = rows.where(k(anchor) >= 1).select(k(anchor).alias("tier"), value, F.lit(0).alias("_l"), F.lit(1).alias("_u"))
    low = rows.select((k(anchor) + 1).alias("tier"), value, F.lit(1).alias("_l"), F.lit(0).alias("_u"))
    both = low.unionByName(up)
    bl = RK.value_positions(both, value, ["tier"], "_l").select("tier", value, k("below").alias("_bl"), k("total").alias("_nl"))
    bu = RK.value_positions(both, value, ["tier"], "_u").select("tier", value, k("below").alias("_bu"), k("total").alias("_nu"))
    acc = (k("_bl") / k("_nl") + (k("_nu") - k("_bu")) / k("_nu")) / 2
    cand = bl.join(bu, ["tier", value]).where("_nl > 0 AND _nu > 0").withColumn("_ba", F.round(acc, 12))
    best = cand.groupBy("tier").agg(F.max_by(value, F.struct("_ba", -k(value))).alias("_c"))
    w = Window.partitionBy(F.lit(1)).orderBy("tier").rowsBetween(Window.unboundedPreceding, 0)
    step = k("tier") * 1e-6
    return best.select("tier", F.bround(F.max(k("_c") - step).over(w) + step, 2).alias("cut"))


@query(
    "sta7_tier_cuts",
    """SELECT tier, round_even(max(c - tier * 1e-6) OVER (ORDER BY tier) + tier * 1e-6, 2) AS cut FROM (
      SELECT tier, first(c ORDER BY round(ba, 12) DESC, c) AS c FROM (
        SELECT tier, c, ((SELECT avg((a.peak < c)::INT) FROM anchored a WHERE a.anchor = tier - 1)
          + (SELECT avg((a.peak >= c)::INT) FROM anchored a WHERE a.anchor = tier)) / 2 AS ba
        FROM (SELECT DISTINCT t.tier, a.peak AS c FROM anchored a, (VALUES (1), (2), (3), (4), (5)) t(tier) WHERE a.anchor IN (t.tier, t.tier - 1)))
      WHERE ba IS NOT NULL GROUP BY 1)""",
    "anchored", ints="tier", rnd="cut", places=4,
)
def _(t):
    return tier_cuts(anchored(t), "peak", "anchor").where("tier <= 5")


GRADED_SQL = f"""greatest(peak_graded, CASE WHEN leagues >= 1 THEN {CUTS[4]} + 1e-6 WHEN stars >= 2 THEN {CUTS[3]} + 1e-6 WHEN solids >= 2 THEN {CUTS[2]} + 1e-6 ELSE -1e308 END)"""
CTES["graded"] = (f"SELECT entity, cohort, slot, position, franchise, name, n, period, active, stars, leagues, solids, round({GRADED_SQL}, 6) AS peak FROM otn", ["otn"])


def graded(t):
    peak = P.graded_peak(k("peak_graded"), k("leagues") >= 1, k("stars") >= 2, k("solids") >= 2, CUTS)
    keep = ["entity", "cohort", "slot", "position", "franchise", "name", "n", "period", "active", "stars", "leagues", "solids"]
    return t.otn.select(*keep, F.round(peak, 6).alias("peak"))


@query("sta8_graded_peak", "SELECT entity, n, peak FROM graded", "graded", ints="n", rnd="peak")
def _(t):
    return graded(t).select("entity", "n", "peak")


# -------------------------------------------------------------------------- grids and scores


@query("sta9_grid_cdf", f"SELECT entity, p1, p2 FROM {cdf_sql(cdf_sql('sp', 'y', 'p1'), '1.5', 'p2')}", "sp", rnd="p1 p2", places=7)
def _(t):
    p = t.slot_predictions()
    return p.select("entity", G.cdf("grid", "y").alias("p1"), G.cdf("grid", F.lit(1.5)).alias("p2"))


_TP = "sp"
for _i, _c in enumerate(CUTS):
    _TP = cdf_sql(_TP, str(_c), f"c{_i}")


@query(
    "sta10_tier_probabilities",
    f"SELECT entity, c0 AS p0, c1 - c0 AS p1, c2 - c1 AS p2, c3 - c2 AS p3, c4 - c3 AS p4, 1 - c4 AS p5 FROM {_TP}",
    "sp", rnd="p0 p1 p2 p3 p4 p5", places=7,
)
def _(t):
    p = t.slot_predictions().withColumn("tp", G.tier_probabilities("grid", CUTS))
    return p.select("entity", *[k("tp")[i].alias(f"p{i}") for i in range(6)])


@query(
    "sta11_pinball_crps_brier",
    "SELECT model, entity, crps, pinball_floor, brier_star FROM scored",
    "scored", rnd="crps pinball_floor:11 brier_star",
)
def _(t):
    return scored(t).select("model", "entity", "crps", "pinball_floor", "brier_star")


COVER_SQL = f"""SELECT model, level, avg((y < q)::INT + 0.5 * (y = q)::INT) AS observed, count(*) AS n FROM (
  SELECT model, y, unnest(grid) AS q, unnest({LEVELS_SQL}) AS level FROM scored) GROUP BY 1, 2"""


@query("sta12_half_tie_coverage", COVER_SQL, "scored", rnd="level observed")
def _(t):
    return FC.coverage_curve(scored(t), "y", ["model"])


@query("sta13_pit", "SELECT entity, pit FROM cpit", "cpit", rnd="pit", places=7)
def _(t):
    return with_pit(t).select("entity", "pit")


@query(
    "sta14_entity_scores",
    "SELECT model, entity, " + ", ".join(FC.SCORES) + " FROM scored",
    "scored", rnd="crps pinball_floor:11 pinball_median:11 pinball_ceiling:11 brier_star brier_bust below_floor above_ceiling",
)
def _(t):
    return scored(t).select("model", "entity", *FC.SCORES)


SUMMARY_SQL = f"""SELECT s.model, n, crps, below_floor, above_ceiling, diff, lo, hi FROM
  (SELECT model, count(*) AS n, avg(crps) AS crps, avg(below_floor) AS below_floor, avg(above_ceiling) AS above_ceiling FROM scored GROUP BY 1) s
  JOIN (SELECT a.model, avg(a.crps - b.crps) AS diff FROM scored a JOIN scored b ON a.entity = b.entity AND b.model = 'slot' GROUP BY 1) d ON d.model = s.model
  JOIN (SELECT model, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (
    SELECT a.model, w.rep, sum(w.w * (a.crps - b.crps)) / sum(w.w) AS m FROM scored a JOIN scored b ON a.entity = b.entity AND b.model = 'slot'
    JOIN (SELECT entity, rep, {RS.weight_sql('entity', 'rep')} AS w FROM (SELECT DISTINCT entity FROM scored), range(1, {REPS + 1}) r(rep)) w ON w.entity = a.entity
    GROUP BY 1, 2) GROUP BY 1) c ON c.model = s.model"""


def summary(t):
    s = scored(t)
    point = s.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("crps", "below_floor", "above_ceiling")])
    pairs = RS.paired_scores(s, "entity", "crps", ["slot"])
    ci = RS.bootstrap_mean(pairs, "entity", ["diff"], ["model"], REPS).drop("n")
    return point.join(ci.withColumnsRenamed({"diff_lo": "lo", "diff_hi": "hi"}), "model")


@query("sta15_model_summary", SUMMARY_SQL, "scored", rnd="crps below_floor above_ceiling diff lo hi", places=7)
def _(t):
    return summary(t)


@query(
    "sta16_comparison_verdicts",
    f"SELECT model, CASE WHEN round(hi, 9) < 0 THEN 'better' WHEN round(lo, 9) > 0 THEN 'worse' ELSE 'no detectable difference' END AS verdict FROM ({SUMMARY_SQL})",
    "scored",
)
def _(t):
    return summary(t).select("model", FC.verdict_label(F.round("lo", 9), F.round("hi", 9)).alias("verdict"))


BLEND_W = [0.0, 0.25, 0.5, 0.75, 1.0]


def blends(t):
    a = t.slot_predictions().select("entity", "cohort", "y", k("grid").alias("ga"))
    b = t.slot_predictions(True).select("entity", k("grid").alias("gb"))
    both = a.join(b, "entity")
    arr = F.array(*[F.struct(F.lit(w).alias("w"), G.blend(["ga", "gb"], [w, 1 - w]).alias("grid")) for w in BLEND_W])
    return both.select("entity", "cohort", "y", F.explode(arr).alias("_b")).select("entity", "cohort", "y", "_b.w", "_b.grid")


CTES["blended"] = (
    f"""SELECT a.entity, a.cohort, a.y, w, list_transform(range(1, 20), lambda i: w * list_sort(a.grid)[i] + (1 - w) * b.grid[i]) AS grid
    FROM sp a JOIN cp b USING (entity), (VALUES {', '.join(f'({w})' for w in BLEND_W)}) v(w)""",
    ["sp", "cp"],
)
BLEND_CRPS = f"""(SELECT *, 2 * list_avg(list_transform(range(1, 20), lambda i: greatest({LEVELS_SQL}[i] * (y - grid[i]), ({LEVELS_SQL}[i] - 1) * (y - grid[i])))) AS crps FROM blended)"""


@query(
    "sta17_blend_weight",
    f"""SELECT w, round(avg(crps) FILTER (WHERE cohort <= 1997), 7) AS tune, round(avg(crps) FILTER (WHERE cohort > 1997), 7) AS report FROM {BLEND_CRPS}
    GROUP BY 1""",
    "blended", rnd="w tune report", places=7,
)
def _(t):
    b = blends(t).withColumn("crps", G.crps("y", "grid"))
    return b.groupBy("w").agg(
        F.avg(F.when(k("cohort") <= 1997, k("crps"))).alias("tune"), F.avg(F.when(k("cohort") > 1997, k("crps"))).alias("report")
    )


@query(
    "sta18_subgroup_differences",
    f"""SELECT split, grp, n, diff, lo, hi FROM (SELECT split, grp, count(*) AS n, avg(d) AS diff FROM rows_ GROUP BY 1, 2 HAVING count(*) >= 20)
    JOIN (SELECT split, grp, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (
      SELECT split, grp, rep, sum(w * d) / sum(w) AS m FROM (SELECT *, {RS.weight_sql('entity', 'rep')} AS w FROM rows_, range(1, {REPS + 1}) r(rep)) GROUP BY 1, 2, 3) GROUP BY 1, 2)
    USING (split, grp)""",
    "rows_", rnd="diff lo hi", places=7,
)
def _(t):
    s = scored(t)
    d = RS.paired_scores(s, "entity", "crps", ["slot"]).where("model = 'slot + conformal'").select("entity", "diff")
    e = t.ent.select("entity", "position", B.slot_band("slot").alias("band"))
    long = d.join(e, "entity").unpivot(["entity", "diff"], ["position", "band"], "split", "grp")
    out = RS.bootstrap_mean(long, "entity", ["diff"], ["split", "grp"], REPS).where("n >= 20")
    return out.withColumnsRenamed({"diff_lo": "lo", "diff_hi": "hi"})


CTES["rows_"] = (
    """SELECT a.entity, a.crps - b.crps AS d, s.split, s.grp FROM scored a JOIN scored b ON a.entity = b.entity AND a.model = 'slot + conformal' AND b.model = 'slot'
    JOIN (SELECT entity, 'position' AS split, position AS grp FROM ent UNION ALL SELECT entity, 'band', CASE WHEN slot <= 5 THEN 'Picks 1-5'
      WHEN slot <= 14 THEN 'Picks 6-14' WHEN slot <= 30 THEN 'Picks 15-30' ELSE 'Picks 31-60' END FROM ent) s ON s.entity = a.entity""",
    ["scored", "ent"],
)


@query(
    "sta19_reliability",
    f"""SELECT bin, avg(p) AS predicted, avg((y >= {STAR_CUT})::INT) AS observed, count(*) AS n FROM (
      SELECT p, y, least(greatest(len(list_filter(e, lambda v: v <= p)) - 1, 0), 7) AS bin FROM (
        SELECT round(1 - c, 9) AS p, y FROM {cdf_sql('sp', str(STAR_CUT), 'c')}),
        (SELECT quantile_cont(round(1 - c, 9), [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]) AS e FROM {cdf_sql('sp', str(STAR_CUT), 'c')}))
    GROUP BY 1""",
    "sp", ints="bin", rnd="predicted observed", places=7,
)
def _(t):
    p = t.slot_predictions().select(F.round(1 - G.cdf("grid", F.lit(STAR_CUT)), 9).alias("p"), "y")
    edges = RK.quantile_grid(p, "p", [i / 8 for i in range(9)]).select("grid").scalar()
    binned = p.withColumn("_e", edges).withColumn(
        "bin", F.least(F.greatest(B.bin_index("p", k("_e")) - 1, F.lit(0)), F.lit(7))
    )
    return binned.groupBy("bin").agg(
        F.avg("p").alias("predicted"), A.share(k("y") >= STAR_CUT).alias("observed"), F.count(F.lit(1)).alias("n")
    )


@query(
    "sta20_model_table",
    f"""SELECT CASE model WHEN 'slot' THEN 'Draft slot, uncalibrated' ELSE 'Draft slot + calibration (model of record)' END AS label, crps, below_floor
    FROM ({SUMMARY_SQL})""",
    "scored", rnd="crps below_floor", places=7,
)
def _(t):
    label = ladder([(k("model") == "slot", "Draft slot, uncalibrated")], "Draft slot + calibration (model of record)")
    return summary(t).select(label.alias("label"), "crps", "below_floor").orderBy("crps")


@query(
    "sta21_conformal_shift",
    "SELECT fold, slot, grid[1] AS q05, grid[10] AS q50, grid[18] AS q90 FROM cm_pred",
    "cm_pred", ints="fold slot", rnd="q05 q50 q90", places=7,
)
def _(t):
    f = t.model(True).fit(t.tgt)
    return f.select("fold", "slot", k("grid")[0].alias("q05"), k("grid")[9].alias("q50"), k("grid")[17].alias("q90"))


@query(
    "sta22_quantile_blend",
    "SELECT entity, grid[1] AS q05, grid[10] AS q50, grid[19] AS q95 FROM blended WHERE w = 0.25",
    "blended", rnd="q05 q50 q95", places=11,
)
def _(t):
    a, b = t.slot_predictions(), t.slot_predictions(True)
    out = FC.blend_predictions([a, b], [0.25, 0.75], ["entity"])
    return out.select("entity", k("grid")[0].alias("q05"), k("grid")[9].alias("q50"), k("grid")[18].alias("q95"))


CTES["feat"] = (
    """SELECT e.entity, e.cohort, e.slot, CAST(e.slot AS DOUBLE) AS f1, f2, f3, CASE WHEN e.entity % 4 <> 0 THEN price END AS f4 FROM ent e
    LEFT JOIN (SELECT entity, a AS f2, minutes AS f3 FROM seasons WHERE period = cohort + 1) s ON s.entity = e.entity""",
    ["ent", "seasons"],
)


def feats(t):
    """Entities with three features, some missing, and the outcome."""
    first = t.seasons.where(k("period") == k("cohort") + 1).select("entity", k("a").alias("f2"), k("minutes").alias("f3"))
    return t.tgt.join(first, "entity", "left").withColumns(
        {"f1": k("slot").cast("double"), "f4": F.when(k("entity") % 4 != 0, k("price"))}
    )


FEATURES = ["f1", "f2", "f3", "f4"]


def fold_rows(t):
    """(train with fold, test with fold) of the feature table."""
    f = feats(t).withColumnRenamed("entity", "id")
    known = f.where(k("y").isNotNull())
    train = FO.assign_folds(known, "cohort", HORIZON, FOLDS[0], FOLDS[-1])
    test = known.where(k("cohort").between(FOLDS[0], FOLDS[-1])).withColumn("fold", k("cohort"))
    return train, test


@query(
    "sta23_fold_imputer",
    """WITH_tr""".replace("WITH_tr", """SELECT id, fold, least(greatest((coalesce(x.f2, m2) - mu2) / sd2, -5), 5) AS z_f2,
      least(greatest((coalesce(x.f4, m4) - mu4) / sd4, -5), 5) AS z_f4, (x.f4 IS NULL)::INT AS no_f4
    FROM (SELECT entity AS id, tgt.cohort AS fold, feat.f2, feat.f4 FROM feat JOIN tgt USING (entity) WHERE y IS NOT NULL AND tgt.cohort BETWEEN 1996 AND 1998) x
    JOIN (SELECT fold, any_value(m2) m2, any_value(m4) m4, avg(coalesce(f2, m2)) mu2, stddev_samp(coalesce(f2, m2)) sd2,
        avg(coalesce(f4, m4)) mu4, stddev_samp(coalesce(f4, m4)) sd4 FROM tr JOIN (SELECT fold, median(f2) m2, median(f4) m4 FROM tr GROUP BY 1) USING (fold) GROUP BY 1)
    USING (fold)""").replace("FROM tr", "FROM (SELECT f.fold, feat.f2, feat.f4 FROM feat JOIN tgt USING (entity) JOIN (VALUES (1996), (1997), (1998)) f(fold) ON tgt.cohort + 2 <= f.fold WHERE y IS NOT NULL) tr"),
    "feat tgt", ints="fold no_f4", rnd="z_f2 z_f4", places=7,
)
def _(t):
    train, test = fold_rows(t)
    out = TR.imputed(test, train, ["f2", "f4"], ["fold"], min_observed=5)
    return out.select("id", "fold", "z_f2", "z_f4", "no_f4")


@query(
    "sta25_rolling_backtest",
    "SELECT model, cohort AS fold, count(*) AS n, avg(crps) AS crps, avg(y) AS y FROM scored GROUP BY 1, 2",
    "scored", ints="fold", rnd="crps y", places=7,
)
def _(t):
    def run(conformal):
        return lambda: t.slot_predictions(conformal).select(k("cohort").alias("fold"), k("entity").alias("id"), "y", "grid")

    preds = FC.backtest({"slot": run(False), "slot + conformal": run(True)}, "y")
    s = preds.withColumn("crps", G.crps("y", "grid"))
    return s.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("crps").alias("crps"), F.avg("y").alias("y"))


#: Two-sided p of a correlation in SQL, from columns m (n - 2) and th (arc sine of its size): the tail of t with m
#: degrees of freedom is that of a power of a cosine, here by Simpson's rule.
_STEPS = 2000


def _cosine_power(start: str) -> str:
    weight = f"CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    at = f"{start} + i * (pi() / 2 - {start}) / {_STEPS}"
    return f"list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: ({weight}) * pow(greatest(cos({at}), 0), m - 1))) * (pi() / 2 - {start})"


P_SQL = f"least(1.0, {_cosine_power('th')} / ({_cosine_power('0.0')}))"
_RANK = "rank() OVER (PARTITION BY feature ORDER BY {0}) + (count(*) OVER (PARTITION BY feature, {0}) - 1) / 2"


@query(
    "sta28_residual_signal",
    f"""SELECT feature, rho_y, rho_resid, {P_SQL} AS p, n FROM (SELECT *, n - 2 AS m, asin(least(abs(rho_resid), 1)) AS th FROM (
      SELECT feature, corr(rv, ry) AS rho_y, corr(rv, rr) AS rho_resid, count(*) AS n FROM (
        SELECT feature, {_RANK.format('v')} AS rv, {_RANK.format('y')} AS ry, {_RANK.format('resid')} AS rr FROM (
          SELECT * FROM (SELECT cp.y, cp.y - cp.grid[10] AS resid, unnest(['f1', 'f2', 'f3', 'f4']) AS feature, unnest([f1, f2, f3, f4]) AS v FROM cp JOIN feat USING (entity))
          WHERE v IS NOT NULL)) GROUP BY 1))""",
    "cp feat", rnd="rho_y:6 rho_resid:6 p:5",
)
def _(t):
    """Rank correlation of each feature with the outcome and with what the slot leaves of it."""
    p = t.slot_predictions(True).withColumn("resid", k("y") - G.at_level("grid", G.MEDIAN)).select("entity", "resid")
    long = feats(t).where(k("y").isNotNull()).join(p, "entity").unpivot(["entity", "y", "resid"], FEATURES, "feature", "v")
    a = AS.spearman(long, "v", "y", ["feature"]).withColumnsRenamed({"rho": "rho_y"})
    b = AS.spearman(long, "v", "resid", ["feature"]).withColumnsRenamed({"rho": "rho_resid"}).drop("n")
    out = a.join(b, "feature").withColumn("p", corr_p_value("rho_resid", k("n").cast("double")))
    return out.orderBy(F.abs("rho_resid").desc()).select("feature", "rho_y", "rho_resid", "p", "n")


RANKED = """(SELECT *, rank() OVER (PARTITION BY cohort ORDER BY f2) + (count(*) OVER (PARTITION BY cohort, f2) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY cohort ORDER BY y) + (count(*) OVER (PARTITION BY cohort, y) - 1) / 2 AS ry
  FROM feat JOIN (SELECT entity, y, cohort AS c2 FROM tgt) USING (entity) WHERE y IS NOT NULL AND f2 IS NOT NULL)"""


@query(
    "sta29_spearman_auc",
    f"""SELECT cohort, corr(rx, ry) AS rho, (sum(CASE WHEN y >= 1.2 THEN rx END) - sum((y >= 1.2)::INT) * (sum((y >= 1.2)::INT) + 1) / 2)
      / nullif(sum((y >= 1.2)::INT) * sum((y < 1.2)::INT), 0) AS auc, count(*) AS n FROM {RANKED} GROUP BY 1""",
    "feat tgt", ints="cohort", rnd="rho auc", places=7,
)
def _(t):
    d = feats(t).where(k("y").isNotNull() & k("f2").isNotNull()).withColumn("hit", k("y") >= 1.2)
    rho = AS.spearman(d, "f2", "y", ["cohort"])
    return rho.join(AS.auc(d, "f2", "hit", ["cohort"]).drop("n"), "cohort")


@query(
    "sta30_definition_validation",
    """SELECT cand, (sum(CASE WHEN hit THEN r END) - sum(hit::INT) * (sum(hit::INT) + 1) / 2) / (sum(hit::INT) * sum((NOT hit)::INT)) AS auc
    FROM (SELECT cand, hit, rank() OVER (PARTITION BY cand ORDER BY v) + (count(*) OVER (PARTITION BY cand, v) - 1) / 2 AS r FROM (
      SELECT stars > 0 AS hit, unnest(['peak', 'total', 'blend']) AS cand, unnest([peak, total, round(0.75 * peak + 0.25 * total, 6)]) AS v FROM otn WHERE n = 4))
    GROUP BY 1""",
    "otn", rnd="auc", places=7,
)
def _(t):
    return validation(t).select("cand", "auc")


def candidates(t):
    o = t.otn.where("n = 4").withColumns({"hit": k("stars") > 0, "blend": F.round(0.75 * k("peak") + 0.25 * k("total"), 6)})
    return o.unpivot(["entity", "hit"], ["peak", "total", "blend"], "cand", "v")


def validation(t):
    return AS.auc(candidates(t), "v", "hit", ["cand"])


@query("sta30_validation_intervals")
def _(t):
    """Bootstrap intervals of the AUC per candidate, and of its difference from `peak`."""
    a = t.stage("candidate_aucs", lambda: AS.auc_replicates(candidates(t), "v", "hit", "entity", ["cand"], 1000))
    base = a.where("cand = 'peak'").select("rep", k("auc").alias("b"))
    a = a.join(base, "rep").withColumn("diff", k("auc") - k("b"))
    ci = RS.interval(a, ["cand"], "auc", "lo", "hi").join(RS.interval(a, ["cand"], "diff", "diff_lo", "diff_hi"), "cand")
    return validation(t).join(ci, "cand").select(
        "cand", *[F.round(c, 6).alias(c) for c in ("auc", "lo", "hi", "diff_lo", "diff_hi")]
    )


# ------------------------------------------------------------------------------- survival

CTES["careers"] = (
    """SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS band, coalesce(l - cohort, 0) AS duration, l IS NULL OR l <= 1998 AS ended, cohort, c_acctbal,
      c_nationkey, coalesce(p, 0) AS played
    FROM (SELECT c_custkey, c_acctbal, c_nationkey, 1994 AS cohort FROM customer)
    LEFT JOIN (SELECT o_custkey, max(year(o_orderdate)) AS l, count(DISTINCT year(o_orderdate)) AS p FROM orders
      WHERE year(o_orderdate) <= 2000 AND (o_custkey % 3 > 0 OR year(o_orderdate) <= 1994 + o_custkey % 7) GROUP BY 1) ON o_custkey = c_custkey""",
    [],
)


def careers(t):
    """Customers as careers; every third one stops early by a key rule."""
    year = F.year("o_orderdate")
    s = t.orders.select(k("o_custkey").alias("id"), year.alias("period")).where(
        (k("period") <= LAST) & ((k("id") % 3 > 0) | (k("period") <= 1994 + k("id") % 7))
    )
    e = t.customer.select(
        k("c_custkey").alias("id"), F.when(k("c_nationkey") % 2 == 0, "even").otherwise("odd").alias("band"), F.lit(1994).alias("cohort"), "c_acctbal", "c_nationkey"
    )
    return SV.careers(e, s, "id", "cohort", "period", LAST)


@query(
    "sta31_career_table",
    "SELECT id, band, duration, ended, played FROM careers",
    "careers", ints="duration played",
)
def _(t):
    return careers(t).select("id", "band", "duration", "ended", k("periods_played").alias("played"))


@query(
    "sta32_kaplan_meier",
    """SELECT band, t, CASE WHEN dead THEN 0 ELSE exp(ls) END AS survival,
      CASE WHEN NOT dead AND ls < 0 THEN exp(ls) ** exp(-1.959963984540054 * sqrt(v) / ls) WHEN dead THEN 0 ELSE 1 END AS ci_low,
      CASE WHEN NOT dead AND ls < 0 THEN exp(ls) ** exp(1.959963984540054 * sqrt(v) / ls) WHEN dead THEN 0 ELSE 1 END AS ci_high, n
    FROM (SELECT band, t, n, bool_or(d > 0 AND d = risk) OVER w AS dead,
        sum(CASE WHEN d > 0 AND d < risk THEN ln(1 - d / risk) ELSE 0 END) OVER w AS ls,
        sum(CASE WHEN d > 0 AND d < risk THEN d / (risk * (risk - d)) ELSE 0 END) OVER w AS v
      FROM (SELECT b.band, g.t, b.n, (SELECT count(*) FROM careers c WHERE c.band = b.band AND c.duration >= g.t) AS risk,
          (SELECT count(*) FROM careers c WHERE c.band = b.band AND c.duration = g.t AND ended) AS d
        FROM (SELECT band, count(*) AS n FROM careers GROUP BY 1) b, range(0, 7) g(t)) WINDOW w AS (PARTITION BY band ORDER BY t))""",
    "careers", ints="t n", rnd="survival ci_low ci_high", places=7,
)
def _(t):
    return SV.kaplan_meier(careers(t), "band", "duration", "ended", 6).drop("median")


@query("sta33_cox_hazard")
def _(t):
    d = careers(t).where("duration > 0").withColumns(
        {"log2_slot": F.log2(k("id") % 60 + 1), "age": k("c_acctbal") / 1000, "other": (k("c_nationkey") > 12).cast("double")}
    ).select("id", "duration", "ended", "log2_slot", "age", "other")
    rows = []
    for period, frame in zip(("early", "late"), SV.split_at(d, "duration", "ended", 4)):
        fit = SV.cox(frame, ["log2_slot", "age", "other"], "duration", "ended")
        risk = sum((F.lit(v["coef"]) * k(x) for x, v in fit.items()), F.lit(0.0))
        c = SV.concordance(frame.withColumn("risk", F.round(risk, 9)), "risk", "duration", "ended").select("concordance")
        for x, v in fit.items():
            rows.append(
                c.select(
                    F.lit(period).alias("period"), F.lit(x).alias("covariate"),
                    *[F.lit(round(v[m], 6)).alias(m) for m in ("hazard_ratio", "ci_low", "ci_high", "p")],
                    F.lit(v["n"]).alias("n"), F.round("concordance", 6).alias("concordance"),
                )
            )
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# ------------------------------------------------------------------- rates, pooling, causal

Z = "1.959963984540054"


def wilson_sql(kk: str, n: str, name: str) -> str:
    half = f"{Z} * sqrt({kk} / {n} * (1 - {kk} / {n}) / {n} + {Z} * {Z} / (4 * {n} * {n}))"
    centre, den = f"({kk} / {n} + {Z} * {Z} / (2 * {n}))", f"(1 + {Z} * {Z} / {n})"
    return f"({centre} - {half}) / {den} AS {name}_lo, ({centre} + {half}) / {den} AS {name}_hi"


SEGMENT_SQL = f"""SELECT {{by}}, n, up / n AS beat_ceiling, {wilson_sql('up', 'n', 'bc')}, dn / n AS below_floor, {wilson_sql('dn', 'n', 'bf')}, mean_pit,
  mean_pit - {Z} * sd / sqrt(n) AS pit_lo, mean_pit + {Z} * sd / sqrt(n) AS pit_hi FROM (
  SELECT {{by}}, count(*) AS n, sum((v = 'beat ceiling')::INT) AS up, sum((v = 'below floor')::INT) AS dn, avg(pit) AS mean_pit, stddev_samp(pit) AS sd
  FROM (SELECT *, {VERDICT_SQL} AS v FROM cpit) {{join}} GROUP BY ALL)"""
RATE_COLS = "beat_ceiling bc_lo bc_hi below_floor bf_lo bf_hi mean_pit pit_lo pit_hi"


@query("sta34_segment_intervals", SEGMENT_SQL.format(by="position", join=""), "cpit", rnd=RATE_COLS, places=7)
def _(t):
    return GR.segment_rates(with_pit(t), ["position"], "pit", "verdict")


POOL_SQL = """SELECT franchise, n, raw_mean, raw_mean - 1.959963984540054 * sqrt(se2) AS raw_lo, raw_mean + 1.959963984540054 * sqrt(se2) AS raw_hi,
  grand + t2 / (t2 + se2) * (raw_mean - grand) AS pooled FROM g, (SELECT sum(raw_mean / se2) / sum(1 / se2) AS grand,
    greatest((sum(raw_mean ** 2 / se2) - sum(raw_mean / se2) ** 2 / sum(1 / se2) - (count(*) - 1)) / (sum(1 / se2) - sum(1 / se2 ** 2) / sum(1 / se2)), 0) AS t2 FROM g)""".replace(
    "FROM g", "FROM (SELECT franchise, avg(pit) AS raw_mean, count(*) AS n, any_value(v) / count(*) AS se2 FROM cpit, (SELECT var_samp(pit) AS v FROM cpit) GROUP BY 1) g"
)


@query("sta35_pooled_group_effects", POOL_SQL, "cpit", rnd="raw_mean raw_lo raw_hi pooled", places=7)
def _(t):
    return GR.pooled_effects(with_pit(t), "franchise", "pit")[0]


#: Upper tail of chi-square in SQL, from columns q and df (at least 2), by Simpson's rule.
CHI2_SQL = f"""greatest(0.0, 1 - q / {_STEPS} / 3 * list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: (CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  * CASE WHEN i = 0 AND df > 2 THEN 0 ELSE exp((df / 2 - 1) * ln(greatest(i * q / {_STEPS}, 1e-300)) - i * q / {_STEPS} / 2 - df / 2 * ln(2) - lgamma(df / 2)) END)))"""


@query(
    "sta35_heterogeneity_test",
    f"""SELECT groups, round(q, 6) AS q, {CHI2_SQL} AS p_value, sqrt(greatest((q - df) / c, 0)) AS tau, grand, df FROM (
      SELECT count(*) AS groups, count(*) - 1 AS df, sum(m * m / se2) - sum(m / se2) ** 2 / sum(1 / se2) AS q, sum(1 / se2) - sum(1 / se2 ** 2) / sum(1 / se2) AS c,
        sum(m / se2) / sum(1 / se2) AS grand FROM (
        SELECT franchise, avg(pit) AS m, any_value(v) / count(*) AS se2 FROM cpit, (SELECT var_samp(pit) AS v FROM cpit) GROUP BY 1))""",
    "cpit", rnd="q:6 p_value:5 tau:6 grand:6",
)
def _(t):
    test = GR.pooled_effects(with_pit(t), "franchise", "pit")[1]
    return test.select("groups", "q", "p_value", "tau", "grand", "df")


def treated(t):
    f = feats(t).select("entity", "f1", "f2", "f3", "f4").fillna(0.0)
    p = with_pit(t).select("entity", "pit")
    return p.join(f, "entity").withColumn("treated", (k("entity") * 7 % 11 + k("f1") / 10) > 7)


@query("sta36_propensity_weighting")
def _(t):
    d = CA.propensity(treated(t), FEATURES, "treated")
    est = CA.ipw_effect(d, "treated", "pit", k("pit") > 0.5)
    return est.select(*[F.round(c, 5).alias(c) for c in ("diff", "risk_ratio", "raw_diff")], "n_used", F.round(CA.e_value(k("risk_ratio")), 5).alias("e_value"))


PROPENSITY_REPS = 300


@query("sta36_propensity_intervals")
def _(t):
    """Intervals of the weighted difference and of the risk ratio over replicates, the propensity model refitted in each."""
    d = t.stage("treated", lambda: treated(t)).withColumn("_label", k("treated").cast("double"))
    fits = CA.propensity_replicates(d, FEATURES, "treated", "pit", "entity", PROPENSITY_REPS, hit=k("pit") > 0.5)
    ends = F.array(F.lit(0.025), F.lit(0.975))
    q = fits.agg(F.percentile("diff", ends).alias("d"), F.percentile("ratio", ends).alias("r"))
    cols = {"lo": k("d")[0], "hi": k("d")[1], "ratio_lo": k("r")[0], "ratio_hi": k("r")[1]}
    return q.select(*[F.round(c, 4).alias(n) for n, c in cols.items()])


@query(
    "sta37_balance",
    """SELECT 'f1' AS feature, (avg(f1) FILTER (WHERE tr) - avg(f1) FILTER (WHERE NOT tr)) / sqrt((var_pop(f1) FILTER (WHERE tr) + var_pop(f1) FILTER (WHERE NOT tr)) / 2) AS smd FROM d
    UNION ALL SELECT 'f2', (avg(f2) FILTER (WHERE tr) - avg(f2) FILTER (WHERE NOT tr)) / sqrt((var_pop(f2) FILTER (WHERE tr) + var_pop(f2) FILTER (WHERE NOT tr)) / 2) FROM d""".replace(
        "FROM d", "FROM (SELECT f1, coalesce(f2, 0) AS f2, (cpit.entity * 7 % 11 + f1 / 10) > 7 AS tr FROM cpit JOIN feat USING (entity)) d"
    ),
    "cpit feat", rnd="smd", places=7,
)
def _(t):
    return CA.balance(treated(t), ["f1", "f2"], "treated")


@query(
    "sta39_situation_features",
    """SELECT e.entity, w.pct <= 1 / 3 AS weak, sh.share >= md.m AS crowded, mv.moved IS NOT NULL AS moved, coalesce(m1.minutes, 0) AS first_minutes,
      ab.absent AS absent FROM ent e
    LEFT JOIN (SELECT franchise, period, (rank() OVER (PARTITION BY period ORDER BY s) + (count(*) OVER (PARTITION BY period, s) - 1) / 2) / count(*) OVER (PARTITION BY period) AS pct
      FROM (SELECT franchise, period, round(sum(a), 6) AS s FROM seasons JOIN ent USING (entity) GROUP BY 1, 2)) w ON w.franchise = e.franchise AND w.period = e.cohort + 1
    LEFT JOIN (SELECT franchise, period, position, pm / sum(pm) OVER (PARTITION BY franchise, period) AS share FROM (
      SELECT franchise, period, position, sum(minutes) AS pm FROM seasons JOIN ent USING (entity) GROUP BY 1, 2, 3)) sh
      ON sh.franchise = e.franchise AND sh.period = e.cohort + 1 AND sh.position = e.position
    LEFT JOIN (SELECT e2.position, median(sh2.share) AS m FROM ent e2 JOIN (SELECT franchise, period, position, pm / sum(pm) OVER (PARTITION BY franchise, period) AS share FROM (
      SELECT franchise, period, position, sum(minutes) AS pm FROM seasons JOIN ent USING (entity) GROUP BY 1, 2, 3)) sh2
      ON sh2.franchise = e2.franchise AND sh2.period = e2.cohort + 1 AND sh2.position = e2.position GROUP BY 1) md ON md.position = e.position
    LEFT JOIN (SELECT DISTINCT entity AS moved FROM seasons WHERE star AND period <= cohort + 3) mv ON mv.moved = e.entity
    LEFT JOIN (SELECT entity, minutes FROM seasons WHERE period = cohort + 1) m1 ON m1.entity = e.entity
    LEFT JOIN (SELECT entity, sum(len - games) / sum(len) AS absent FROM seasons JOIN (SELECT period, max(games) AS len FROM seasons GROUP BY 1) USING (period)
      WHERE period <= cohort + 2 GROUP BY 1) ab ON ab.entity = e.entity""",
    "ent seasons", rnd="first_minutes absent",
)
def _(t):
    s = t.seasons.join(t.ent.select("entity", "franchise", "position"), "entity")
    by_pos = s.groupBy("franchise", "period", "position").agg(F.sum("minutes").alias("pm"), F.sum("a").alias("sa"))
    team = by_pos.groupBy("franchise", "period").agg(F.sum("pm").alias("tm"), F.round(F.sum("sa"), 6).alias("s"))
    weak = RK.with_ranks(team, "s", ["period"], percent_rank="pct").select("franchise", "period", (k("pct") <= 1 / 3).alias("weak"), "tm")
    e = t.ent.withColumn("period", k("cohort") + 1)
    e = e.join(weak, ["franchise", "period"], "left").join(by_pos.drop("sa"), ["franchise", "period", "position"], "left")
    e = e.withColumn("share", k("pm") / k("tm"))
    e = e.join(RK.group_median(e, "share", ["position"], "m"), "position", "left")
    length = t.seasons.groupBy("period").agg(F.max("games").alias("len"))
    early = t.seasons.join(length, "period").groupBy("entity").agg(
        F.bool_or(k("star") & (k("period") <= k("cohort") + 3)).alias("moved"),
        F.sum(F.when(k("period") == k("cohort") + 1, k("minutes"))).alias("first_minutes"),
        (F.sum(F.when(k("period") <= k("cohort") + 2, k("len") - k("games")))
         / F.sum(F.when(k("period") <= k("cohort") + 2, k("len")))).alias("absent"),
    )
    out = e.join(early, "entity", "left")
    return out.select(
        "entity", "weak", (k("share") >= k("m")).alias("crowded"), F.coalesce("moved", F.lit(False)).alias("moved"),
        F.coalesce("first_minutes", F.lit(0.0)).alias("first_minutes"), "absent",
    )


# as-of bands at several horizons: the horizon is part of the fold key, one job for all
for _h in (1, 2):
    CTES[f"y{_h}"] = (f"SELECT ent.*, o.peak AS y FROM ent LEFT JOIN (SELECT entity, peak FROM otn WHERE n = {_h}) o USING (entity)", ["ent", "otn"])
    CTES.update(slot_model_ctes(f"h{_h}", f"y{_h}", _h, ALL_COHORTS, calib=1, min_fit=1, min_training=100))
    CTES[f"b{_h}"] = (
        f"""SELECT entity, slot, y, grid, pit, {VERDICT_SQL} AS verdict FROM """
        + pit_sql(f"(SELECT t.*, list_sort(g.grid) AS grid FROM y{_h} t JOIN h{_h}_pred g ON g.fold = t.cohort AND g.slot = t.slot WHERE t.y IS NOT NULL)"),
        [f"y{_h}", f"h{_h}_pred"],
    )


def bands(t, horizon):
    from ..operators.forecast import SlotModel

    at = t.otn.where(k("n") == horizon).select("entity", k("peak").alias("y"))
    rows = t.ent.join(at, "entity", "left")
    m = SlotModel("cohort", "slot", "y", "entity", horizon, ALL_COHORTS, 60, calib=1, min_fit=1, min_training=100)
    p = t.stage(f"predictions_n{horizon}", lambda: m.predict(rows.where(k("y").isNotNull()), m.fit(rows)))
    return p.withColumns(
        {
            "horizon": F.lit(horizon), "floor": G.at_level("grid", G.FLOOR), "median": G.at_level("grid", G.MEDIAN),
            "ceiling": G.at_level("grid", G.CEILING), "pit": G.pit("grid", "y"),
        }
    ).withColumn("verdict", G.verdict("y", k("floor"), k("ceiling")))


@query(
    "sta40_asof_bands",
    " UNION ALL ".join(
        f"SELECT {h} AS horizon, entity, grid[5] AS floor, grid[10] AS median, grid[18] AS ceiling, y, pit, verdict FROM b{h}" for h in (1, 2)
    ),
    "b1 b2", ints="horizon", rnd="floor:11 median:11 ceiling:11 y pit:8",
)
def _(t):
    cols = ["horizon", "entity", "floor", "median", "ceiling", "y", "pit", "verdict"]
    return bands(t, 1).select(*cols).unionByName(bands(t, 2).select(*cols))


@query(
    "sta41_segment_table",
    SEGMENT_SQL.format(
        by="split, grp",
        join="""JOIN (SELECT entity AS e2, unnest(['Slot', 'Position', 'Era', 'Price band', 'Franchise group']) AS split, unnest([CASE WHEN slot <= 5 THEN 'Picks 1-5' WHEN slot <= 14 THEN 'Picks 6-14'
          WHEN slot <= 30 THEN 'Picks 15-30' ELSE 'Picks 31-60' END, position, cohort::VARCHAR,
            CASE WHEN price < 1000 THEN 'under 1000' WHEN price < 1200 THEN '1000 to 1199' ELSE '1200 and more' END, substr(franchise, 1, length(franchise) - 1)]) AS grp FROM ent) s ON s.e2 = entity""",
    ),
    "cpit ent", rnd=RATE_COLS, places=7,
)
def _(t):
    price = F.when(k("price") < 1000, "under 1000").when(k("price") < 1200, "1000 to 1199").otherwise("1200 and more")
    own = t.ent.select("entity", price.alias("Price band"), F.expr("substr(franchise, 1, length(franchise) - 1)").alias("Franchise group"))
    d = with_pit(t).join(own, "entity").select(
        "entity", "pit", "verdict", B.slot_band("slot").alias("Slot"), k("position").alias("Position"), k("cohort").cast("string").alias("Era"), "Price band", "Franchise group"
    )
    long = d.unpivot(["entity", "pit", "verdict"], ["Slot", "Position", "Era", "Price band", "Franchise group"], "split", "grp")
    return GR.segment_rates(long, ["split", "grp"], "pit", "verdict")


@query(
    "sta42_verdict_reversals",
    f"""SELECT n, up, down, (up + down) / n AS overturned, {wilson_sql('(up + down)', 'n', 'ov')} FROM (
      SELECT count(*) AS n, sum((r2 > r1)::INT) AS up, sum((r2 < r1)::INT) AS down FROM (
        SELECT CASE b1.verdict WHEN 'below floor' THEN 0 WHEN 'within band' THEN 1 ELSE 2 END AS r1,
          CASE b2.verdict WHEN 'below floor' THEN 0 WHEN 'within band' THEN 1 ELSE 2 END AS r2 FROM b1 JOIN b2 USING (entity)))""",
    "b1 b2", ints="n up down", rnd="overturned ov_lo ov_hi", places=7,
)
def _(t):
    level = {"below floor": 0, "within band": 1, "beat ceiling": 2}
    from ..functions.common import lookup

    a = bands(t, 1).select("entity", lookup("verdict", level).alias("r1"))
    b = bands(t, 2).select("entity", lookup("verdict", level).alias("r2"))
    g = a.join(b, "entity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(k("r2") > k("r1")).alias("up"), F.count_if(k("r2") < k("r1")).alias("down")
    )
    moved = k("up") + k("down")
    lo, hi = G.wilson(moved, "n")
    return g.select("n", "up", "down", (moved / k("n")).alias("overturned"), lo.alias("ov_lo"), hi.alias("ov_hi"))


def both_verdicts(t):
    """(entity, slot, first, later): verdicts at the two horizons."""
    a = bands(t, 1).select("entity", "slot", k("verdict").alias("first"))
    return a.join(bands(t, 2).select("entity", k("verdict").alias("later")), "entity")


VERDICTS = ["below floor", "within band", "beat ceiling"]


@query(
    "sta42_verdict_crosstab",
    """SELECT v.v AS first, count(*) FILTER (WHERE later = 'below floor') AS "below floor", count(*) FILTER (WHERE later = 'within band') AS "within band",
      count(*) FILTER (WHERE later = 'beat ceiling') AS "beat ceiling" FROM (VALUES ('below floor'), ('within band'), ('beat ceiling')) v(v)
    LEFT JOIN (SELECT b1.verdict AS f, b2.verdict AS later FROM b1 JOIN b2 USING (entity)) x ON x.f = v.v GROUP BY 1""",
    "b1 b2",
)
def _(t):
    rows = t.spark.createDataFrame([(v,) for v in VERDICTS], "first string")
    counted = A.crosstab(both_verdicts(t), "first", "later", VERDICTS)
    return rows.join(counted, "first", "left").fillna(0)


@query(
    "sta42_reversals_by_band",
    """SELECT CASE WHEN slot <= 14 THEN '1-14' WHEN slot <= 30 THEN '15-30' ELSE '31 and later' END AS band, count(*) AS n, avg((r2 > r1)::INT) AS late_bloomer,
      avg((r2 < r1)::INT) AS late_bust, avg((r2 = r1)::INT) AS same FROM (
      SELECT b1.slot, CASE b1.verdict WHEN 'below floor' THEN 0 WHEN 'within band' THEN 1 ELSE 2 END AS r1,
        CASE b2.verdict WHEN 'below floor' THEN 0 WHEN 'within band' THEN 1 ELSE 2 END AS r2 FROM b1 JOIN b2 USING (entity)) GROUP BY 1""",
    "b1 b2", rnd="late_bloomer late_bust same",
)
def _(t):
    place = F.array(*[F.lit(v) for v in VERDICTS])
    move = F.array_position(place, k("later")) - F.array_position(place, k("first"))
    band = F.when(k("slot") <= 14, "1-14").when(k("slot") <= 30, "15-30").otherwise("31 and later")
    d = both_verdicts(t).select(band.alias("band"), move.alias("move"))
    return d.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), A.share(k("move") > 0).alias("late_bloomer"), A.share(k("move") < 0).alias("late_bust"), A.share(k("move") == 0).alias("same"))


RECRUIT_SQL = """CASE WHEN 2 * slot - 1 <= 10 THEN 'RSCI 1-10' WHEN 2 * slot - 1 <= 25 THEN 'RSCI 11-25' WHEN 2 * slot - 1 <= 50 THEN 'RSCI 26-50' ELSE 'Unranked' END"""


def recruits(t):
    p = with_pit(t).withColumn("grp", B.recruit_group(F.when(2 * k("slot") - 1 <= 50, 2 * k("slot") - 1)))
    both = F.array(F.lit("all"), F.when(k("slot") <= 30, "first round"))
    return p.withColumn("scope", F.explode(both)).where(k("scope").isNotNull())


@query(
    "sta43_recruit_rank_groups",
    f"""SELECT scope, grp, n, mean_pit, lo, hi, beat FROM (SELECT scope, grp, count(*) AS n, avg(pit) AS mean_pit, avg((pit > 0.5)::INT) AS beat FROM r GROUP BY 1, 2)
    JOIN (SELECT scope, grp, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT scope, grp, rep, sum(w * pit) / sum(w) AS m
      FROM (SELECT *, {RS.weight_sql('entity', 'rep')} AS w FROM r, range(1, {REPS + 1}) x(rep)) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (scope, grp)""",
    "r", rnd="mean_pit lo hi beat", places=7,
)
def _(t):
    d = recruits(t).withColumn("beat", (k("pit") > 0.5).cast("double"))
    out = RS.bootstrap_mean(d, "entity", ["pit", "beat"], ["scope", "grp"], REPS)
    return out.select("scope", "grp", "n", k("pit").alias("mean_pit"), k("pit_lo").alias("lo"), k("pit_hi").alias("hi"), "beat")


CTES["r"] = (f"SELECT *, {RECRUIT_SQL} AS grp, 'all' AS scope FROM cpit UNION ALL SELECT *, {RECRUIT_SQL}, 'first round' FROM cpit WHERE slot <= 30", ["cpit"])


@query(
    "sta43_recruit_rank_trend",
    """SELECT scope, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT scope, rank() OVER (PARTITION BY scope ORDER BY grp) + (count(*) OVER (PARTITION BY scope, grp) - 1) / 2 AS rx,
      rank() OVER (PARTITION BY scope ORDER BY round(pit, 9)) + (count(*) OVER (PARTITION BY scope, round(pit, 9)) - 1) / 2 AS ry FROM r) GROUP BY 1""",
    "r", rnd="rho", places=6,
)
def _(t):
    d = recruits(t).withColumns({"pit": F.round("pit", 9), "order": B.digitize(2 * k("slot") - 1, B.RECRUIT_EDGES[1:4], True)})
    return AS.spearman(d, "order", "pit", ["scope"]).select("scope", "rho", "n")


# ------------------------------------------------------------------ curves and class strength


def typical_curve(t):
    """(slot, typical, average): pooled medians and means, never rising with the slot."""
    return t.stage("typical_curve", lambda: _typical_curve(t))


def _typical_curve(t):
    c = t.stage("slot_curve", lambda: slot_curve(t.tgt))
    long = c.select("slot", F.col("median").alias("typical"), F.col("mean").alias("average")).unpivot(["slot"], ["typical", "average"], "kind", "v")
    fit = MO.decreasing_fit(long, "slot", "v", ["kind"])
    return fit.groupBy("slot").agg(*[F.max(F.when(k("kind") == c, k("fit"))).alias(c) for c in ("typical", "average")])


CTES["pooled_"] = (
    """SELECT c.slot, median(t.y) AS median, avg(t.y) AS mean FROM (SELECT DISTINCT slot FROM tgt) c
    JOIN tgt t ON abs(t.slot - c.slot) <= round_even(c.slot * 0.2, 0) AND t.y IS NOT NULL GROUP BY 1""",
    ["tgt"],
)
CTES["means_"] = (
    """SELECT a.slot AS a, b.slot AS b, avg(c.median) AS m, avg(c.mean) AS av FROM pooled_ a JOIN pooled_ b ON a.slot <= b.slot
    JOIN pooled_ c ON c.slot BETWEEN a.slot AND b.slot GROUP BY 1, 2""",
    ["pooled_"],
)
CTES["curve"] = (
    """SELECT slot, min(m) AS typical, min(av) AS average FROM (SELECT p.slot, x.a, max(x.m) AS m, max(x.av) AS av FROM pooled_ p
      JOIN means_ x ON x.a <= p.slot AND x.b >= p.slot GROUP BY 1, 2) GROUP BY 1""",
    ["means_"],
)


@query(
    "sta44_isotonic_curve",
    "SELECT slot, typical, average, 100 * average / first_value(average) OVER (ORDER BY slot) AS value FROM curve",
    "curve", ints="slot", rnd="typical average value", places=7,
)
def _(t):
    c = typical_curve(t)
    return c.withColumn("value", 100 * k("average") / c.agg(F.min_by("average", "slot")).scalar())


def equivalent_slot(rows, value, curve, last):
    """Earliest slot whose typical value is not above `value`; null at or below the last slot's."""
    d = MO.first_at_most(rows, value, curve, "slot", "typical", "_hit")
    floor = curve.agg(F.max_by("typical", "slot")).scalar()
    return d.withColumn("eq_slot", F.when(k(value) > floor + 1e-9, F.coalesce("_hit", F.lit(last)))).drop("_hit")


@query(
    "sta45_equivalent_slot",
    """SELECT entity, CASE WHEN v > (SELECT typical FROM curve ORDER BY slot DESC LIMIT 1) + 1e-9 THEN coalesce((SELECT min(slot) FROM curve WHERE round(typical, 7) <= v), 60) END AS eq_slot
    FROM (SELECT entity, y AS v FROM tgt WHERE y IS NOT NULL)""",
    "curve tgt", ints="eq_slot",
)
def _(t):
    c = typical_curve(t).withColumn("typical", F.round("typical", 7))
    return equivalent_slot(t.tgt.where(k("y").isNotNull()), "y", c, 60).select("entity", "eq_slot")


EXPECTED_SQL = "0.95 * list_avg(grid) + 0.025 * grid[1] + 0.025 * (grid[19] + grid[19] - grid[18])"


@query("sta46_expected_value", f"SELECT entity, {EXPECTED_SQL} AS expected FROM cp", "cp", rnd="expected", places=7)
def _(t):
    return t.slot_predictions(True).select("entity", G.expected_value("grid").alias("expected"))


def class_strength(rows, curve, expected, tier_star):
    """One row per cohort: value over an average class, stars, best entity, rank."""
    d = rows.join(curve.select("slot", "average"), "slot").withColumn("over", k(expected) - k("average"))
    g = d.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("picks"), F.sum("over").alias("strength"),
        F.sum(F.when(k("slot") <= 14, k("over")).otherwise(0.0)).alias("lottery"),
        F.sum(F.when(k("slot") > 14, k("over")).otherwise(0.0)).alias("later"),
        F.count_if(tier_star).alias("stars"), A.share(k("finished")).alias("finished_share"),
        A.best_row("y", "entity", "entity").alias("best"),
    )
    top = A.top_sum(rows, ["cohort"], "y", "entity", 5, "top5")
    g = g.join(top, "cohort").withColumn("provisional", k("finished_share") < 0.9)
    return RK.with_ranks(g.withColumn("strength", F.round("strength", 7)), "strength", descending=True, min_rank="rank")


@query(
    "sta47_class_strength",
    f"""SELECT *, rank() OVER (ORDER BY strength DESC) AS rank FROM (SELECT cohort, count(*) AS picks, round(sum(over_), 7) AS strength,
      sum(CASE WHEN slot <= 14 THEN over_ ELSE 0 END) AS lottery, sum(CASE WHEN slot > 14 THEN over_ ELSE 0 END) AS later,
      sum((y >= {STAR_CUT})::INT) AS stars, avg((cohort <= 1997)::INT) AS finished_share, avg((cohort <= 1997)::INT) < 0.9 AS provisional,
      first(entity ORDER BY y DESC, entity) AS best, any_value(top5) AS top5
    FROM (SELECT cp.*, {EXPECTED_SQL} - average AS over_ FROM cp JOIN curve USING (slot)) JOIN (SELECT cohort, sum(y) AS top5 FROM (
      SELECT cohort, y, row_number() OVER (PARTITION BY cohort ORDER BY y DESC, entity) AS rn FROM cp) WHERE rn <= 5 GROUP BY 1) USING (cohort) GROUP BY 1)""",
    "cp curve", ints="cohort picks stars rank", rnd="strength lottery later finished_share top5", places=6,
)
def _(t):
    p = t.slot_predictions(True).withColumns({"expected": G.expected_value("grid"), "finished": k("cohort") <= 1997})
    return class_strength(p, typical_curve(t), "expected", k("y") >= STAR_CUT)
