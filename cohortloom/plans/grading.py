"""Grades, trades and the questions users ask of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import grids as G
from ..functions import rates as R
from ..operators import aggregates as A
from ..operators import forecast as FC
from ..operators import grading as GD
from ..operators import groups as GR
from ..operators import joins as J
from ..operators import panel as P
from ..operators import ranking as RK
from ..operators import survival as SV
from ..operators.forecast import SlotModel
from .bindings import ALL_COHORTS, CTES, CUTS, FINAL_N, LAST, LEVELS_SQL, slot_model_ctes
from .cleaning import rankings
from .registry import query
from .similarity import comps, reasons, similarity_scores
from .statistics import VERDICT_SQL, cdf_sql, equivalent_slot, graded, pit_sql, recruits, typical_curve

k = F.col


def prior_model(horizon):
    return SlotModel(
        "cohort", "slot", "y", "entity", horizon, ALL_COHORTS, 60, adaptive=True, calib=1, min_fit=1,
        min_training=30, retrospective=True,
    )


def prior_grids(t, horizon=FINAL_N):
    """Every entity with its as-of grid of the peak through `horizon`, or a retrospective one."""

    def build():
        at = graded(t).where(k("n") == horizon).select("entity", k("peak").alias("y"))
        rows = t.ent.join(at, "entity", "left")
        m = prior_model(horizon)
        return m.predict(rows, m.fit(rows))

    return t.stage(f"priors_{horizon}", build)


BAND_YEARS = (1, 2, 3, 4, 5, 6)  # the oldest cohort has six periods
for _h in BAND_YEARS:
    CTES[f"yg{_h}"] = (f"SELECT ent.*, o.peak AS y FROM ent LEFT JOIN (SELECT entity, peak FROM graded WHERE n = {_h}) o USING (entity)", ["ent", "graded"])
    CTES.update(slot_model_ctes(f"gp{_h}", f"yg{_h}", _h, ALL_COHORTS, calib=1, min_fit=1, adaptive=True, min_training=30, retro=True))
    CTES[f"priors{_h}"] = (
        f"SELECT t.entity, t.cohort, t.slot, t.y, list_sort(g.grid) AS grid, r.retro FROM yg{_h} t JOIN gp{_h}_pred g ON g.fold = t.cohort AND g.slot = t.slot "
        f"JOIN (SELECT fold, bool_or(retro) AS retro FROM gp{_h}_roles GROUP BY 1) r ON r.fold = t.cohort",
        [f"yg{_h}", f"gp{_h}_pred", f"gp{_h}_roles"],
    )
_ROOT = "list_transform(grid, lambda v: sqrt(greatest(v, 0)))"
CTES["moments"] = (
    f"SELECT *, list_avg({_ROOT}) AS m0, greatest(list_stddev_pop({_ROOT}), 0.05) AS s0 FROM priors{FINAL_N}", [f"priors{FINAL_N}"],
)
CTES["meas"] = (
    f"""SELECT n, regr_intercept(o, f) AS a, regr_slope(o, f) AS b, greatest(sqrt((regr_syy(o, f) - regr_sxy(o, f) ** 2 / regr_sxx(o, f)) / (regr_count(o, f) - 2)), 1e-3) AS sigma
    FROM (SELECT x.n, sqrt(greatest(x.peak, 0)) AS o, sqrt(greatest(z.peak, 0)) AS f FROM graded x JOIN graded z USING (entity) WHERE z.n = {FINAL_N} AND x.n < {FINAL_N}) GROUP BY 1""",
    ["graded"],
)
CTES["state"] = (
    f"""SELECT e.entity, least(greatest({LAST} - cohort, 0), {FINAL_N}) AS seasons, coalesce(l <= {LAST - 2}, TRUE) AS retired, coalesce(o.stars, 0) AS stars, coalesce(o.leagues, 0) AS leagues
    FROM ent e LEFT JOIN (SELECT entity, max(period) AS l FROM vals GROUP BY 1) s USING (entity) LEFT JOIN (SELECT entity, stars, leagues FROM otn WHERE period = {LAST}) o USING (entity)""",
    ["ent", "vals", "otn"],
)


def post_sql(src: str) -> str:
    """Rows with (n, obs, m0, s0) joined to the measurement: posterior columns."""
    prec = "(1 / (s0 * s0) + b * b / (sigma * sigma))"
    return f"""(SELECT * EXCLUDE (a, b, sigma), round(CASE WHEN b IS NOT NULL AND obs IS NOT NULL THEN (m0 / (s0 * s0) + b * (sqrt(greatest(obs, 0)) - a) / (sigma * sigma)) / {prec} ELSE m0 END, 9) AS pm,
      CASE WHEN b IS NOT NULL AND obs IS NOT NULL THEN sqrt(1 / {prec}) ELSE s0 END AS psd,
      CASE WHEN b IS NOT NULL AND obs IS NOT NULL THEN (b * b / (sigma * sigma)) / {prec} ELSE 0 END AS dw FROM {src} LEFT JOIN meas USING (n))"""


CTES["hist"] = (
    "SELECT * FROM " + post_sql(f"(SELECT m.entity, m.m0, m.s0, m.y AS final, g.n, g.peak AS obs FROM moments m JOIN graded g ON g.entity = m.entity AND g.n < {FINAL_N} WHERE m.y IS NOT NULL AND NOT m.retro)"),
    ["moments", "graded", "meas"],
)
CTES["edges"] = ("SELECT n, quantile_cont(pm, [0.2, 0.4, 0.6, 0.8]) AS edges FROM hist GROUP BY 1", ["hist"])
CTES["resid"] = (
    f"""SELECT n, bin, quantile_cont(round(sqrt(greatest(final, 0)) - pm, 9), {LEVELS_SQL}) AS rg FROM (
      SELECT h.*, len(list_filter(edges, lambda v: v <= pm)) AS bin FROM hist h JOIN edges USING (n)) GROUP BY 1, 2""",
    ["hist", "edges"],
)
_CAL = """list_transform(range(1, 20), lambda i: CASE WHEN i <= 5 AND n IN (1, 2, 3) THEN reached + (CASE n WHEN 3 THEN 0.85 ELSE 0.7 END) * (greatest(greatest(pm + rg[i], 0) ** 2, reached) - reached)
  ELSE greatest(greatest(pm + rg[i], 0) ** 2, reached) END)"""
CTES["graded_now"] = (
    f"""SELECT *, list_transform(range(1, 20), lambda i: greatest(CASE WHEN finished THEN greatest(peak_so_far, 0) WHEN seasons = 0 THEN grid[i] ELSE cal[i] END, reached)) AS post FROM (
      SELECT d.*, {_CAL} AS cal FROM (SELECT d.*, len(list_filter(edges, lambda v: v <= pm)) AS bin FROM (
        SELECT *, seasons >= {FINAL_N} OR (retired AND seasons > 0) AS finished, coalesce(peak_so_far, 0) AS reached FROM {post_sql(
            '(SELECT m.*, s.* EXCLUDE (entity), s.seasons AS n, g.peak AS obs, g.peak AS peak_so_far FROM moments m JOIN state s ON s.entity = m.entity LEFT JOIN graded g ON g.entity = m.entity AND g.n = s.seasons)')}) d
        LEFT JOIN edges USING (n)) d LEFT JOIN resid USING (n, bin))""",
    ["moments", "state", "graded", "meas", "edges", "resid"],
)


def state(t):
    c = SV.careers(t.ent.select("entity", "cohort"), t.vals.select("entity", "period"), "entity", "cohort", "period", LAST)
    c = t.ent.select("entity", "cohort").join(c.select("entity", "ended"), "entity", "left")
    won = t.otn.where(k("period") == LAST).select("entity", "stars", "leagues", "solids")
    s = c.join(won, "entity", "left").fillna(0, ["stars", "leagues", "solids"])
    return s.select(
        "entity", F.least(F.greatest(F.lit(LAST) - k("cohort"), F.lit(0)), F.lit(FINAL_N)).alias("seasons"),
        F.coalesce("ended", F.lit(True)).alias("retired"), "stars", "leagues",
        k("solids").alias("first_team"), F.when(k("stars") >= 4, 1).otherwise(0).alias("mvps"), F.lit(0).alias("finals"),
    )


def grades(t):
    def build():
        p = prior_grids(t).select("entity", "grid", "retrospective", k("y").alias("final"))
        g = GD.grade_table(p, graded(t).select("entity", "n", "peak"), state(t), CUTS, FINAL_N)
        who = t.ent.select("entity", "cohort", "slot", "position", "franchise", "name")
        g = who.join(g, "entity")
        return g.withColumn("value_vs_slot", F.round(k("current_median") - k("projected_median"), 6))

    return t.stage("grades", build)


def moments(t):
    return GD.prior_moments(prior_grids(t))


def measured(t):
    return t.stage("measurement", lambda: GD.measurement(graded(t).select("entity", "n", "peak"), FINAL_N))


@query("grd1_asof_prior_grids", f"SELECT entity, grid[5] AS floor, grid[10] AS median, grid[18] AS ceiling, retro FROM priors{FINAL_N}", f"priors{FINAL_N}", rnd="floor median ceiling")
def _(t):
    p = prior_grids(t)
    return p.select("entity", G.at_level("grid", 0.25).alias("floor"), G.at_level("grid", 0.5).alias("median"), G.at_level("grid", 0.9).alias("ceiling"), k("retrospective").alias("retro"))


@query("grd2_prior_moments", "SELECT entity, m0, s0 FROM moments", "moments", rnd="m0 s0", places=8)
def _(t):
    return moments(t).select("entity", "m0", "s0")


@query("grd3_measurement_model", "SELECT n, a, b, sigma FROM meas", "meas", ints="n", rnd="a b sigma", places=8)
def _(t):
    return measured(t)


@query("grd4_normal_update", "SELECT entity, n, pm AS post_mean, psd AS post_sd, dw AS data_weight FROM hist", "hist", ints="n", rnd="post_mean post_sd data_weight", places=7)
def _(t):
    known = moments(t).where(k("y").isNotNull() & ~k("retrospective")).select("entity", "m0", "s0")
    obs = graded(t).where(k("n") < FINAL_N).select("entity", "n", k("peak").alias("obs"))
    return GD.updated(known.join(obs, "entity"), measured(t)).select("entity", "n", "post_mean", "post_sd", "data_weight")


def history(t):
    def build():
        known = moments(t).where(k("y").isNotNull() & ~k("retrospective")).select("entity", "m0", "s0", k("y").alias("final"))
        obs = graded(t).where(k("n") < FINAL_N).select("entity", "n", k("peak").alias("obs"))
        return GD.updated(known.join(obs, "entity"), measured(t))

    return t.stage("grade_history", build)


@query("grd5_error_calibration", "SELECT n, bin, rg[1] AS q05, rg[10] AS q50, rg[19] AS q95 FROM resid", "resid", ints="n bin", rnd="q05 q50 q95", places=8)
def _(t):
    _, resid = GD.calibration(history(t))
    return resid.select("n", "bin", k("resid_grid")[0].alias("q05"), k("resid_grid")[9].alias("q50"), k("resid_grid")[18].alias("q95"))


@query(
    "grd6_floor_shrink",
    "SELECT entity, post[1] AS q05, post[5] AS q25, post[10] AS q50 FROM graded_now WHERE NOT finished AND seasons > 0",
    "graded_now", rnd="q05 q25 q50", places=7,
)
def _(t):
    g = grades(t).where(~k("finished") & (k("seasons") > 0))
    return g.select("entity", k("post_grid")[0].alias("q05"), k("post_grid")[4].alias("q25"), k("post_grid")[9].alias("q50"))


GRADE_SQL = f"""SELECT entity, CASE WHEN seasons = 0 THEN '-' WHEN pit >= 0.9 THEN 'A' WHEN pit >= 0.5 THEN 'B' WHEN pit >= 0.25 THEN 'C' ELSE 'D' END AS grade FROM {pit_sql('(SELECT *, post[10] AS cm FROM graded_now)', 'cm')}"""


@query("grd7_grade_letter", GRADE_SQL, "graded_now")
def _(t):
    return grades(t).select("entity", "grade")


_TIER = "['Out of league', 'Bust', 'Rotation', 'Starter', 'All-Star', 'All-NBA']"


@query(
    "grd8_grade_table",
    f"""SELECT entity, seasons, CASE WHEN retired AND seasons > 0 THEN 'Career Grade (retired)' WHEN seasons = 0 THEN 'Projection' WHEN seasons = 1 THEN 'Provisional (low confidence)'
        WHEN seasons <= 3 THEN 'Provisional (medium confidence)' ELSE 'Career Grade' END AS status, CASE WHEN retro THEN 'retrospective' ELSE 'as of draft night' END AS projection_type,
      grid[10] AS projected_median, post[5] AS current_floor, post[10] AS current_median, post[18] AS current_ceiling, CASE WHEN finished THEN 1 ELSE dw END AS data_weight,
      1 - least(greatest((CASE WHEN finished THEN 0 ELSE psd END) / s0, 0), 1) AS confidence,
      {_TIER}[1 + CASE WHEN finished THEN least(ti, CASE WHEN leagues >= 1 THEN 5 WHEN stars >= 1 THEN 4 ELSE 3 END) ELSE ti END] AS tier
    FROM (SELECT *, len(list_filter({CUTS}, lambda v: v <= post[10])) AS ti FROM graded_now)""",
    "graded_now", ints="seasons", rnd="projected_median current_floor current_median current_ceiling data_weight confidence", places=7,
)
def _(t):
    g = grades(t)
    return g.select(
        "entity", "seasons", "status", "projection_type", "projected_median", "current_floor", "current_median", "current_ceiling",
        "data_weight", "confidence", B.tier_name("current_tier_idx").alias("tier"),
    )


@query("grd9_validation_by_n")
def _(t):
    """Held-out score and coverage with 0..3 periods played, normal against calibrated grids."""
    fit_last, p = 1995, prior_grids(t)
    peaks = graded(t).select("entity", "cohort", "n", "peak")
    meas = GD.measurement(peaks.where(k("cohort") <= fit_last), FINAL_N)
    known = GD.prior_moments(p).where(k("y").isNotNull()).select("entity", "cohort", "grid", "m0", "s0", k("y").alias("final"))
    obs = peaks.where(k("n") < FINAL_N).select("entity", "n", k("peak").alias("obs"))
    zero = known.withColumns({"n": F.lit(0), "obs": F.lit(None).cast("double")})
    rows = known.join(obs, "entity").select(*zero.columns).unionByName(zero)
    d = t.stage("validation_rows", lambda: GD.updated(rows, meas))
    edges, resid = GD.calibration(d.where((k("cohort") <= fit_last) & (k("n") > 0)))
    test = d.where(k("cohort") > fit_last).withColumn("reached", F.coalesce("obs", F.lit(0.0)))
    test = GD.calibrated_grid(test, edges, resid, "reached")
    cal = F.when(k("n") == 0, k("grid")).otherwise(k("cal_grid"))
    both = F.array(
        F.struct(F.lit("normal").alias("quantiles"), FC.normal_grid(k("post_mean"), k("post_sd")).alias("q")),
        F.struct(F.lit("calibrated").alias("quantiles"), cal.alias("q")),
    )
    long = test.select("n", "final", "data_weight", F.explode(both).alias("_b")).select("n", "final", "data_weight", "_b.quantiles", "_b.q")
    floor, ceiling = G.at_level("q", G.FLOOR), G.at_level("q", G.CEILING)
    return long.groupBy("n", "quantiles").agg(
        F.count(F.lit(1)).alias("rows_n"), F.round(F.avg("data_weight"), 6).alias("data_weight"),
        F.round(F.avg(G.crps("final", "q")), 6).alias("crps"), F.round(A.share(k("final") < floor), 6).alias("below_floor"),
        F.round(A.share(k("final") <= floor), 6).alias("at_or_below_floor"), F.round(A.share(k("final") > ceiling), 6).alias("above_ceiling"),
    )


@query(
    "grd10_trajectory_bands",
    " UNION ALL ".join(f"SELECT entity, {h} AS n, grid[5] AS floor, grid[10] AS median, grid[18] AS ceiling FROM priors{h}" for h in BAND_YEARS),
    " ".join(f"priors{h}" for h in BAND_YEARS), ints="n", rnd="floor median ceiling",
)
def _(t):
    out = None
    for h in BAND_YEARS:
        p = prior_grids(t, h).select(
            "entity", F.lit(h).alias("n"), G.at_level("grid", 0.25).alias("floor"), G.at_level("grid", 0.5).alias("median"), G.at_level("grid", 0.9).alias("ceiling")
        )
        out = p if out is None else out.unionByName(p)
    return out


TRACK_SQL = f"""SELECT entity, games, value, value * len / games AS pace, CASE WHEN games = 0 THEN 'no games yet' WHEN value * len / games > ceiling THEN 'pacing above ceiling'
  WHEN value * len / games < floor THEN 'pacing below floor' ELSE 'within range' END AS status FROM (
  SELECT p.entity, coalesce(v.games, 0) AS games, v.value, grid[5] * 3 AS floor, grid[18] * 3 AS ceiling, l.len FROM priors1 p LEFT JOIN (SELECT * FROM vals WHERE period = {LAST}) v USING (entity),
  (SELECT max(games) AS len FROM seasons WHERE period = {LAST}) l WHERE p.cohort = {LAST - 1})"""


@query("grd11_live_tracker", TRACK_SQL, "priors1 vals seasons", rnd="games value pace")
def _(t):
    from ..streaming.refresh import tracker

    band = prior_grids(t, 1).where(k("cohort") == LAST - 1).select(
        "entity", (G.at_level("grid", 0.25) * 3).alias("floor"), (G.at_level("grid", 0.9) * 3).alias("ceiling")
    )
    now = t.vals.where(k("period") == LAST).select("entity", "games", "value")
    length = t.seasons.where(k("period") == LAST).agg(F.max("games")).scalar()
    return tracker(band, now, "entity", length)


# ----------------------------------------------------------------------------------- trades

TRADE_ASSETS = """(SELECT l_orderkey AS key, CASE WHEN l_linestatus = 'F' THEN 'sent' ELSE 'received' END AS side, l_partkey AS asset,
  year(o_orderdate) + (month(o_orderdate) >= 6)::INT AS first FROM (SELECT DISTINCT l_orderkey, l_linestatus, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)"""


def trades(t):
    o = t.orders.select(
        k("o_orderkey").alias("key"), F.concat(F.lit("T"), (k("o_custkey") % 30).cast("string")).alias("team_from"),
        F.concat(F.lit("T"), (k("o_custkey") % 29 + 30).cast("string")).alias("team_to"),
        (k("o_orderpriority") == "5-LOW").alias("complex"), (k("o_orderstatus") == "P").alias("unresolved"),
        (F.year("o_orderdate") + (F.month("o_orderdate") >= 6).cast("int")).alias("first"),
    )
    lines = t.lineitem.select("l_orderkey", "l_linestatus", "l_partkey").distinct()
    a = lines.select(
        k("l_orderkey").alias("key"), F.when(k("l_linestatus") == "F", "sent").otherwise("received").alias("side"), k("l_partkey").alias("asset")
    )
    a = a.join(o.select("key", "first"), "key").join(t.ent.select(k("entity").alias("asset"), "slot"), "asset")
    return o.drop("first"), a.withColumn("known", F.lit(True))


def scored_trades(t):
    def build():
        tr, assets = trades(t)
        values = t.vals.select(k("entity").alias("asset"), "period", (k("value") + k("value_extra")).alias("v"))
        return GD.score_trades(tr, assets, GD.post_trade_peaks(assets, values, "asset", "first", "period", "v"))

    return t.stage("trades", build)


CTES["asset_peaks"] = (
    f"""SELECT asset, first, max(tr) AS peak FROM (SELECT asset, first, sum(v) OVER (PARTITION BY asset, first ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 3 AS tr
      FROM (SELECT DISTINCT asset, first FROM {TRADE_ASSETS}) JOIN (SELECT entity, period, value + value_extra AS v FROM vals) ON entity = asset AND period >= first) GROUP BY 1, 2""",
    ["vals"],
)
CTES["trade_rows"] = (
    f"""SELECT key, CASE WHEN tb THEN team_to ELSE team_from END AS buyer, CASE WHEN tb THEN team_from ELSE team_to END AS seller, CASE WHEN tb THEN ss ELSE sr END AS top_slot,
      CASE WHEN tb THEN vs ELSE vr END AS value_got, CASE WHEN tb THEN vr ELSE vs END AS value_gave, CASE WHEN tb THEN round(vs - vr, 6) ELSE round(vr - vs, 6) END AS diff,
      CASE WHEN cx THEN 'complex (not scored)' WHEN un OR NOT ret THEN 'incomplete (unknown assets)' WHEN CASE WHEN tb THEN round(vs - vr, 6) ELSE round(vr - vs, 6) END > 0.25 THEN 'worth it'
        WHEN CASE WHEN tb THEN round(vs - vr, 6) ELSE round(vr - vs, 6) END < -0.25 THEN 'not worth it' ELSE 'even' END AS verdict
    FROM (SELECT o_orderkey AS key, 'T' || (o_custkey % 30) AS team_from, 'T' || (o_custkey % 29 + 30) AS team_to, o_orderpriority = '5-LOW' AS cx, o_orderstatus = 'P' AS un,
      coalesce(ss, 1000000000) <= coalesce(sr, 1000000000) AS tb, ss, sr, vs, vr, ret FROM orders JOIN (
        SELECT key, sum(CASE WHEN side = 'sent' THEN coalesce(peak, 0) ELSE 0 END) AS vs, sum(CASE WHEN side = 'received' THEN coalesce(peak, 0) ELSE 0 END) AS vr,
          min(CASE WHEN side = 'sent' THEN slot END) AS ss, min(CASE WHEN side = 'received' THEN slot END) AS sr, bool_or(side = 'received') AS ret
        FROM {TRADE_ASSETS} JOIN ent ON entity = asset LEFT JOIN asset_peaks USING (asset, first) GROUP BY 1) ON key = o_orderkey)""",
    ["ent", "asset_peaks"],
)


@query("grd13_trade_scoring", "SELECT * FROM trade_rows", "trade_rows", ints="top_slot", rnd="value_got value_gave diff", places=7)
def _(t):
    return scored_trades(t)


# -------------------------------------------------------------------------- entity metrics

CTES["paid"] = (
    """SELECT entity, cohort, period, period - cohort AS n, value, minutes, games, starts, value_extra, CASE WHEN (entity + period) % 5 <> 0 THEN ((entity * 31 + period * 17) % 1000) / 5000.0 END AS pct
    FROM vals""",
    ["vals"],
)


def paid(t):
    pct = F.when((k("entity") + k("period")) % 5 != 0, ((k("entity") * 31 + k("period") * 17) % 1000) / 5000.0)
    cols = ["entity", "cohort", "period", "value", "minutes", "games", "starts", "value_extra"]
    return t.vals.select(*cols, (k("period") - k("cohort")).alias("n"), pct.alias("pct"))


CTES["surplus_q"] = (
    """SELECT entity, sum(greatest(a + b * greatest(value, 0), fl) - coalesce(pct, pf)) AS surplus FROM paid JOIN (SELECT period, quantile_cont(pct, 0.05) AS pf FROM paid GROUP BY 1) USING (period),
      (SELECT regr_intercept(pct, greatest(value, 0)) AS a, regr_slope(pct, greatest(value, 0)) AS b FROM paid WHERE n >= 3 AND pct IS NOT NULL), (SELECT quantile_cont(pct, 0.05) AS fl FROM paid)
    WHERE n BETWEEN 1 AND 2 GROUP BY 1""",
    ["paid"],
)


@query("grd14_rookie_surplus", "SELECT * FROM surplus_q", "surplus_q", rnd="surplus", places=8)
def _(t):
    return surplus(t)


def surplus(t):
    d = paid(t)
    x = F.greatest(k("value"), F.lit(0.0))
    reg = A.regression(k("pct"), x)
    market = d.where((k("n") >= 3) & k("pct").isNotNull()).agg(F.struct(reg["a"].alias("a"), reg["b"].alias("b"))).scalar()
    low = RK.quantile_rows(d, "pct", [0.05]).select("quantile").scalar()
    per = RK.quantile_rows(d, "pct", [0.05], ["period"]).select("period", k("quantile").alias("pf"))
    rk = d.where(k("n").between(1, 2)).join(per, "period").withColumns({"_m": market, "_fl": low})
    price = F.greatest(k("_m.a") + k("_m.b") * x, k("_fl"))
    return rk.groupBy("entity").agg(F.sum(price - F.coalesce("pct", "pf")).alias("surplus"))


CTES["late_q"] = (
    "SELECT entity, r / (SELECT stddev_samp(f - (a + b * o)) FROM bl, reg) AS late FROM (SELECT entity, f - (a + b * o) AS r FROM bl, reg)",
    ["bl", "reg"],
)


@query("grd15_late_bloomer", "SELECT * FROM late_q", "late_q", rnd="late", places=7)
def _(t):
    return late_bloomers(t)


def late_bloomers(t):
    """Standardised residual of the final peak on an early one, for entities active early enough."""
    p = J.pivot_first(t.otn.where("n <= 4"), ["entity"], "n", "peak", [2, 4])
    early = t.vals.where((k("period") - k("cohort")).between(1, 2)).groupBy("entity").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    d = p.join(early, "entity", "left_semi").select("entity", R.to_sqrt("2").alias("o"), R.to_sqrt("4").alias("f")).dropna()
    reg = A.regression(k("f"), k("o"))
    fit = d.agg(F.struct(reg["a"].alias("a"), reg["b"].alias("b"))).scalar()
    d = d.withColumn("_m", fit).withColumn("r", k("f") - (k("_m.a") + k("_m.b") * k("o")))
    return d.withColumn("_s", d.agg(F.stddev_samp("r")).scalar()).select("entity", (k("r") / k("_s")).alias("late"))


CTES["bl"] = (
    """SELECT entity, o, f FROM (SELECT entity, sqrt(greatest(max(CASE WHEN n = 2 THEN peak END), 0)) AS o, sqrt(greatest(max(CASE WHEN n = 4 THEN peak END), 0)) AS f FROM otn GROUP BY 1
      HAVING max(CASE WHEN n = 4 THEN peak END) IS NOT NULL) WHERE entity IN (SELECT entity FROM vals WHERE period - cohort BETWEEN 1 AND 2 GROUP BY 1 HAVING count(*) >= 2)""",
    ["otn", "vals"],
)
CTES["reg"] = ("SELECT regr_intercept(f, o) AS a, regr_slope(f, o) AS b FROM bl", ["bl"])


CTES["extras_q"] = (
    """SELECT e.entity, raw * w / (w + 1000) AS riser, sc.pct AS second, sc.pct - sm.smooth AS second_vs_slot, coalesce(du.rot, 0) AS rotation, du.avail FROM ent e
    LEFT JOIN (SELECT entity, sum((value_extra - value / 10) * minutes) / sum(minutes) AS raw, sum(minutes) AS w FROM paid WHERE value_extra > 0 GROUP BY 1 HAVING sum(minutes) >= 300) r ON r.entity = e.entity
    LEFT JOIN sc ON sc.entity = e.entity LEFT JOIN (SELECT slot, avg(m) OVER (ORDER BY slot ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM (
      SELECT slot, avg(pct) AS m FROM sc JOIN ent USING (entity) GROUP BY 1)) sm ON sm.slot = e.slot
    LEFT JOIN (SELECT entity, sum((minutes >= 2000)::INT) AS rot, sum(starts) / sum(games) AS avail FROM paid GROUP BY 1) du ON du.entity = e.entity""",
    ["sc", "ent", "paid"],
)


@query(
    "grd15_riser_contract_durability", "SELECT * FROM extras_q", "extras_q", ints="rotation",
    rnd="riser second second_vs_slot avail", places=8,
)
def _(t):
    return extras(t)


def extras(t):
    from pyspark.sql import Window

    d = paid(t)
    up = k("value_extra") > 0
    w = F.sum(F.when(up, k("minutes")))
    per = d.groupBy("entity").agg(
        (F.sum(F.when(up, (k("value_extra") - k("value") / 10) * k("minutes"))) / w).alias("raw"), w.alias("w"),
        F.max(F.when(k("n").between(3, 4), k("pct"))).alias("second"),
        F.count_if(k("minutes") >= 2000).alias("rotation"), (F.sum("starts") / F.sum("games")).alias("avail"),
    )
    e = t.ent.select("entity", "slot").join(per, "entity", "left")
    slot = e.where(k("second").isNotNull()).groupBy("slot").agg(F.avg("second").alias("m"))
    smooth = slot.select("slot", F.avg("m").over(Window.partitionBy(F.lit(1)).orderBy("slot").rowsBetween(-2, 2)).alias("smooth"))
    riser = F.when(k("w") >= 300, k("raw") * k("w") / (k("w") + 1000))
    return e.join(smooth, "slot", "left").select(
        "entity", riser.alias("riser"), "second", (k("second") - k("smooth")).alias("second_vs_slot"),
        F.coalesce("rotation", F.lit(0)).alias("rotation"), "avail",
    )


CTES["sc"] = ("SELECT entity, max(pct) AS pct FROM paid WHERE n BETWEEN 3 AND 4 GROUP BY 1 HAVING max(pct) IS NOT NULL", ["paid"])


@query(
    "grd16_outcome_tables",
    """SELECT e.entity, coalesce(l.n, 0) AS n_observed, l.peak, l.total, s1.peak AS peak_n1, s2.peak AS peak_n2, l.composite FROM ent e
    LEFT JOIN (SELECT entity, max(n) AS n, arg_max(peak, n) AS peak, arg_max(total, n) AS total, arg_max(composite, n) AS composite FROM (SELECT * FROM otn JOIN comp USING (entity, n)) GROUP BY 1) l ON l.entity = e.entity
    LEFT JOIN otn s1 ON s1.entity = e.entity AND s1.n = 1 LEFT JOIN otn s2 ON s2.entity = e.entity AND s2.n = 2""",
    "ent comp", ints="n_observed", rnd="peak total peak_n1 peak_n2 composite",
)
def _(t):
    # Latest and snapshot columns come from one aggregate over the panel.
    per = t.composite.groupBy("entity").agg(
        F.max("n").alias("n_observed"), *[F.max_by(c, "n").alias(c) for c in ("peak", "total", "composite")],
        *[F.max(F.when(k("n") == i, k("peak"))).alias(f"peak_n{i}") for i in (1, 2)],
    )
    return t.ent.select("entity").join(per, "entity", "left").fillna(0, ["n_observed"])


from .relational import COMPOSITE  # noqa: E402

CTES["comp"] = (COMPOSITE, ["otn"])


@query(
    "grd17_projection_table",
    f"""SELECT entity, grid[5] AS floor, grid[10] AS median, grid[18] AS ceiling, 1 - c AS p_star FROM {cdf_sql('cp', str(CUTS[3]), 'c')}""",
    "cp", rnd="floor:11 median:11 ceiling:11 p_star:8",
)
def _(t):
    p = t.slot_predictions(True)
    tp = G.tier_probabilities("grid", CUTS)
    return p.select(
        "entity", G.at_level("grid", 0.25).alias("floor"), G.at_level("grid", 0.5).alias("median"), G.at_level("grid", 0.9).alias("ceiling"),
        (tp[4] + tp[5]).alias("p_star"),
    )


@query(
    "grd17_comps_table",
    """SELECT n.fold, n.id, n.rank, n.neighbour, n.y AS comp_y, x.similarity, w.why FROM near n JOIN similar_ x USING (fold, id, rank) JOIN reasons_ w USING (fold, id, rank)""",
    "near similar_ reasons_", ints="fold rank", rnd="comp_y similarity:1",
)
def _(t):
    """Comparable entities with outcome, similarity 0-100 and the features that agree most."""
    known = t.tgt.select(k("entity").alias("neighbour"), k("y").alias("comp_y"))
    near = comps(t).join(known, "neighbour").select("fold", "id", "rank", "neighbour", "comp_y")
    key = ["fold", "id", "rank"]
    return near.join(similarity_scores(t).select(*key, "similarity"), key).join(reasons(t), key)


@query(
    "grd18_coverage_by_class",
    """SELECT cohort, count(*) AS picks, avg((s.entity IS NOT NULL)::INT) AS seen, avg((st.entity IS NOT NULL)::INT) AS star FROM ent
    LEFT JOIN (SELECT DISTINCT entity FROM seasons) s USING (entity) LEFT JOIN (SELECT DISTINCT entity FROM seasons WHERE star) st USING (entity) GROUP BY 1""",
    "ent seasons", ints="cohort", rnd="seen star",
)
def _(t):
    e = J.with_flag(t.ent, t.seasons, ["entity"], "seen")
    e = J.with_flag(e, t.seasons.where("star"), ["entity"], "star")
    return e.groupBy("cohort").agg(F.count(F.lit(1)).alias("picks"), A.share(k("seen")).alias("seen"), A.share(k("star")).alias("star"))


# ---------------------------------------------------------------------------- user questions

NOW_COLUMNS = "SELECT *, round(post[10], 6) AS cur, round(post[10] - grid[10], 6) AS vs, round(grid[10], 6) AS projected FROM graded_now"
REDRAFT_SQL = f"""SELECT entity, cohort, slot, cur, redraft, slot - redraft AS moved FROM (SELECT *,
  row_number() OVER (PARTITION BY cohort ORDER BY cur DESC, slot, entity) AS redraft FROM ({NOW_COLUMNS}))"""
SLOT_KEY = 10**9  # slot first, then entity


def redraft(t):
    """Each class ordered anew by the current median, ties by slot; moved is spots gained."""
    d = now(t).select("entity", "cohort", "slot", "cur").withColumn("_tie", k("slot").cast("long") * SLOT_KEY + k("entity"))
    r = RK.with_position(d, "cur", "_tie", ["cohort"], name="redraft").drop("_tie")
    return r.withColumn("moved", k("slot") - k("redraft"))


@query("app1_redraft", REDRAFT_SQL, "graded_now", ints="cohort slot redraft moved", rnd="cur", places=6)
def _(t):
    return redraft(t)


NOW = f"(SELECT * FROM ({NOW_COLUMNS}) JOIN (SELECT entity, name, franchise, position FROM ent) USING (entity))"


def now(t):
    return grades(t).withColumns({"cur": F.round("current_median", 6), "vs": k("value_vs_slot"), "projected": F.round("projected_median", 6)})


CTES["metrics_"] = (
    f"""SELECT n.*, round(s.surplus, 6) AS surplus, round(l.late, 6) AS late, round(x.riser, 6) AS riser, round(x.second_vs_slot, 6) AS second_vs_slot,
      CAST(x.rotation AS DOUBLE) AS rotation, round(b.c, 6) AS bust FROM {NOW} n LEFT JOIN surplus_q s USING (entity) LEFT JOIN late_q l USING (entity)
    LEFT JOIN extras_q x USING (entity) LEFT JOIN (SELECT entity, c FROM {cdf_sql(f"priors{FINAL_N}", str(CUTS[1]), "c")}) b USING (entity)""",
    ["graded_now", "ent", "surplus_q", "late_q", "extras_q", f"priors{FINAL_N}"],
)


def metrics(t):
    """Grades with every metric that boards and rankings go by, rounded so that ties are ties."""
    x = extras(t).select("entity", "riser", "second_vs_slot", k("rotation").cast("double").alias("rotation"))
    bust = prior_grids(t).select("entity", G.cdf("grid", F.lit(CUTS[1])).alias("bust"))
    d = now(t)
    for part in (surplus(t), late_bloomers(t), x, bust):
        d = d.join(part, "entity", "left")
    return d.withColumns({c: F.round(c, 6) for c in ("surplus", "late", "riser", "second_vs_slot", "bust")})


RANK_BY = ["cur", "vs", "surplus", "second_vs_slot", "late", "riser", "rotation", "projected"]


@query(
    "app2_rankings",
    " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, entity, rank, {m} AS v FROM (SELECT *, row_number() OVER (ORDER BY {m} DESC, entity) AS rank FROM metrics_
      WHERE {m} IS NOT NULL AND cohort BETWEEN 1994 AND 1998 AND slot <= 30) WHERE contains(name, 'bolt')""" for m in RANK_BY),
    "metrics_", ints="rank", rnd="v", places=6,
)
def _(t):
    """Rank by any metric within the filters; the search keeps the rank."""
    d = t.stage("entity_metrics", lambda: metrics(t))
    out = None
    for m in RANK_BY:
        part = rankings(d, (1994, 1998), True, query="bolt", by=m).select(F.lit(m).alias("metric"), "entity", "rank", k(m).alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


BOARDS = {"bargains": "surplus", "late bloomers": "late", "playoff risers": "riser", "second contracts": "second_vs_slot",
          "durability": "rotation", "bust risk": "bust"}


@query(
    "app3_leaderboards",
    " UNION ALL ".join(
        f"(SELECT '{n}' AS board, {flip} AS reversed, entity, {c} AS v FROM metrics_ WHERE {c} IS NOT NULL ORDER BY {c} {'ASC' if flip else 'DESC'}, entity LIMIT 30)"
        for n, c in BOARDS.items() for flip in (False, True)),
    "metrics_", rnd="v", places=6,
)
def _(t):
    """Six boards of 30, best first and reversed."""
    d = t.stage("entity_metrics", lambda: metrics(t))
    out = None
    for name, col in BOARDS.items():
        for flip in (False, True):
            order = k(col) if flip else k(col).desc()
            part = d.where(k(col).isNotNull()).orderBy(order, "entity").limit(30).select(
                F.lit(name).alias("board"), F.lit(flip).alias("reversed"), "entity", k(col).alias("v"))
            out = part if out is None else out.unionByName(part)
    return out


GROUPINGS = ["franchise", "position", "cohort"]


@query(
    "app4_group_report",
    " UNION ALL ".join(
        f"""SELECT '{g}' AS grouping, grp, picks, vs_slot, se, vs_slot - 1.645 * se AS lo, vs_slot + 1.645 * se AS hi, good_share, stars, best, worst FROM (
      SELECT CAST({g} AS VARCHAR) AS grp, count(*) AS picks, avg(vs) - (SELECT avg(vs) FROM {NOW} WHERE finished) AS vs_slot, stddev_samp(vs) / sqrt(count(*)) AS se, avg((cur >= 2.0)::INT) AS good_share,
      sum((cur >= 2.8)::INT) AS stars, first(entity ORDER BY vs DESC, entity) AS best, first(entity ORDER BY vs, entity) AS worst FROM {NOW} WHERE finished GROUP BY 1 HAVING count(*) >= 5)"""
        for g in GROUPINGS),
    "graded_now", ints="stars", rnd="vs_slot se lo hi good_share", places=5,
)
def _(t):
    """Report cards by each grouping, with the 90 % interval."""
    d = now(t).where("finished")
    out = None
    for g in GROUPINGS:
        part = GR.group_report(d.withColumn("grp", k(g).cast("string")), "grp", "vs", "entity", k("cur") >= 2.0, k("cur") >= 2.8, min_rows=5)
        part = part.withColumn("grouping", F.lit(g))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "app5_steals_and_busts",
    f"""(SELECT 'steal' AS kind, entity, moved FROM ({REDRAFT_SQL}) ORDER BY moved DESC, cur DESC, entity LIMIT 25)
    UNION ALL (SELECT 'bust', entity, moved FROM ({REDRAFT_SQL}) ORDER BY moved, cur, entity LIMIT 25)""",
    "graded_now", ints="moved",
)
def _(t):
    r = redraft(t)
    best = r.orderBy(k("moved").desc(), k("cur").desc(), "entity").limit(25)
    worst = r.orderBy("moved", "cur", "entity").limit(25)
    cols = ["entity", "moved"]
    return best.select(F.lit("steal").alias("kind"), *cols).unionByName(worst.select(F.lit("bust").alias("kind"), *cols))


@query(
    "app6_trade_calculator",
    """WITH chart AS (SELECT slot, round(100 * average / first_value(average) OVER (ORDER BY slot), 6) AS value FROM curve),
    sides AS (SELECT l_orderkey AS key, round(sum(CASE WHEN l_linestatus = 'F' THEN value ELSE 0 END), 4) AS va,
      round(sum(CASE WHEN l_linestatus = 'O' THEN value ELSE 0 END), 4) AS vb
      FROM (SELECT DISTINCT l_orderkey, l_linestatus, p_size FROM lineitem JOIN part ON p_partkey = l_partkey) JOIN chart ON slot = p_size GROUP BY 1),
    gaps AS (SELECT *, round(abs(va - vb), 4) AS diff FROM sides)
    SELECT key, va, vb, diff, CASE WHEN diff = 0 THEN 'even' WHEN va > vb THEN 'A' ELSE 'B' END AS winner,
      (SELECT min(slot) FROM chart WHERE chart.value <= diff) AS worth_slot FROM gaps""",
    "curve", ints="worth_slot", rnd="va:4 vb:4 diff:4",
)
def _(t):
    """Value of both sides on the chart, the difference, the first slot it is worth, and who gives less."""
    curve = typical_curve(t)
    top = curve.orderBy("slot").limit(1).select("average").scalar()
    chart = curve.withColumn("_t", top).select("slot", F.round(100 * k("average") / k("_t"), 6).alias("value"))
    sides = t.lineitem.join(t.part.select(k("p_partkey").alias("l_partkey"), k("p_size").alias("slot")), "l_partkey")
    sides = sides.select(k("l_orderkey").alias("key"), "l_linestatus", "slot").distinct().join(chart, "slot")
    # Rounded before they are compared: equal sides are even in whatever order they were added.
    g = sides.groupBy("key").agg(
        F.round(F.sum(F.when(k("l_linestatus") == "F", k("value")).otherwise(0.0)), 4).alias("va"),
        F.round(F.sum(F.when(k("l_linestatus") == "O", k("value")).otherwise(0.0)), 4).alias("vb"),
    ).withColumn("diff", F.round(F.abs(k("va") - k("vb")), 4))
    packed = chart.agg(F.array_sort(F.collect_list(F.struct("slot", "value")))).scalar()  # one entry per slot
    worth = F.filter("_c", lambda s: s["value"] <= k("diff"))
    winner = F.when(k("diff") == 0, "even").when(k("va") > k("vb"), "A").otherwise("B")
    return g.withColumn("_c", packed).select(
        "key", "va", "vb", "diff", winner.alias("winner"), F.try_element_at(worth, F.lit(1))["slot"].alias("worth_slot")
    )


VERDICTS = ["worth it", "even", "not worth it"]


@query(
    "app7_trade_summary",
    """SELECT band, count(*) AS n, avg((verdict = 'worth it')::INT) AS worth, avg((verdict = 'even')::INT) AS even, avg((verdict = 'not worth it')::INT) AS bad FROM (
      SELECT *, CASE WHEN top_slot <= 5 THEN 'Picks 1-5' WHEN top_slot <= 14 THEN '6-14' WHEN top_slot <= 30 THEN '15-30' WHEN top_slot <= 60 THEN '2nd round' END AS band FROM trade_rows)
    WHERE verdict IN ('worth it', 'even', 'not worth it') AND band IS NOT NULL GROUP BY 1""",
    "trade_rows", rnd="worth even bad",
)
def _(t):
    tr = scored_trades(t).where(k("verdict").isin(*VERDICTS))
    tr = tr.withColumn("band", B.band("top_slot", [0, 5, 14, 30, 60], ["Picks 1-5", "6-14", "15-30", "2nd round"])).where("band is not null")
    return tr.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), *[A.share(k("verdict") == v).alias(n) for v, n in zip(VERDICTS, ("worth", "even", "bad"))]
    )


@query(
    "app7_best_and_worst_trades",
    """(SELECT 'best' AS list, key, diff FROM trade_rows WHERE verdict IN ('worth it', 'even', 'not worth it') ORDER BY diff DESC, key LIMIT 15)
    UNION ALL (SELECT 'worst', key, diff FROM trade_rows WHERE verdict IN ('worth it', 'even', 'not worth it') ORDER BY diff, key LIMIT 15)""",
    "trade_rows", rnd="diff", places=6,
)
def _(t):
    tr = scored_trades(t).where(k("verdict").isin(*VERDICTS)).select("key", "diff")
    best, worst = tr.orderBy(k("diff").desc(), "key").limit(15), tr.orderBy("diff", "key").limit(15)
    return best.select(F.lit("best").alias("list"), "key", "diff").unionByName(worst.select(F.lit("worst").alias("list"), "key", "diff"))


@query(
    "app8_compare_two",
    f"""SELECT a.franchise AS one, measure, x, y FROM (SELECT franchise, measure, x FROM (SELECT franchise, avg(cur) AS current, avg(vs) AS beat FROM {NOW} GROUP BY 1) UNPIVOT (x FOR measure IN (current, beat))) a
    JOIN (SELECT franchise, measure, x AS y FROM (SELECT franchise, avg(cur) AS current, avg(vs) AS beat FROM {NOW} GROUP BY 1) UNPIVOT (x FOR measure IN (current, beat))) b USING (measure)
    WHERE a.franchise = 'Brand#1' AND b.franchise = 'Brand#2'""",
    "graded_now", rnd="x y", places=6,
)
def _(t):
    g = now(t).where(k("franchise").isin("Brand#1", "Brand#2"))
    per = g.groupBy("franchise").agg(F.avg("cur").alias("current"), F.avg("vs").alias("beat"))
    long = per.unpivot(["franchise"], ["current", "beat"], "measure", "v")
    wide = J.pivot_first(long, ["measure"], "franchise", "v", ["Brand#1", "Brand#2"])
    return wide.select(F.lit("Brand#1").alias("one"), "measure", k("`Brand#1`").alias("x"), k("`Brand#2`").alias("y"))


@query(
    "app9_recruit_lists",
    f"""(SELECT 'unranked star' AS list, entity FROM {NOW} JOIN (SELECT entity AS e2, grp FROM r WHERE scope = 'all') ON e2 = entity WHERE grp = 'Unranked' ORDER BY cur DESC, entity LIMIT 15)
    UNION ALL (SELECT 'top recruit miss', entity FROM {NOW} JOIN (SELECT entity AS e2, grp, pit FROM r WHERE scope = 'all') ON e2 = entity WHERE grp = 'RSCI 1-10' ORDER BY round(pit, 7), entity LIMIT 15)""",
    "graded_now r",
)
def _(t):
    r = recruits(t).where("scope = 'all'").select("entity", "grp", F.round("pit", 7).alias("pit"))
    d = now(t).join(r, "entity")
    stars = d.where("grp = 'Unranked'").orderBy(k("cur").desc(), "entity").limit(15)
    miss = d.where("grp = 'RSCI 1-10'").orderBy("pit", "entity").limit(15)
    return stars.select(F.lit("unranked star").alias("list"), "entity").unionByName(miss.select(F.lit("top recruit miss").alias("list"), "entity"))


@query(
    "app10_never_active_rates",
    """SELECT cohort, status, n, n / picks AS share FROM (SELECT cohort, count(*) AS picks, sum((late)::INT) AS late, sum((NOT late)::INT) AS on_time, sum(never::INT) AS never FROM (
      SELECT e.cohort, coalesce(f > e.cohort + 1, TRUE) AS late, f IS NULL AS never FROM ent e LEFT JOIN (SELECT entity, min(period) AS f FROM seasons GROUP BY 1) USING (entity)) GROUP BY 1)
      UNPIVOT (n FOR status IN (late, on_time, never))""",
    "ent seasons", ints="cohort n", rnd="share",
)
def _(t):
    """Entities per class that started late (or never), on time, and never: counts and shares."""
    first = t.seasons.groupBy("entity").agg(F.min("period").alias("f"))
    d = t.ent.join(first, "entity", "left").withColumn("late", F.coalesce(k("f") > k("cohort") + 1, F.lit(True)))
    g = d.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("picks"), F.count_if("late").alias("late"), F.count_if(~k("late")).alias("on_time"),
        F.count_if(k("f").isNull()).alias("never"))
    long = g.unpivot(["cohort", "picks"], ["late", "on_time", "never"], "status", "n")
    return long.select("cohort", "status", "n", (k("n") / k("picks")).alias("share"))
