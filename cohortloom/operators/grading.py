"""Grades: a prior grid updated by what has been observed, calibrated on history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import grids as G
from ..functions.common import lookup
from ..functions.rates import to_sqrt
from . import forecast as FC
from .aggregates import regression
from .panel import with_rolling_peak
from .ranking import latest, quantile_grid

# How far early floors are pulled toward the value already reached.
FLOOR_SHRINK = {1: 0.7, 2: 0.7, 3: 0.85}


def measurement(peaks: DataFrame, final_n: int) -> DataFrame:
    """(n, a, b, sigma): peak so far on final peak, square-root scale, every n in one pass."""
    final = peaks.where(F.col("n") == final_n).select("entity", to_sqrt("peak").alias("_f"))
    rows = peaks.where(F.col("n") < final_n).select("entity", "n", to_sqrt("peak").alias("_o")).join(final, "entity")
    reg = regression(F.col("_o"), F.col("_f"))
    return rows.groupBy("n").agg(
        reg["a"].alias("a"), reg["b"].alias("b"), F.greatest(reg["sigma"], F.lit(1e-3)).alias("sigma")
    )


def prior_moments(priors: DataFrame) -> DataFrame:
    m, s = G.root_moments("grid")
    return priors.withColumns({"m0": m, "s0": s})


def updated(rows: DataFrame, meas: DataFrame) -> DataFrame:
    """Posterior mean (9 decimals), sd and data weight for rows with (n, obs, m0, s0)."""
    d = rows.join(meas, "n", "left")
    d = d.withColumns(FC.posterior(F.col("m0"), F.col("s0"), F.col("obs"), F.col("a"), F.col("b"), F.col("sigma")))
    return d.withColumn("post_mean", F.round("post_mean", 9)).drop("a", "b", "sigma")


def calibration(history: DataFrame, bins: int = 5) -> tuple[DataFrame, DataFrame]:
    """(edges per n, residual grid per n and bin) from rows with (n, post_mean, final)."""
    edges = quantile_grid(history, "post_mean", [i / bins for i in range(1, bins)], ["n"], "edges")
    d = history.join(edges, "n").withColumn("bin", B.bin_index("post_mean", F.col("edges")))
    d = d.withColumn("resid", F.round(to_sqrt("final") - F.col("post_mean"), 9))
    return edges, quantile_grid(d, "resid", G.LEVELS, ["n", "bin"], "resid_grid")


def calibrated_grid(rows: DataFrame, edges: DataFrame, resid: DataFrame, reached: str) -> DataFrame:
    """Grid from calibrated errors, never below what was reached, early floors pulled to it.

    Where history holds no errors for an n and bin, the normal grid stands in.
    """
    d = rows.join(edges, "n", "left").withColumn("bin", B.bin_index("post_mean", F.col("edges")))
    d = d.join(resid, ["n", "bin"], "left")
    shape = F.coalesce(
        FC.error_grid(F.col("post_mean"), F.col("resid_grid")), FC.normal_grid(F.col("post_mean"), F.col("post_sd"))
    )
    raw = G.clamp_below(shape, F.col(reached))
    pulled = G.shrink_floor(raw, reached, lookup("n", FLOOR_SHRINK))
    return d.withColumn("cal_grid", pulled).drop("edges", "bin", "resid_grid")


def grade_table(
    priors: DataFrame, peaks: DataFrame, state: DataFrame, cuts: list[float], final_n: int
) -> DataFrame:
    """One row per entity: prior and posterior summaries, tiers, letter, confidence.

    priors: entity, grid, retrospective, final (null until known); peaks: entity, n, peak; state:
    entity, seasons (0..final_n), retired, stars, leagues, first_team, mvps, finals.
    """
    meas = measurement(peaks, final_n)
    base = prior_moments(priors).join(state, "entity")
    known = base.where(F.col("final").isNotNull() & ~F.col("retrospective")).select("entity", "m0", "s0", "final")
    so_far = peaks.select("entity", "n", F.col("peak").alias("obs"))
    history = updated(known.join(so_far.where(F.col("n") < final_n), "entity"), meas)
    edges, resid = calibration(history)

    now = so_far.withColumnsRenamed({"n": "seasons", "obs": "peak_so_far"})
    d = base.join(now, ["entity", "seasons"], "left").withColumns({"n": F.col("seasons"), "obs": F.col("peak_so_far")})
    d = updated(d, meas)
    done = (F.col("seasons") >= final_n) | (F.col("retired") & (F.col("seasons") > 0))
    reached = F.coalesce("peak_so_far", F.lit(0.0))
    d = d.withColumns({"finished": done, "reached": reached})
    d = calibrated_grid(d, edges, resid, "reached")
    point = F.transform(G.levels_array(), lambda _: F.greatest(F.col("peak_so_far"), F.lit(0.0)))
    grid = F.when(F.col("finished"), point).when(F.col("seasons") == 0, F.col("grid")).otherwise(F.col("cal_grid"))
    d = d.withColumn("post_grid", G.clamp_below(grid, F.col("reached")))
    d = d.withColumns(
        {
            "post_sd": F.when(F.col("finished"), 0.0).otherwise(F.col("post_sd")),
            "data_weight": F.when(F.col("finished"), 1.0).otherwise(F.col("data_weight")),
        }
    )

    star = B.TIERS.index("All-Star")
    rotation = B.TIERS.index("Rotation")
    cols: dict[str, Column] = {}
    for kind, g in (("projected", "grid"), ("current", "post_grid")):
        tp = G.tier_probabilities(g, cuts)
        cols.update(
            {
                f"{kind}_floor": G.at_level(g, G.FLOOR), f"{kind}_median": G.at_level(g, G.MEDIAN),
                f"{kind}_ceiling": G.at_level(g, G.CEILING),
                f"{kind}_tier_idx": B.digitize(G.at_level(g, G.MEDIAN), cuts),
                f"{kind}_p_all_star": F.aggregate(F.slice(tp, star + 1, 6 - star), F.lit(0.0), lambda a, b: a + b),
                f"{kind}_p_bust": F.aggregate(F.slice(tp, 1, rotation), F.lit(0.0), lambda a, b: a + b),
            }
        )
    d = d.withColumns(cols)
    # A finished career is what it was: the top tiers need the selections.
    cap = F.when(F.col("leagues") >= 1, 5).when(F.col("stars") >= 1, 4).otherwise(3)
    idx = F.when(F.col("finished"), F.least("current_tier_idx", cap)).otherwise(F.col("current_tier_idx"))
    d = d.withColumn("current_tier_idx", idx)
    honour = B.honour(F.col("leagues"), F.col("first_team"), F.col("mvps"), F.col("finals"))
    letter = G.grade_letter(G.pit("grid", F.col("current_median")))
    return d.withColumns(
        {
            "current_p_all_star": F.when(F.col("finished"), (idx >= star).cast("double")).otherwise(F.col("current_p_all_star")),
            "current_p_bust": F.when(F.col("finished"), (idx < rotation).cast("double")).otherwise(F.col("current_p_bust")),
            "projected_tier": B.tier_name("projected_tier_idx"),
            "honour": honour,
            "current_tier": F.coalesce(honour, B.tier_name("current_tier_idx")),
            "status": B.career_status("seasons", "retired", final_n),
            "projection_type": F.when(F.col("retrospective"), "retrospective").otherwise("as of draft night"),
            "confidence": 1 - F.least(F.greatest(F.col("post_sd") / F.col("s0"), F.lit(0.0)), F.lit(1.0)),
            "grade": F.when(F.col("seasons") == 0, "-").otherwise(letter),
        }
    ).drop("n", "obs", "cal_grid", "reached")


def post_trade_peaks(assets: DataFrame, values: DataFrame, asset: str, first: str, period: str, value: str) -> DataFrame:
    """(asset, first, peak): best three-row stretch from period `first` on, once per distinct pair."""
    pairs = assets.select(asset, first).distinct()
    rows = pairs.join(values.select(asset, period, value), asset).where(F.col(period) >= F.col(first))
    rolled = with_rolling_peak(rows, value, [asset, first], period, "_peak")
    return latest(rolled, [asset, first], [F.col(period).desc()]).select(asset, first, F.col("_peak").alias("peak"))


def score_trades(trades: DataFrame, assets: DataFrame, peaks: DataFrame, even: float = 0.25) -> DataFrame:
    """Verdict per trade from the side that got the best slot.

    trades: key, team_from, team_to, complex, unresolved; assets: key, side ('sent' went to
    team_to, 'received' to team_from), asset, first, slot (null when not of this cohort), known.
    """
    a = assets.join(peaks, ["asset", "first"], "left").withColumn("peak", F.coalesce("peak", F.lit(0.0)))
    value = F.when(F.col("known"), F.col("peak")).otherwise(0.0)
    sent, got = F.col("side") == "sent", F.col("side") == "received"
    g = a.groupBy("key").agg(
        F.sum(F.when(sent, value).otherwise(0.0)).alias("v_sent"), F.sum(F.when(got, value).otherwise(0.0)).alias("v_received"),
        F.min(F.when(sent & F.col("known"), F.col("slot"))).alias("s_sent"),
        F.min(F.when(got & F.col("known"), F.col("slot"))).alias("s_received"),
        F.bool_and("known").alias("_known"), F.bool_or(got).alias("_return"),
    )
    d = trades.join(g, "key")
    to_buys = F.coalesce("s_sent", F.lit(10**9)) <= F.coalesce("s_received", F.lit(10**9))

    def side(x: str, y: str) -> Column:
        return F.when(to_buys, F.col(x)).otherwise(F.col(y))

    d = d.withColumns(
        {
            "buyer": side("team_to", "team_from"), "seller": side("team_from", "team_to"),
            "value_got": side("v_sent", "v_received"), "value_gave": side("v_received", "v_sent"),
            "top_slot": side("s_sent", "s_received"),
        }
    ).withColumn("diff", F.round(F.col("value_got") - F.col("value_gave"), 6))
    unknown = ~F.col("_known") | F.col("unresolved") | ~F.col("_return")
    verdict = (
        F.when(F.col("complex"), "complex (not scored)").when(unknown, "incomplete (unknown assets)")
        .when(F.col("diff") > even, "worth it").when(F.col("diff") < -even, "not worth it").otherwise("even")
    )
    return d.withColumn("verdict", verdict).select(
        "key", "buyer", "seller", "top_slot", "value_got", "value_gave", "diff", "verdict"
    )
