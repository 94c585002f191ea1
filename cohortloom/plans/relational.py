"""Joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import names as N
from ..functions import rates as R
from ..functions.common import ratio, true
from ..operators import aggregates as A
from ..operators import folds as FO
from ..operators import forecast as FC
from ..operators import joins as J
from ..operators import panel as P
from ..operators import ranking as RK
from .bindings import FOLDS, HORIZON, LAST, TRAIN_LAST
from .registry import query

k = F.col
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

# ------------------------------------------------------------------------------------ joins


@query(
    "jn1_inner_join",
    """SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    GROUP BY 1""",
    rnd="qty",
)
def _(t):
    # Quantities are summed per order first, so the join moves one row per order.
    per = t.lineitem.groupBy(k("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")
    )
    return per.join(t.orders, "o_orderkey").groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"))


@query(
    "jn2_left_join",
    """SELECT s.entity, s.period, s.a, t.n AS team_n FROM (SELECT s.*, franchise FROM seasons s JOIN ent USING (entity)) s
    LEFT JOIN (SELECT franchise, period, count(*) AS n FROM seasons JOIN ent USING (entity) WHERE a > 2 GROUP BY 1, 2) t
    ON t.franchise = s.franchise AND t.period = s.period""",
    "seasons ent", rnd="a", ints="period team_n",
)
def _(t):
    s = t.seasons.join(t.ent.select("entity", "franchise"), "entity")
    team = s.where("a > 2").groupBy("franchise", "period").agg(F.count(F.lit(1)).alias("team_n"))
    return s.join(team, ["franchise", "period"], "left").select("entity", "period", "a", "team_n")


@query(
    "jn3_lookup_join",
    "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def _(t):
    c = t.customer.withColumnRenamed("c_nationkey", "n_nationkey")
    c = J.lookup_join(c, t.nation, ["n_nationkey"], ["n_name", "n_regionkey"])
    c = J.lookup_join(c.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, ["r_regionkey"], ["r_name"])
    return c.select("c_custkey", "n_name", "r_name")


@query(
    "jn4_semi_join",
    "SELECT entity, period FROM seasons WHERE entity IN (SELECT entity FROM ent WHERE slot <= 5)",
    "seasons ent", ints="period",
)
def _(t):
    return t.seasons.join(t.ent.where("slot <= 5"), "entity", "left_semi").select("entity", "period")


@query(
    "jn5_membership_flags",
    """SELECT s.entity, s.period, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = s.entity AND year(l_shipdate) = s.period
      AND l_returnflag = 'R' AND l_quantity >= 45) AS won_a,
      EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = s.entity AND year(l_shipdate) = s.period
      AND l_returnflag = 'A' AND l_quantity >= 45) AS won_b FROM seasons s""",
    "seasons", ints="period",
)
def _(t):
    s = t.seasons.select("entity", "period")
    won = t.lineitem.where("l_quantity >= 45").select(
        k("l_partkey").alias("entity"), F.year("l_shipdate").alias("period"), "l_returnflag"
    )
    for flag, name in (("R", "won_a"), ("A", "won_b")):
        s = J.with_flag(s, won.where(k("l_returnflag") == flag), ["entity", "period"], name)
    return s


@query(
    "jn6_awards_wide",
    """SELECT s.entity, s.period, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS A,
      max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS N, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS R
    FROM seasons s LEFT JOIN lineitem ON l_partkey = s.entity AND year(l_shipdate) = s.period AND l_quantity >= 40 GROUP BY 1, 2""",
    "seasons", ints="period", rnd="A N R",
)
def _(t):
    rows = t.lineitem.where("l_quantity >= 40").select(
        k("l_partkey").alias("entity"), F.year("l_shipdate").alias("period"), "l_returnflag", "l_quantity"
    )
    wide = J.pivot_first(rows, ["entity", "period"], "l_returnflag", "l_quantity", ["A", "N", "R"])
    return t.seasons.select("entity", "period").join(wide, ["entity", "period"], "left")


@query(
    "jn7_feature_assembly",
    """SELECT e.entity, e.slot, l.a AS last_a, c.total_a, c.n, p.y FROM ent e
    LEFT JOIN (SELECT entity, arg_max(a, period) AS a FROM seasons GROUP BY 1) l ON l.entity = e.entity
    LEFT JOIN (SELECT entity, sum(a) AS total_a, count(*) AS n FROM seasons GROUP BY 1) c ON c.entity = e.entity
    LEFT JOIN tgt p ON p.entity = e.entity""",
    "seasons tgt", ints="slot n", rnd="last_a total_a y",
)
def _(t):
    # One aggregate feeds both blocks, so the wide row needs a single join per source table.
    blocks = t.seasons.groupBy("entity").agg(
        F.max_by("a", "period").alias("last_a"), F.sum("a").alias("total_a"), F.count(F.lit(1)).alias("n")
    )
    y = t.tgt.select("entity", "y")
    return t.ent.select("entity", "slot").join(blocks, "entity", "left").join(y, "entity", "left")


@query(
    "jn8_asof_folds",
    f"""SELECT f.fold, t.cohort, count(*) AS n, avg(y) AS mean_y FROM tgt t JOIN (VALUES (1996), (1997), (1998)) f(fold)
    ON t.cohort + {HORIZON} <= f.fold WHERE y IS NOT NULL GROUP BY 1, 2""",
    "tgt", ints="fold cohort", rnd="mean_y",
)
def _(t):
    known = t.tgt.where(k("y").isNotNull())
    rows = FO.assign_folds(known, "cohort", HORIZON, FOLDS[0], FOLDS[-1])
    rows = FO.assert_no_leak(rows, "cohort", "fold", HORIZON)
    return rows.groupBy("fold", "cohort").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"))


@query(
    "jn9_retrospective_folds",
    """SELECT fold, cohort, n, n_train, retro FROM (SELECT fold, cohort, n, n_asof = 0 AS retro,
        sum(CASE WHEN n_asof > 0 THEN CASE WHEN known THEN n ELSE 0 END ELSE CASE WHEN cohort <> fold THEN n ELSE 0 END END)
          OVER (PARTITION BY fold) AS n_train, CASE WHEN n_asof > 0 THEN known ELSE cohort <> fold END AS keep
      FROM (SELECT fold, cohort, n, cohort + 2 <= fold AS known, sum(CASE WHEN cohort + 2 <= fold THEN n ELSE 0 END) OVER (PARTITION BY fold) AS n_asof
        FROM (SELECT cohort, count(*) AS n FROM tgt WHERE y IS NOT NULL GROUP BY 1), (VALUES (1994), (1995), (1996), (1997), (1998)) f(fold)))
    WHERE keep""",
    "tgt", ints="fold cohort n n_train",
)
def _(t):
    known = t.tgt.where(k("y").isNotNull())
    roles = FO.fold_cohorts(known, "cohort", HORIZON, [1994, 1995, 1996, 1997, 1998], min_training=1, retrospective=True)
    return roles.select("fold", "cohort", "n", "n_train", k("retrospective").alias("retro"))


@query(
    "jn10_dense_spine",
    "SELECT entity, n, period, active, value, a, minutes FROM panel",
    "panel", ints="n period", rnd="value a minutes",
)
def _(t):
    return t.panel.select("entity", "n", "period", "active", "value", "a", "minutes")


@query(
    "jn24_share_lookup",
    """SELECT e.entity, CASE WHEN tm > 0 THEN pm / tm END AS share FROM ent e
    LEFT JOIN (SELECT franchise, period, sum(minutes) AS tm FROM seasons JOIN ent USING (entity) GROUP BY 1, 2) x
      ON x.franchise = e.franchise AND x.period = e.cohort + 1
    LEFT JOIN (SELECT franchise, period, position, sum(minutes) AS pm FROM seasons JOIN ent USING (entity) GROUP BY 1, 2, 3) y
      ON y.franchise = e.franchise AND y.period = e.cohort + 1 AND y.position = e.position""",
    "seasons ent", rnd="share",
)
def _(t):
    s = t.seasons.join(t.ent.select("entity", "franchise", "position"), "entity")
    by_pos = s.groupBy("franchise", "period", "position").agg(F.sum("minutes").alias("pm"))
    team = by_pos.groupBy("franchise", "period").agg(F.sum("pm").alias("tm"))
    e = t.ent.withColumn("period", k("cohort") + 1)
    out = e.join(team, ["franchise", "period"], "left").join(by_pos, ["franchise", "period", "position"], "left")
    return out.select("entity", ratio("pm", "tm").alias("share"))


@query(
    "jn25_changes_over_offsets",
    """SELECT entity, sum(CASE WHEN who <> prev THEN 1 ELSE 0 END)::BIGINT AS changes FROM (
      SELECT entity, who, lag(who) OVER (PARTITION BY entity ORDER BY o) AS prev FROM (
        SELECT e.entity, o, who FROM ent e, (VALUES (0), (1), (2), (3)) f(o)
        JOIN head h ON h.franchise = e.franchise AND h.period = e.cohort + o))
    GROUP BY 1
    UNION ALL SELECT entity, 0 FROM ent e WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.franchise = e.franchise AND h.period BETWEEN e.cohort AND e.cohort + 3)""".replace(
        "head h",
        """(SELECT p_brand AS franchise, year(l_shipdate) AS period, arg_max(l_suppkey % 5, l_quantity * 1000000 + l_suppkey) AS who
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 GROUP BY 1, 2) h""",
    ),
    "ent", ints="changes",
)
def _(t):
    rows = t.lineitem.where("l_quantity >= 49").join(t.part, k("l_partkey") == k("p_partkey"))
    head = rows.groupBy(k("p_brand").alias("franchise"), F.year("l_shipdate").alias("period")).agg(
        F.max_by(k("l_suppkey") % 5, k("l_quantity") * 1000000 + k("l_suppkey")).alias("who")
    )
    e = t.ent.select("entity", "franchise", "cohort")
    return J.ordered_changes(
        e, head, ["franchise"], "cohort", "period", "who", range(4), "changes"
    ).select("entity", "changes")


# ------------------------------------------------------------------------------- aggregates


@query(
    "agg1_group_by",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, avg(l_extendedprice) AS price, min(l_discount) AS lo,
      max(l_discount) AS hi, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2""",
    rnd="qty price lo hi", places=4,
)
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"), F.min("l_discount").alias("lo"),
        F.max("l_discount").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"),
    )


@query(
    "agg2_null_aware_sum",
    """SELECT l_suppkey, sum(CASE WHEN l_quantity > 48 THEN l_quantity END) AS strict,
      coalesce(sum(CASE WHEN l_quantity > 48 AND l_returnflag = 'R' THEN l_quantity END), 0) AS zero FROM lineitem GROUP BY 1""",
    rnd="strict zero",
)
def _(t):
    big = F.when(k("l_quantity") > 48, k("l_quantity"))
    return t.lineitem.groupBy("l_suppkey").agg(
        F.sum(big).alias("strict"), A.sum_or_zero(F.when(k("l_returnflag") == "R", big)).alias("zero")
    )


@query(
    "agg3_conditional",
    f"""SELECT franchise, avg((peak >= 2.0)::INT) AS good_share, count(*) FILTER (WHERE stars > 0) AS stars, count(y) AS known
    FROM otn JOIN (SELECT entity, y FROM tgt) USING (entity) WHERE period = {LAST} GROUP BY 1""",
    "otn tgt", rnd="good_share",
)
def _(t):
    o = t.otn.where(k("period") == LAST).join(t.tgt.select("entity", "y"), "entity")
    return o.groupBy("franchise").agg(
        A.share(k("peak") >= 2.0).alias("good_share"), F.count_if(k("stars") > 0).alias("stars"), F.count("y").alias("known")
    )


COVERAGE = """
WITH picks AS (SELECT * FROM ent), box AS (
  SELECT entity, max(CAST(star AS INT)) AS has_star, max(CAST(minutes > 3000 AS INT)) AS has_minutes FROM seasons GROUP BY 1
), seen AS (SELECT DISTINCT entity FROM seasons)
SELECT p.cohort, count(*) AS picks, avg(CAST(p.position = 'ECONOMY' AS INT)) AS economy,
  avg(coalesce(b.has_star, 0)) AS star, avg(coalesce(b.has_minutes, 0)) AS minutes, avg(CAST(n.entity IS NOT NULL AS INT)) AS seen
FROM picks p LEFT JOIN box b USING (entity) LEFT JOIN seen n USING (entity) GROUP BY 1 ORDER BY 1"""


@query(
    "agg4_coverage_sql",
    COVERAGE.replace("WITH picks", "WITH_picks").replace("WITH_picks", "WITH picks"),
    "seasons ent", ints="cohort", rnd="economy star minutes seen",
)
def _(t):
    return t.spark.sql(
        COVERAGE.replace("FROM ent", "FROM {ent}").replace("FROM seasons", "FROM {seasons}"), ent=t.ent, seasons=t.seasons
    )


@query(
    "agg5_audit_grouping_sets",
    """SELECT season, status, count(*) AS rows_n, avg((n_valid >= 3)::INT) AS covered, grouping(season) * 2 + grouping(status) AS gid
    FROM (SELECT id, season, status, count(*) FILTER (WHERE dx0 * dx0 + dy0 * dy0 < 400) AS n_valid FROM shots GROUP BY 1, 2, 3)
    GROUP BY GROUPING SETS ((season), (status), (season, status))""",
    "shots", ints="season gid", rnd="covered",
)
def _(t):
    close = k("dx0") * k("dx0") + k("dy0") * k("dy0") < 400
    game = t.shots.groupBy("id", "season", "status").agg(F.count_if(close).alias("n_valid"))
    return game.groupingSets([[k("season")], [k("status")], [k("season"), k("status")]], "season", "status").agg(
        F.count(F.lit(1)).alias("rows_n"), A.share(k("n_valid") >= 3).alias("covered"), F.grouping_id().alias("gid")
    )


@query("agg6_stratified_sample")
def _(t):
    pool = t.ent.select("cohort", "entity")
    picked = A.hash_sample(pool, ["cohort"], "entity", 20)
    games = t.lineitem.select(k("l_partkey").alias("entity"), "l_orderkey").distinct()
    return A.hash_sample(games.join(picked, "entity"), ["entity"], "l_orderkey", 8).groupBy("cohort").agg(
        F.count_distinct("entity").alias("teams"), F.count(F.lit(1)).alias("games"),
        (F.count_distinct("entity") * 32).alias("estimated_games"),
    )


@query(
    "agg7_value_shares",
    "SELECT l_suppkey AS id, " + ", ".join(f"avg((p_type = '{v}')::INT) AS share_{v}" for v in TYPES)
    + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    rnd=" ".join(f"share_{v}" for v in TYPES),
)
def _(t):
    """Also UDF-4: shares by condition are aggregates, not lambdas."""
    per = t.lineitem.join(t.part.select(k("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return A.value_shares(per.withColumnRenamed("l_suppkey", "id"), ["id"], "p_type", TYPES, "share_")


@query(
    "agg8_crosstab",
    "SELECT franchise, " + ", ".join(f"count(*) FILTER (WHERE position = '{v}') AS {v}" for v in TYPES) + " FROM ent GROUP BY 1",
    "ent",
)
def _(t):
    return A.crosstab(t.ent, "franchise", "position", TYPES)


@query(
    "agg9_pivot_mean",
    """SELECT id, avg(made::INT) FILTER (WHERE status = 'F') AS f_share, avg(made::INT) FILTER (WHERE status = 'O') AS o_share
    FROM shots GROUP BY 1""",
    "shots", rnd="f_share o_share",
)
def _(t):
    p = t.shots.withColumn("m", k("made").cast("double")).groupBy("id").pivot("status", ["F", "O"]).agg(F.avg("m"))
    return p.withColumnsRenamed({"F": "f_share", "O": "o_share"})


@query(
    "agg10_weighted_mean",
    """SELECT entity, sum(value * minutes) / nullif(sum(minutes), 0) AS wmean, sum(starts) / nullif(sum(games), 0) AS availability
    FROM panel GROUP BY 1""",
    "panel", rnd="wmean:6 availability",
)
def _(t):
    return t.panel.groupBy("entity").agg(
        A.weighted_mean("value", "minutes").alias("wmean"),
        F.try_divide(F.sum("starts"), F.sum("games")).alias("availability"),
    )


@query(
    "agg11_training_stats",
    f"SELECT avg(a) AS a_mu, stddev_samp(a) AS a_sd, avg(b) AS b_mu, stddev_samp(b) AS b_sd FROM seasons WHERE cohort <= {TRAIN_LAST}",
    "seasons", rnd="a_mu a_sd b_mu b_sd",
)
def _(t):
    return P.training_stats(t.seasons, ["a", "b"], k("cohort") <= TRAIN_LAST)


COMPOSITE = f"""SELECT entity, n, 0.75 * (peak - p_mu) / nullif(p_sd, 0) + 0.25 * (total - t_mu) / nullif(t_sd, 0) AS composite
    FROM otn JOIN (SELECT n, avg(peak) p_mu, stddev_samp(peak) p_sd, avg(total) t_mu, stddev_samp(total) t_sd
      FROM otn WHERE cohort <= {TRAIN_LAST} GROUP BY 1) USING (n)"""


@query("agg12_same_point_composite", COMPOSITE, "otn", ints="n", rnd="composite")
def _(t):
    return t.composite.select("entity", "n", "composite")


@query(
    "agg13_exact_quantiles",
    """SELECT l_returnflag, tau, quantile FROM (SELECT l_returnflag, unnest([0.05, 0.25, 0.5, 0.975]) AS tau,
      unnest(quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.975])) AS quantile FROM lineitem GROUP BY 1)""",
    rnd="tau quantile", places=4,
)
def _(t):
    return RK.quantile_rows(t.lineitem, "l_extendedprice", [0.05, 0.25, 0.5, 0.975], ["l_returnflag"])


@query(
    "agg14_computed_level_quantile",
    """SELECT cohort, tau, max(CASE WHEN rn = floor(h) + 1 THEN y END) + (max(CASE WHEN rn = ceil(h) + 1 THEN y END)
        - max(CASE WHEN rn = floor(h) + 1 THEN y END)) * max(h - floor(h)) AS quantile
    FROM (SELECT cohort, tau, y, rn, (n - 1) * least(ceil((n + 1) * tau) / n, 1.0) AS h FROM (
      SELECT cohort, y, row_number() OVER (PARTITION BY cohort ORDER BY y) AS rn, count(*) OVER (PARTITION BY cohort) AS n
      FROM tgt WHERE y IS NOT NULL), (VALUES (0.1), (0.5), (0.9)) v(tau)) GROUP BY 1, 2""",
    "tgt", ints="cohort", rnd="tau quantile",
)
def _(t):
    return RK.quantile_rows(t.tgt, "y", [0.1, 0.5, 0.9], ["cohort"], level=FC.conformal_level)


@query(
    "agg15_argmax_row",
    """SELECT franchise, best, worst FROM (SELECT franchise, first(entity ORDER BY y DESC, entity) AS best,
      first(entity ORDER BY y, entity) AS worst FROM tgt WHERE y IS NOT NULL GROUP BY 1)""",
    "tgt",
)
def _(t):
    return t.tgt.where(k("y").isNotNull()).groupBy("franchise").agg(
        A.best_row("y", "entity", "entity").alias("best"), A.worst_row("y", "entity", "entity").alias("worst")
    )


@query(
    "agg16_top_k_sum",
    """SELECT cohort, sum(y) AS top5 FROM (SELECT cohort, y, row_number() OVER (PARTITION BY cohort ORDER BY y DESC, entity) AS rn
      FROM tgt WHERE y IS NOT NULL) WHERE rn <= 5 GROUP BY 1""",
    "tgt", ints="cohort", rnd="top5",
)
def _(t):
    return A.top_sum(t.tgt.where(k("y").isNotNull()), ["cohort"], "y", "entity", 5, "top5")


@query(
    "agg17_last_non_null",
    """SELECT entity, arg_max(a, period) FILTER (WHERE a > 2) AS last_known, arg_max(a, period) AS last_row,
      arg_min(a, period) FILTER (WHERE a > 2) AS first_known FROM seasons GROUP BY 1""",
    "seasons", rnd="last_known last_row first_known",
)
def _(t):
    high = F.when(k("a") > 2, k("a"))
    at = F.when(k("a") > 2, k("period"))
    return t.seasons.groupBy("entity").agg(
        F.max_by(high, at).alias("last_known"), F.max_by("a", "period").alias("last_row"),
        F.min_by(high, at).alias("first_known"),
    )


@query(
    "agg18_keep_rules",
    """SELECT 'unique' AS rule, count(*) AS n FROM (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1)
    UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
    UNION ALL SELECT 'last', CAST(sum(q) AS BIGINT) FROM (SELECT l_partkey, l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)""",
)
def _(t):
    keys = ["l_partkey", "l_suppkey"]
    rows = t.lineitem.select(*keys, "l_quantity")
    last = RK.latest(rows, keys, [k("l_quantity").desc()])
    return (
        A.keep_unique(rows, keys).agg(F.lit("unique").alias("rule"), F.count(F.lit(1)).alias("n"))
        .unionByName(rows.dropDuplicates(keys).agg(F.lit("distinct").alias("rule"), F.count(F.lit(1)).alias("n")))
        .unionByName(last.agg(F.lit("last").alias("rule"), F.sum("l_quantity").cast("bigint").alias("n")))
    )


@query(
    "agg19_regression",
    """SELECT n, regr_slope(o, f) AS b, regr_intercept(o, f) AS a,
      sqrt((regr_syy(o, f) - regr_sxy(o, f) ** 2 / regr_sxx(o, f)) / (regr_count(o, f) - 2)) AS sigma
    FROM (SELECT x.n, sqrt(greatest(x.peak, 0)) AS o, sqrt(greatest(z.peak, 0)) AS f FROM otn x JOIN otn z USING (entity)
      WHERE z.n = 4 AND x.n < 4) GROUP BY 1""",
    "otn", ints="n", rnd="b a sigma",
)
def _(t):
    final = t.otn.where("n = 4").select("entity", R.to_sqrt("peak").alias("f"))
    rows = t.otn.where("n < 4").select("entity", "n", R.to_sqrt("peak").alias("o")).join(final, "entity")
    return rows.groupBy("n").agg(*[c.alias(n) for n, c in A.regression(k("o"), k("f")).items()])


@query(
    "agg20_era_table",
    """SELECT t.season, n_teams, fta / fga AS ft_rate, pts / (2 * (fga + 0.44 * fta)) AS ts, poss, c.n / n_teams AS coverage
    FROM (SELECT season, count(*) AS n_teams, sum(fga) AS fga, sum(fta) AS fta, sum(pts) AS pts FROM team GROUP BY 1) t
    LEFT JOIN (SELECT season, avg((fga - orb + 0.475 * fta) / g) AS poss, count(*) AS n FROM team
      WHERE orb IS NOT NULL GROUP BY 1) c ON c.season = t.season""".replace(
        "FROM team",
        """FROM (SELECT year(l_shipdate) AS season, l_suppkey, sum(l_quantity) AS fga, sum(l_linenumber) AS fta,
        sum(l_quantity * 2 + l_linenumber) AS pts, count(*) AS g, sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS orb
        FROM lineitem GROUP BY 1, 2)""",
    ),
    ints="season", rnd="ft_rate ts poss coverage",
)
def _(t):
    team = t.lineitem.groupBy(F.year("l_shipdate").alias("season"), "l_suppkey").agg(
        F.sum("l_quantity").alias("fga"), F.sum("l_linenumber").alias("fta"),
        F.sum(k("l_quantity") * 2 + k("l_linenumber")).alias("pts"), F.count(F.lit(1)).alias("g"),
        F.sum(F.when(k("l_returnflag") == "R", k("l_linenumber"))).alias("orb"),
    )
    full = k("orb").isNotNull()
    poss = R.possessions("fga", "orb", F.lit(0), "fta") / k("g")
    out = team.groupBy("season").agg(
        F.count(F.lit(1)).alias("n_teams"), F.sum("fga").alias("fga"), F.sum("fta").alias("fta"), F.sum("pts").alias("pts"),
        F.avg(F.when(full, poss)).alias("poss"), A.share(full).alias("coverage"),
    )
    return out.select(
        "season", "n_teams", (k("fta") / k("fga")).alias("ft_rate"), R.true_shooting("pts", "fga", "fta").alias("ts"),
        "poss", "coverage",
    )


@query(
    "agg21_missed_periods",
    """SELECT entity, period, len - games AS missed FROM seasons JOIN (SELECT period, max(games) AS len FROM seasons GROUP BY 1) USING (period)""",
    "seasons", ints="period", rnd="missed",
)
def _(t):
    length = t.seasons.groupBy("period").agg(F.max("games").alias("len"))
    return t.seasons.join(length, "period").select(
        "entity", "period", F.greatest(k("len") - k("games"), F.lit(0.0)).alias("missed")
    )


@query(
    "agg22_smoothed_slot_mean",
    """SELECT slot, avg(m) OVER (ORDER BY slot ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth
    FROM (SELECT slot, avg(y) AS m FROM tgt WHERE y IS NOT NULL GROUP BY 1)""",
    "tgt", ints="slot", rnd="smooth",
)
def _(t):
    # The window runs over one row per slot, a bounded axis.
    m = t.tgt.where(k("y").isNotNull()).groupBy("slot").agg(F.avg("y").alias("m"))
    w = Window.partitionBy(F.lit(1)).orderBy("slot").rowsBetween(-2, 2)
    return m.select("slot", F.avg("m").over(w).alias("smooth"))


def slot_curve(rows, slot="slot", value="y", name="pooled", width=0.2):
    """Median and mean by slot over slots within width * slot, as (slot, median, mean, n).

    Rows collapse to (slot, value, weight) before neighbouring slots are pooled.
    """
    counts = rows.where(k(value).isNotNull()).groupBy(slot, value).agg(F.count(F.lit(1)).alias("_w"))
    # A slot serves centre c when |c - slot| <= round(width * c): centres run slot/(1+w) .. slot/(1-w).
    lo = F.greatest(F.floor(k(slot) / (1 + width)).cast("int") - 1, F.lit(1))
    hi = F.ceil(k(slot) / (1 - width)).cast("int") + 1
    slots = rows.select(k(slot).alias("_c")).distinct()
    spread = counts.withColumn("_c", F.explode(F.sequence(lo, hi)))
    near = F.abs(k("_c") - k(slot)) <= F.bround(k("_c") * width)
    pooled = spread.where(near).join(slots, "_c").groupBy("_c", value).agg(F.sum("_w").alias("_w"))
    med = RK.quantile_rows(pooled, value, [0.5], ["_c"], weight="_w").select("_c", k("quantile").alias("median"))
    avg = pooled.groupBy("_c").agg(
        (F.sum(k(value) * k("_w")) / F.sum("_w")).alias("mean"), F.sum("_w").alias("n")
    )
    return med.join(avg, "_c").withColumnRenamed("_c", slot)


CURVE_SQL = """SELECT c.slot, median(t.y) AS median, avg(t.y) AS mean, count(*) AS n FROM (SELECT DISTINCT slot FROM tgt) c
    JOIN tgt t ON abs(t.slot - c.slot) <= round_even(c.slot * 0.2, 0) AND t.y IS NOT NULL GROUP BY 1"""


@query("agg23_slot_pooled_stats", CURVE_SQL, "tgt", ints="slot", rnd="median mean")
def _(t):
    return slot_curve(t.tgt)


@query(
    "agg24_missing_profile",
    """SELECT position, feature, missing FROM (SELECT position, avg((y IS NULL)::INT) AS y, avg((best IS NULL)::INT) AS best
      FROM tgt LEFT JOIN (SELECT entity, max(a) AS best FROM seasons WHERE star GROUP BY 1) USING (entity) GROUP BY 1)
    UNPIVOT (missing FOR feature IN (y, best))""",
    "tgt seasons", rnd="missing",
)
def _(t):
    best = t.seasons.where("star").groupBy("entity").agg(F.max("a").alias("best"))
    return A.missing_shares(t.tgt.join(best, "entity", "left"), ["y", "best"], ["position"])


# ---------------------------------------------------------------------------------- windows


@query(
    "win1_running_totals",
    "SELECT entity, n, total, sum_minutes, periods_active, stars FROM otn",
    "otn", ints="n periods_active stars", rnd="total sum_minutes",
)
def _(t):
    return t.otn.select("entity", "n", "total", "sum_minutes", "periods_active", "stars")


@query(
    "win2_latest_row",
    """SELECT l_partkey, l_orderkey, l_quantity, l_shipdate::DATE AS d FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
      ORDER BY l_shipdate DESC, l_quantity DESC, l_orderkey DESC) AS rn FROM lineitem) WHERE rn = 1""",
    rnd="l_quantity",
)
def _(t):
    last = RK.latest(
        t.lineitem, ["l_partkey"], [k("l_shipdate").desc(), k("l_quantity").desc(), k("l_orderkey").desc()]
    )
    return last.select("l_partkey", "l_orderkey", "l_quantity", k("l_shipdate").cast("date").alias("d"))


@query("win3_rolling_peak", "SELECT entity, n, peak, peak_graded FROM otn", "otn", ints="n", rnd="peak peak_graded")
def _(t):
    """Also UDF-5: a rolling peak along an entity."""
    return t.otn.select("entity", "n", "peak", "peak_graded")


@query("win4_conditional_running_count", "SELECT entity, n, longevity FROM otn", "otn", ints="n longevity")
def _(t):
    return t.otn.select("entity", "n", "longevity")


@query(
    "win5_sequence_number",
    "SELECT entity, period, row_number() OVER (PARTITION BY entity ORDER BY period) AS idx FROM seasons",
    "seasons", ints="period idx",
)
def _(t):
    w = Window.partitionBy("entity").orderBy("period")
    return t.seasons.select("entity", "period", F.row_number().over(w).alias("idx"))


@query(
    "win6_rank_min",
    """SELECT entity, rank() OVER (ORDER BY y DESC) AS all_time, rank() OVER (PARTITION BY cohort ORDER BY y DESC) AS in_cohort
    FROM tgt WHERE y IS NOT NULL""",
    "tgt", ints="all_time in_cohort",
)
def _(t):
    d = t.tgt.where(k("y").isNotNull())
    d = RK.with_ranks(d, "y", descending=True, min_rank="all_time")
    return RK.with_ranks(d, "y", ["cohort"], descending=True, min_rank="in_cohort").select("entity", "all_time", "in_cohort")


@query(
    "win7_percent_rank_ties",
    """SELECT l_suppkey, season, pct, pct <= 1 / 3 AS weak FROM (SELECT *, (rank() OVER (PARTITION BY season ORDER BY q)
      + (count(*) OVER (PARTITION BY season, q) - 1) / 2) / count(*) OVER (PARTITION BY season) AS pct
      FROM (SELECT l_suppkey, year(l_shipdate) AS season, round(sum(l_quantity) / 100, 0) AS q FROM lineitem GROUP BY 1, 2))""",
    ints="season", rnd="pct",
)
def _(t):
    s = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("season")).agg(
        F.round(F.sum("l_quantity") / 100, 0).alias("q")
    )
    s = RK.with_ranks(s, "q", ["season"], percent_rank="pct")
    return s.select("l_suppkey", "season", "pct", (k("pct") <= 1 / 3).alias("weak"))


@query(
    "win8_average_rank",
    "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS avg_rank FROM part",
    rnd="avg_rank",
)
def _(t):
    return RK.with_ranks(t.part, "p_size", average_rank="avg_rank").select("p_partkey", "avg_rank")


@query(
    "win9_monotone_check",
    """SELECT count(*) FILTER (WHERE peak < prev) AS falls, count(*) AS n FROM (SELECT peak, lag(peak) OVER w AS prev FROM otn
      WINDOW w AS (PARTITION BY entity ORDER BY n))""",
    "otn",
)
def _(t):
    w = Window.partitionBy("entity").orderBy("n")
    return t.otn.withColumn("prev", F.lag("peak").over(w)).agg(
        F.count_if(k("peak") < k("prev")).alias("falls"), F.count(F.lit(1)).alias("n")
    )


@query(
    "win10_group_median",
    """SELECT entity, m, y >= m AS above FROM tgt JOIN (SELECT position, median(y) AS m FROM tgt GROUP BY 1) USING (position)
    WHERE y IS NOT NULL""",
    "tgt", rnd="m",
)
def _(t):
    m = RK.group_median(t.tgt, "y", ["position"], "m")
    return t.tgt.where(k("y").isNotNull()).join(m, "position").select("entity", "m", (k("y") >= k("m")).alias("above"))


@query(
    "win11_risk_set",
    """SELECT position, d, n, sum(n) OVER (PARTITION BY position ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk
    FROM (SELECT position, periods_active AS d, count(*) AS n FROM otn WHERE period = 2000 GROUP BY 1, 2)""",
    "otn", ints="d n at_risk",
)
def _(t):
    c = t.otn.where(k("period") == LAST).groupBy("position", k("periods_active").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("position").orderBy("d").rowsBetween(0, Window.unboundedFollowing)
    return c.withColumn("at_risk", F.sum("n").over(w))


@query(
    "win12_ordered_fold",
    """SELECT user_id, start, holder FROM (
      WITH RECURSIVE m AS MATERIALIZED (SELECT user_id, event_id % 4 AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS dst,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL),
      h AS (
        SELECT user_id, user_id % 4 AS start, user_id % 4 AS holder, CAST(0 AS BIGINT) AS i FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL SELECT h.user_id, h.start, CASE WHEN m.src = h.holder THEN m.dst ELSE h.holder END, m.i FROM h JOIN m ON m.user_id = h.user_id AND m.i = h.i + 1)
      SELECT user_id, start, arg_max(holder, i) AS holder FROM h GROUP BY 1, 2)""",
)
def _(t):
    """Holder after a user's ordered moves."""
    moves = t.events.select(
        "user_id", "ts", "event_id", F.pmod("event_id", F.lit(4)).alias("src"), F.pmod("user_id", F.lit(4)).alias("u"),
        F.get_json_object("props", "$.k").cast("bigint").alias("kk"),
    ).withColumn("dst", F.pmod(k("kk"), F.lit(4)))
    ends = P.fold_states(moves, "user_id", ["ts", "event_id"], "src", "dst")
    users = moves.groupBy("user_id").agg(F.first("u").alias("start"))
    return P.final_holder(users, ends, "user_id", "start", "holder").select("user_id", "start", "holder")


@query(
    "win13_percent_change",
    """SELECT k, err, 1 - err / lag(err) OVER (ORDER BY k) AS gain FROM (SELECT p_size % 9 + 2 AS k, avg(p_retailprice) / (p_size % 9 + 2) AS err
      FROM part GROUP BY 1)""".replace("GROUP BY 1)", "GROUP BY p_size % 9)"),
    ints="k", rnd="err gain",
)
def _(t):
    curve = t.part.groupBy((k("p_size") % 9 + 2).alias("k")).agg(F.avg("p_retailprice").alias("m"))
    w = Window.partitionBy(F.lit(1)).orderBy("k")
    curve = curve.select("k", (k("m") / k("k")).alias("err"))
    return curve.withColumn("gain", 1 - k("err") / F.lag("err").over(w))


@query(
    "win14_unique_labels",
    """SELECT franchise, CASE WHEN n1 = 1 THEN l1 WHEN n2 = 1 THEN l2 ELSE l3 END AS label FROM (
      SELECT franchise, l1, l2, l2 || ', ' || franchise AS l3, count(*) OVER (PARTITION BY l1) AS n1, count(*) OVER (PARTITION BY l1, l2) AS n2 FROM (
        SELECT franchise, first(position ORDER BY c DESC, position) AS l1,
          first(position ORDER BY c DESC, position) || ' + ' || lower(list(position ORDER BY c DESC, position)[2]) AS l2
        FROM (SELECT franchise, position, count(*) AS c FROM ent GROUP BY 1, 2) GROUP BY 1))""",
    "ent",
)
def _(t):
    from ..operators.spatial import disambiguate

    c = t.ent.groupBy("franchise", "position").agg(F.count(F.lit(1)).alias("c"))
    ranked = RK.top_k(c, ["franchise"], [k("c").desc(), k("position")], 2)
    two = ranked.groupBy("franchise").agg(
        F.max(F.when(k("rank") == 1, k("position"))).alias("l1"), F.max(F.when(k("rank") == 2, k("position"))).alias("p2")
    )
    second = F.concat_ws(" + ", "l1", F.lower("p2"))
    out = disambiguate(two, "l1", [second, F.concat_ws(", ", second, "franchise")], "label")
    return out.select("franchise", "label")


# ----------------------------------------------------------------------------- sorts, top-k


@query(
    "srt1_mixed_sort",
    "SELECT entity, cohort, slot FROM ent",
    "ent", ints="cohort slot",
)
def _(t):
    return t.ent.select("entity", "cohort", "slot").orderBy(k("cohort").desc(), "slot", "entity")


@query("srt2_top_n", "SELECT entity, y FROM tgt WHERE y IS NOT NULL ORDER BY y DESC, entity LIMIT 30", "tgt", rnd="y")
def _(t):
    return t.tgt.where(k("y").isNotNull()).orderBy(k("y").desc(), "entity").limit(30).select("entity", "y")


@query(
    "srt3_head_and_tail",
    """SELECT * FROM (SELECT entity, y FROM tgt WHERE y IS NOT NULL ORDER BY y DESC, entity LIMIT 12)
    UNION SELECT * FROM (SELECT entity, y FROM tgt WHERE y IS NOT NULL ORDER BY y, entity DESC LIMIT 8)""",
    "tgt", rnd="y",
)
def _(t):
    d = t.tgt.where(k("y").isNotNull()).select("entity", "y")
    head = d.orderBy(k("y").desc(), "entity").limit(12)
    return head.unionByName(d.orderBy("y", k("entity").desc()).limit(8)).dropDuplicates(["entity"])


@query(
    "srt4_top_k_per_group",
    """SELECT franchise, entity, rank FROM (SELECT franchise, entity, row_number() OVER (PARTITION BY franchise ORDER BY y DESC, entity) AS rank
      FROM tgt WHERE y IS NOT NULL) WHERE rank <= 15""",
    "tgt", ints="rank",
)
def _(t):
    d = t.tgt.where(k("y").isNotNull())
    return RK.top_k(d, ["franchise"], [k("y").desc(), k("entity")], 15).select("franchise", "entity", "rank")


@query(
    "srt5_monotone_grid",
    "SELECT vec_id, list_sort(embedding)[1] AS lo, list_sort(embedding)[32] AS mid, list_sort(embedding)[64] AS hi FROM embeddings",
    rnd="lo mid hi",
)
def _(t):
    from ..functions.grids import monotone

    m = t.embeddings.withColumn("m", monotone("embedding"))
    return m.select("vec_id", k("m")[0].alias("lo"), k("m")[31].alias("mid"), k("m")[63].alias("hi"))


@query(
    "srt6_rank_then_search",
    """SELECT entity, rank FROM (SELECT entity, name, row_number() OVER (ORDER BY price DESC, entity) AS rank FROM ent WHERE slot <= 20)
    WHERE contains(name, 'blue')""",
    "ent", ints="rank",
)
def _(t):
    ranked = RK.with_position(t.ent.where("slot <= 20"), "price", "entity", name="rank")
    return ranked.where(k("name").contains("blue")).select("entity", "rank")


# ------------------------------------------------------------------------------ set operations


@query(
    "set1_union_by_name",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
    rnd="balance",
)
def _(t):
    c = t.customer.select(k("c_custkey").alias("id"), k("c_name").alias("name"), k("c_mktsegment").alias("segment"))
    s = t.supplier.select(k("s_suppkey").alias("id"), k("s_name").alias("name"), k("s_acctbal").alias("balance"))
    return J.union_all(c, s)


@query(
    "set2_intersect_keys",
    "SELECT l_partkey FROM lineitem WHERE l_quantity = 50 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09",
)
def _(t):
    return t.lineitem.where("l_quantity = 50").select("l_partkey").intersect(
        t.lineitem.where("l_discount > 0.09").select("l_partkey")
    )


@query(
    "set3_except_keys",
    "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 50",
)
def _(t):
    hit = t.lineitem.where("l_quantity = 50").select(k("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(hit, "p_partkey", "left_anti")


@query(
    "set4_pivot_wide",
    "SELECT entity, " + ", ".join(f"max(CASE WHEN n = {i} THEN peak END) AS n{i}" for i in range(1, 7)) + " FROM otn GROUP BY 1",
    "otn", rnd="n1 n2 n3 n4 n5 n6",
)
def _(t):
    w = J.pivot_first(t.otn, ["entity"], "n", "peak", list(range(1, 7)))
    return w.withColumnsRenamed({str(i): f"n{i}" for i in range(1, 7)})


@query(
    "set5_unpivot_long",
    """SELECT p_partkey, measure, v FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part)
    UNPIVOT (v FOR measure IN (size, price))""",
    rnd="v",
)
def _(t):
    p = t.part.select("p_partkey", k("p_size").cast("double").alias("size"), k("p_retailprice").alias("price"))
    return p.unpivot(["p_partkey"], ["size", "price"], "measure", "v")


@query(
    "set6_unordered_key",
    """SELECT lo, hi, d, count(*) AS n FROM (SELECT least(l_suppkey, l_partkey % 100) AS lo, greatest(l_suppkey, l_partkey % 100) AS hi,
      CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def _(t):
    pair = F.array_sort(F.array(k("l_suppkey"), k("l_partkey") % 100))
    g = t.lineitem.groupBy(pair.alias("pair"), k("l_shipdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return g.where("n > 1").select(k("pair")[0].alias("lo"), k("pair")[1].alias("hi"), "d", "n")
