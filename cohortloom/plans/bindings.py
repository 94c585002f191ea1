"""The star-schema tables seen as entities, cohorts, periods and values.

entity = part, cohort by a key rule, slot = size, position = type, franchise = brand, period =
ship year. `Tables` builds the Spark frames, `CTES` the same frames as SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grids as G
from ..operators import panel as P
from ..operators.forecast import SlotModel
from ..session import cut_lineage

LAST = 2000  # last complete period
TRAIN_LAST = 1996  # cohorts up to here set every scale
HORIZON = 2
FINAL_N = 3
FOLDS = (1996, 1997, 1998)
ALL_COHORTS = (1994, 1995, 1996, 1997, 1998, 1999)
CUTS = [0.5, 1.2, 2.0, 2.8, 3.6]
STAR_CUT, BUST_CUT = CUTS[3], CUTS[1]
ROTATION_MINUTES = 2000
LEVELS_SQL = "[" + ", ".join(f"{t:.2f}" for t in G.LEVELS) + "]"
CUTS_SQL = "[" + ", ".join(str(c) for c in CUTS) + "]"


_STAGED: dict[tuple[str, str, str, str], DataFrame] = {}


def folder_state(spark: SparkSession, folder: str) -> str:
    """Names, lengths and times of what a folder holds: staged tables of other contents are not used again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return "|".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


class Tables:
    """Frames of one data folder. Fan-out points are staged: written once, then read by all."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def state(self) -> str:
        return folder_state(self.spark, self.sf_dir)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The modelled table `name`, written to the shared folder on first use in this session.

        It is written anew when the files of the data folder have changed.
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self.state, name)
        if key not in _STAGED:
            _STAGED[key] = cut_lineage(build())
        return _STAGED[key]

    @cached_property
    def ent(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("entity"),
            (1994 + F.pmod("p_partkey", F.lit(6))).cast("int").alias("cohort"),
            F.col("p_size").alias("slot"),
            F.col("p_type").alias("position"),
            F.col("p_brand").alias("franchise"),
            F.col("p_name").alias("name"),
            F.col("p_retailprice").alias("price"),
        )

    @cached_property
    def seasons(self) -> DataFrame:
        rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        q, flag = F.col("l_quantity"), F.col("l_returnflag")
        per = self.lineitem.groupBy(
            F.col("l_partkey").alias("entity"), F.year("l_shipdate").alias("period")
        ).agg(
            (F.round(F.sum(rev), 4) / 1e5).alias("a"),
            (F.sum(q) / 100).alias("b"),
            (F.sum(q) * 20).alias("minutes"),
            F.count(F.lit(1)).cast("double").alias("games"),
            F.count_if(F.col("l_linestatus") == "F").cast("double").alias("starts"),
            F.bool_or((flag == "R") & (q >= 46)).alias("star"),
            F.bool_or((flag == "A") & (q >= 50)).alias("league"),
            F.bool_or((flag == "N") & (q >= 48)).alias("solid"),
            (F.round(F.sum(F.when(flag == "R", rev).otherwise(0.0)), 4) / 1e6).alias("po_a"),
            (F.sum(F.when(flag == "R", q).otherwise(0.0)) / 1000).alias("po_b"),
        )
        keyed = per.join(self.ent.select("entity", "cohort"), "entity")
        return keyed.where((F.col("period") > F.col("cohort")) & (F.col("period") <= LAST))

    @cached_property
    def vals(self) -> DataFrame:
        def build() -> DataFrame:
            s = P.season_blend(self.seasons, "a", "b", F.col("cohort") <= TRAIN_LAST, "po_a", "po_b")
            return s.withColumns({c: F.round(c, 6) for c in ("value", "value_extra")})

        return self.stage("season_values", build)

    @cached_property
    def panel(self) -> DataFrame:
        measures = ["value", "value_extra", "a", "minutes", "games", "starts"]
        return P.dense_panel(
            self.ent, self.vals, "entity", "cohort", LAST, measures, ["star", "league", "solid"]
        )

    @cached_property
    def otn(self) -> DataFrame:
        """Cumulative outcomes through n."""
        return self.stage("outcomes_through_n", self._outcomes)

    def _outcomes(self) -> DataFrame:
        p = self.panel.withColumn("graded", F.col("value") + F.col("value_extra"))
        for value, name in (
            ("value", "peak"), ("graded", "peak_graded"), ("minutes", "best_minutes"), ("starts", "best_starts")
        ):
            p = P.with_rolling_peak(p, value, "entity", "n", name)
        p = p.withColumns(
            {
                "total": P.running("value", "entity", "n"),
                "sum_minutes": P.running("minutes", "entity", "n"),
                "periods_active": P.running_count(F.col("active"), "entity", "n"),
                "longevity": P.running_count(F.col("minutes") >= ROTATION_MINUTES, "entity", "n"),
                "stars": P.running_count(F.col("star"), "entity", "n"),
                "leagues": P.running_count(F.col("league"), "entity", "n"),
                "solids": P.running_count(F.col("solid"), "entity", "n"),
            }
        )
        rounded = ("peak", "peak_graded", "total", "best_minutes", "best_starts")
        p = p.withColumns({c: F.round(c, 6) for c in rounded})
        return p.select(
            "entity", "cohort", "slot", "position", "franchise", "name", "price", "n", "period", "active",
            "value", "value_extra", *rounded, "sum_minutes", "periods_active", "longevity", "stars",
            "leagues", "solids",
        )

    @cached_property
    def composite(self) -> DataFrame:
        return P.same_point_composite(
            self.otn, {"peak": 0.75, "total": 0.25}, F.col("cohort") <= TRAIN_LAST
        )

    @cached_property
    def tgt(self) -> DataFrame:
        """One row per entity with the outcome at the horizon, where observed."""
        at = self.otn.where(F.col("n") == HORIZON).select("entity", F.col("peak").alias("y"))
        return self.stage("targets", lambda: self.ent.join(at, "entity", "left"))

    def model(self, conformal: bool = False) -> SlotModel:
        return SlotModel(
            "cohort", "slot", "y", "entity", HORIZON, FOLDS, 60,
            calib=1 if conformal else 0, min_fit=1 if conformal else 0,
        )

    def slot_predictions(self, conformal: bool = False) -> DataFrame:
        m = self.model(conformal)
        known = self.tgt.where(F.col("y").isNotNull())
        name = "slot_conformal" if conformal else "slot"
        return self.stage(f"predictions_{name}", lambda: m.predict(known, m.fit(self.tgt)))

    @cached_property
    def shots(self) -> DataFrame:
        """Line items as points on a court: id is the part."""
        dx = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13, F.lit(51)).cast("double") - 25
        dy = F.pmod(F.col("l_orderkey") * 11 + F.col("l_quantity").cast("bigint") * 3, F.lit(33)).cast("double") - 3
        return self.lineitem.select(
            F.col("l_partkey").alias("id"),
            F.year("l_shipdate").alias("season"),
            dx.alias("dx0"), dy.alias("dy0"),
            (F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(3)) == 0).alias("is_three"),
            (F.col("l_returnflag") == "R").alias("made"),
            F.col("l_linestatus").alias("status"),
        )


def slot_model_ctes(
    p: str, rows: str, lag: int, folds: tuple[int, ...], calib: int = 0, min_fit: int = 0, k: int = 60,
    adaptive: bool = False, min_training: int = 0, retro: bool = False,
) -> dict[str, tuple[str, list[str]]]:
    """The slot model in SQL over CTE `rows`(entity, cohort, slot, y): `{p}_pred`(fold, slot, grid)."""
    fold_values = ", ".join(f"({f})" for f in folds)
    kx = f"least({k}, greatest(10, CAST(round_even(n_train * 0.2, 0) AS INT)))" if adaptive else str(k)
    keep = "CASE WHEN n_asof >= {m} THEN known ELSE {r} END".format(
        m=max(min_training, 1), r="cohort <> fold" if retro else "FALSE"
    )
    base = {
        f"{p}_roles": (
            f"""SELECT fold, cohort, n, retro, sum(n) OVER (PARTITION BY fold) AS n_train,
                   CASE WHEN {calib} > 0 AND count(*) OVER (PARTITION BY fold) >= {calib + min_fit}
                     AND row_number() OVER (PARTITION BY fold ORDER BY cohort DESC) <= {calib}
                     THEN 'calib' ELSE 'fit' END AS role
            FROM (SELECT *, n_asof < {max(min_training, 1)} AS retro FROM (
                SELECT fold, cohort, n, cohort + {lag} <= fold AS known,
                  sum(CASE WHEN cohort + {lag} <= fold THEN n ELSE 0 END) OVER (PARTITION BY fold) AS n_asof
                FROM (SELECT cohort, count(*) AS n FROM {rows} WHERE y IS NOT NULL GROUP BY 1),
                     (VALUES {fold_values}) f(fold)))
            WHERE {keep}""",
            [rows],
        ),
        f"{p}_grid": (
            f"""SELECT fold, slot, quantile_cont(y, {LEVELS_SQL}) AS grid FROM (
                SELECT r.fold, s.slot, t.y, r.n_train,
                  row_number() OVER (PARTITION BY r.fold, s.slot
                    ORDER BY round(abs(ln(s.slot) - ln(t.slot)) * 1e9), t.entity) AS rn
                FROM {p}_roles r JOIN {rows} t ON r.cohort = t.cohort AND r.role = 'fit' AND t.y IS NOT NULL,
                     (SELECT DISTINCT slot FROM {rows}) s)
            WHERE rn <= {kx} GROUP BY 1, 2""",
            [f"{p}_roles", rows],
        ),
    }
    if not calib:
        base[f"{p}_pred"] = (f"SELECT * FROM {p}_grid", [f"{p}_grid"])
        return base
    base[f"{p}_delta"] = (
        f"""SELECT fold, list(d ORDER BY i) AS delta FROM (
            SELECT fold, i, max(CASE WHEN rn = fl THEN e END)
                + (max(CASE WHEN rn = ce THEN e END) - max(CASE WHEN rn = fl THEN e END)) * max(h - floor(h)) AS d
            FROM (SELECT *, floor(h) + 1 AS fl, ceil(h) + 1 AS ce FROM (
                SELECT *, (n - 1) * least(ceil((n + 1) * {LEVELS_SQL}[i]) / n, 1.0) AS h FROM (
                SELECT fold, i, e, row_number() OVER (PARTITION BY fold, i ORDER BY e) AS rn,
                       count(*) OVER (PARTITION BY fold, i) AS n
                FROM (SELECT fold, unnest(range(1, 20)) AS i, y - unnest(grid) AS e FROM (
                    SELECT r.fold, t.y, g.grid FROM {p}_roles r
                    JOIN {rows} t ON r.cohort = t.cohort AND r.role = 'calib' AND t.y IS NOT NULL
                    JOIN {p}_grid g ON g.fold = r.fold AND g.slot = t.slot)))))
            WHERE rn IN (fl, ce) GROUP BY 1, 2) GROUP BY 1""",
        [f"{p}_roles", f"{p}_grid", rows],
    )
    base[f"{p}_pred"] = (
        f"""SELECT fold, slot, list(greatest(q + coalesce(d, 0.0), 0.0) ORDER BY i) AS grid FROM (
            SELECT fold, slot, unnest(range(1, 20)) AS i, unnest(list_sort(grid)) AS q,
                   unnest(coalesce(delta, list_transform(range(19), lambda x: 0.0))) AS d
            FROM {p}_grid LEFT JOIN {p}_delta USING (fold)) GROUP BY 1, 2""",
        [f"{p}_grid", f"{p}_delta"],
    )
    return base


CTES: dict[str, tuple[str, list[str]]] = {
    "ent": (
        """SELECT p_partkey AS entity, CAST(1994 + p_partkey % 6 AS INT) AS cohort, p_size AS slot,
               p_type AS position, p_brand AS franchise, p_name AS name, p_retailprice AS price FROM part""",
        [],
    ),
    "seasons": (
        f"""SELECT s.*, cohort FROM (
            SELECT l_partkey AS entity, CAST(year(l_shipdate) AS INT) AS period,
              round(sum(l_extendedprice * (1 - l_discount)), 4) / 1e5 AS a,
              sum(l_quantity) / 100 AS b, sum(l_quantity) * 20 AS minutes,
              CAST(count(*) AS DOUBLE) AS games,
              CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS starts,
              bool_or(l_returnflag = 'R' AND l_quantity >= 46) AS star,
              bool_or(l_returnflag = 'A' AND l_quantity >= 50) AS league,
              bool_or(l_returnflag = 'N' AND l_quantity >= 48) AS solid,
              round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 4) / 1e6 AS po_a,
              sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / 1000 AS po_b
            FROM lineitem GROUP BY 1, 2) s JOIN ent USING (entity)
        WHERE period > cohort AND period <= {LAST}""",
        ["ent"],
    ),
    "vals": (
        f"""SELECT s.*, round(((a - mu_a) / sd_a + (b - mu_b) / sd_b) / 2
                 - ((0 - mu_a) / sd_a + (0 - mu_b) / sd_b) / 2, 6) AS value,
               round((po_a / sd_a + po_b / sd_b) / 2, 6) AS value_extra
        FROM seasons s, (SELECT avg(a) mu_a, stddev_samp(a) sd_a, avg(b) mu_b, stddev_samp(b) sd_b
                         FROM seasons WHERE cohort <= {TRAIN_LAST}) t""",
        ["seasons"],
    ),
    "panel": (
        f"""SELECT e.*, n, cohort + n AS period, coalesce(value, 0.0) AS value,
               coalesce(value_extra, 0.0) AS value_extra, coalesce(v.a, 0.0) AS a,
               coalesce(minutes, 0.0) AS minutes, coalesce(games, 0.0) AS games, coalesce(starts, 0.0) AS starts,
               coalesce(star, FALSE) AS star, coalesce(league, FALSE) AS league, coalesce(solid, FALSE) AS solid,
               v.entity IS NOT NULL AS active
        FROM (SELECT *, CAST(unnest(range(1, {LAST} - cohort + 1)) AS INT) AS n FROM ent) e
        LEFT JOIN (SELECT * EXCLUDE (cohort) FROM vals) v ON v.entity = e.entity AND v.period = e.cohort + e.n""",
        ["ent", "vals"],
    ),
    "otn": (
        f"""SELECT entity, cohort, slot, position, franchise, name, price, n, period, active, value, value_extra,
              round(max(t_value) OVER w, 6) AS peak, round(max(t_graded) OVER w, 6) AS peak_graded,
              round(sum(value) OVER w, 6) AS total,
              round(max(t_minutes) OVER w, 6) AS best_minutes, round(max(t_starts) OVER w, 6) AS best_starts,
              sum(minutes) OVER w AS sum_minutes, sum(active::INT) OVER w AS periods_active,
              sum((minutes >= {ROTATION_MINUTES})::INT) OVER w AS longevity,
              sum(star::INT) OVER w AS stars, sum(league::INT) OVER w AS leagues, sum(solid::INT) OVER w AS solids
        FROM (SELECT *, sum(value) OVER t / 3 AS t_value, sum(value + value_extra) OVER t / 3 AS t_graded,
                sum(minutes) OVER t / 3 AS t_minutes, sum(starts) OVER t / 3 AS t_starts
              FROM panel WINDOW t AS (PARTITION BY entity ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
        WINDOW w AS (PARTITION BY entity ORDER BY n)""",
        ["panel"],
    ),
    "tgt": (
        f"""SELECT ent.*, o.peak AS y FROM ent
        LEFT JOIN (SELECT entity, peak FROM otn WHERE n = {HORIZON}) o USING (entity)""",
        ["ent", "otn"],
    ),
    **slot_model_ctes("sm", "tgt", HORIZON, FOLDS),
    **slot_model_ctes("cm", "tgt", HORIZON, FOLDS, calib=1, min_fit=1),
    "sp": (
        "SELECT t.entity, t.cohort, t.slot, t.position, t.franchise, t.y, g.grid FROM tgt t "
        "JOIN sm_pred g ON g.fold = t.cohort AND g.slot = t.slot WHERE t.y IS NOT NULL",
        ["tgt", "sm_pred"],
    ),
    "cp": (
        "SELECT t.entity, t.cohort, t.slot, t.position, t.franchise, t.y, list_sort(g.grid) AS grid FROM tgt t "
        "JOIN cm_pred g ON g.fold = t.cohort AND g.slot = t.slot WHERE t.y IS NOT NULL",
        ["tgt", "cm_pred"],
    ),
    "shots": (
        """SELECT l_partkey AS id, CAST(year(l_shipdate) AS INT) AS season,
              CAST((l_orderkey * 7 + l_linenumber * 13) % 51 AS DOUBLE) - 25 AS dx0,
              CAST((l_orderkey * 11 + CAST(l_quantity AS BIGINT) * 3) % 33 AS DOUBLE) - 3 AS dy0,
              (l_orderkey + l_linenumber) % 3 = 0 AS is_three, l_returnflag = 'R' AS made, l_linestatus AS status
        FROM lineitem""",
        [],
    ),
}


def with_ctes(body: str, names: list[str]) -> str:
    """Prefix a statement with the CTEs it names and what those need, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for dep in CTES[name][1]:
            add(dep)
        done.append(name)

    for name in names:
        add(name)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in done) + "\n" + body
