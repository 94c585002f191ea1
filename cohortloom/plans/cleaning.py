"""Projections, scalar cleaning and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import clean as C
from ..functions import court as X
from ..functions import names as N
from ..functions import rates as R
from ..functions.common import ladder, lookup, ratio, true
from ..operators import aggregates as A
from ..operators import folds as FO
from ..operators import ranking as RK
from ..operators import spatial as SP
from .bindings import LAST
from .registry import query

k = F.col


@query(
    "prj1_parse_number",
    """SELECT p_partkey, TRY_CAST(nullif(regexp_replace(trim(s), '[,$%+]', '', 'g'), '') AS DOUBLE) AS num
    FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '$1,' || lpad((p_partkey % 1000)::VARCHAR, 3, '0')
      WHEN 1 THEN ' +' || p_size || '.5' WHEN 2 THEN '' WHEN 3 THEN 'n/a' WHEN 4 THEN p_size || '%'
      ELSE '-.' || p_size END AS s FROM part)""",
    rnd="num",
)
def _(t):
    """Also UDF-1: scalar functions over a column are built-in expressions."""
    key, size = k("p_partkey"), k("p_size").cast("string")
    s = (
        F.when(key % 6 == 0, F.concat(F.lit("$1,"), F.lpad((key % 1000).cast("string"), 3, "0")))
        .when(key % 6 == 1, F.concat(F.lit(" +"), size, F.lit(".5")))
        .when(key % 6 == 2, "").when(key % 6 == 3, "n/a")
        .when(key % 6 == 4, F.concat(size, F.lit("%")))
        .otherwise(F.concat(F.lit("-."), size))
    )
    return t.part.select("p_partkey", C.parse_number(s).alias("num"))


@query(
    "prj2_feet_inches",
    """SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN (p_size % 8) * 12 + p_partkey % 12 END AS inches FROM part""",
    rnd="inches",
)
def _(t):
    h = F.concat((k("p_size") % 8).cast("string"), F.lit("-"), (k("p_partkey") % 12).cast("string"))
    s = F.when(k("p_size") % 7 == 0, "tall").otherwise(h)
    return t.part.select("p_partkey", C.feet_inches(s).alias("inches"))


@query(
    "prj3_end_year",
    """SELECT o_orderkey, year(o_orderdate) + 1 AS end_year,
      year(o_orderdate) || '-' || lpad(((year(o_orderdate) + 1) % 100)::VARCHAR, 2, '0') AS label FROM orders""",
    ints="end_year",
)
def _(t):
    y = F.year("o_orderdate")
    span = F.format_string("%d-%02d", y, F.pmod(y + 1, F.lit(100)))
    end = C.end_year(span)
    return t.orders.select("o_orderkey", end.alias("end_year"), C.span_label(end).alias("label"))


@query(
    "prj4_blank_to_null",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS s_name FROM supplier""",
)
def _(t):
    blanked = t.supplier.select("s_suppkey", F.when(k("s_suppkey") % 3 == 0, "").otherwise(k("s_name")).alias("s_name"))
    return C.blank_to_null(blanked)


@query(
    "prj5_strip_markers",
    """SELECT s_suppkey, s_suppkey % 4 = 0 AS flagged, s_name AS name, n_name AS school,
      'host' || s_suppkey AS team FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _(t):
    name = F.concat("s_name", F.when(k("s_suppkey") % 4 == 0, "*").otherwise(""))
    link = F.concat(F.lit("/teams/host"), k("s_suppkey").cast("string"), F.lit("/2001.html"))
    s = t.supplier.join(t.nation, k("s_nationkey") == k("n_nationkey"))
    return s.select(
        "s_suppkey", C.marker(name).alias("flagged"), C.strip_marker(name).alias("name"),
        C.strip_suffix(F.concat("n_name", F.lit(" NCAA")), "NCAA").alias("school"),
        C.id_from_link(link, r"/teams/(\w+)/").alias("team"),
    )


@query(
    "prj6_parse_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders""",
)
def _(t):
    s = F.when(k("o_orderkey") % 5 == 0, "unknown").otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return t.orders.select("o_orderkey", C.parse_date(s).alias("d"))


@query(
    "prj7_placeholder_date",
    """SELECT o_orderkey, CASE WHEN NOT (month(o_orderdate) = 10 AND day(o_orderdate) = 15)
      THEN CAST(o_orderdate AS DATE) END AS d FROM orders""",
)
def _(t):
    return t.orders.select("o_orderkey", C.drop_placeholder_date(k("o_orderdate").cast("date")).alias("d"))


@query(
    "prj8_guard_id",
    """SELECT DISTINCT CASE WHEN o_custkey - 5 BETWEEN 1 AND 1000 THEN o_custkey - 5 END AS id,
      year(o_orderdate) AS y, o_orderstatus FROM orders""",
    ints="y",
)
def _(t):
    o = t.orders.select(
        C.guard_id(k("o_custkey") - 5, 1, 1000).alias("id"), F.year("o_orderdate").alias("y"), "o_orderstatus"
    )
    return o.dropDuplicates(["id", "y", "o_orderstatus"])


@query(
    "prj9_select_rename",
    """SELECT s_suppkey AS id, s_name AS tm_name, s_acctbal AS tm_balance, CAST(NULL AS VARCHAR) AS tm_conf
    FROM supplier""",
)
def _(t):
    kept = C.select_known(t.supplier, {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance", "s_conf": "conf"})
    return C.suffix_columns(kept, prefix="tm_", keep=["id"])


@query(
    "prj10_range_filter",
    "SELECT p_partkey, p_size FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND p_size > 10 AND p_name IS NOT NULL",
)
def _(t):
    keep = k("p_type").isin("ECONOMY", "SMALL") & (k("p_size") > 10) & k("p_name").isNotNull()
    return t.part.where(keep).select("p_partkey", "p_size")


@query(
    "prj11_stage_projection",
    """SELECT DISTINCT o_custkey AS id, year(o_orderdate) + 1 AS season, o_orderstatus = 'F' AS played
    FROM orders WHERE o_totalprice IS NOT NULL""",
    ints="season",
)
def _(t):
    return (
        t.orders.dropna(subset=["o_totalprice"])
        .select(
            k("o_custkey").alias("id"), (F.year("o_orderdate") + 1).alias("season"),
            (k("o_orderstatus") == "F").alias("played"),
        )
        .dropDuplicates()
    )


@query(
    "prj12_award_rows",
    """SELECT entity, period, award, level, vote_rank, coalesce(award <> 'vote' AND level IN ('1st', '2nd', '3rd'), FALSE)
        OR coalesce(award = 'vote' AND vote_rank = 1, FALSE) AS selected
    FROM (SELECT l_partkey AS entity, year(l_shipdate) AS period,
      CASE l_returnflag WHEN 'R' THEN 'league' WHEN 'A' THEN 'defense' ELSE 'vote' END AS award,
      CASE WHEN l_returnflag IN ('R', 'A') THEN
        CASE CAST(l_quantity AS INT) % 5 WHEN 1 THEN '1st' WHEN 2 THEN '2nd' WHEN 3 THEN '3rd' WHEN 4 THEN 'ORV' END END AS level,
      CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS INT) % 4 END AS vote_rank FROM lineitem)""",
    ints="period vote_rank",
)
def _(t):
    flag, q = k("l_returnflag"), k("l_quantity").cast("int")
    code = ladder([(q % 5 == 1, "1T"), (q % 5 == 2, "2T"), (q % 5 == 3, "3rd"), (q % 5 == 4, "ORV")])
    rows = t.lineitem.select(
        k("l_partkey").alias("entity"), F.year("l_shipdate").alias("period"),
        lookup("l_returnflag", {"R": "league", "A": "defense"}, F.lit("vote")).alias("award"),
        F.when(flag == "R", code).alias("league_team"), F.when(flag == "A", code).alias("defense_team"),
        F.when(flag == "N", q % 4).alias("vote_rank"),
    )
    team = F.coalesce("league_team", "defense_team")
    level = lookup(team, {"1T": "1st", "2T": "2nd", "3T": "3rd"}, team)
    by_team = k("award").isin("league", "defense")
    chosen = (by_team & true(level.isin("1st", "2nd", "3rd"))) | (~by_team & true(k("vote_rank") == 1))
    return rows.select("entity", "period", "award", level.alias("level"), "vote_rank", chosen.alias("selected"))


@query(
    "prj13_reclassify_text",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 <> 1 THEN 'traded'
      WHEN s_suppkey % 4 = 1 THEN 'drafted' ELSE 'other' END AS kind FROM supplier""",
)
def _(t):
    text = F.concat("s_name", F.when(k("s_suppkey") % 3 == 0, " was Traded by a club").otherwise(" was waived"))
    kind = F.when(k("s_suppkey") % 4 == 1, "drafted").otherwise("other")
    moved = text.rlike(r"(?i)\btraded by\b") & (kind != "drafted")
    return t.supplier.select("s_suppkey", F.when(moved, "traded").otherwise(kind).alias("kind"))


_NORM = """array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(
  {fold}, '[.''`’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '),
  lambda w: w NOT IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v')), ' ')"""
_FOLD = "replace(replace(replace(strip_accents(lower({c})), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"


@query(
    "prj14_normalize_name",
    "SELECT doc_id, md5(" + _NORM.format(fold=_FOLD.format(c="text")) + ") AS norm FROM documents "
    "UNION ALL SELECT -1 - p_partkey, md5(" + _NORM.format(fold="lower(p_name || ' Jr. O''' || p_type || ' III')") + ") FROM part",
)
def _(t):
    docs = t.documents.select("doc_id", F.md5(N.normalize_name("text", aliases={})).alias("norm"))
    raw = F.concat("p_name", F.lit(" Jr. O'"), "p_type", F.lit(" III"))
    return docs.unionByName(t.part.select((-1 - k("p_partkey")).alias("doc_id"), F.md5(N.normalize_name(raw)).alias("norm")))


@query(
    "prj15_normalize_school",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'saint ' || lower(c_mktsegment)
      WHEN 1 THEN lower(c_mktsegment) || ' state' WHEN 2 THEN lower(c_mktsegment) ELSE 'north carolina' END AS school
    FROM customer""",
)
def _(t):
    seg, m = k("c_mktsegment"), k("c_custkey") % 4
    raw = (
        F.when(m == 0, F.concat(F.lit("St. "), seg)).when(m == 1, F.concat(seg, F.lit(" St. (FL)")))
        .when(m == 2, F.concat(F.lit("The University of "), seg)).otherwise("UNC")
    )
    return t.customer.select("c_custkey", N.normalize_school(raw).alias("school"))


@query("prj16_token_sort_similarity")
def _(t):
    s = t.supplier.join(t.nation, k("s_nationkey") == k("n_nationkey"))
    a = N.normalize_name(F.concat("s_name", F.lit(" "), "n_name"))
    b = N.normalize_name(F.concat("n_name", F.lit(" Sup-plier "), k("s_suppkey").cast("string")))
    return s.select(
        "s_suppkey", F.round(N.token_sort_ratio(a, b), 6).alias("sort_ratio"),
        F.round(N.token_set_ratio(a, b), 6).alias("set_ratio"),
    )


@query(
    "prj17_shot_kind",
    """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'dunk' WHEN p_partkey % 6 = 1 THEN 'tip'
      WHEN p_partkey % 6 = 2 THEN 'layup' WHEN p_partkey % 6 = 3 OR p_size % 3 = 0 THEN 'three'
      WHEN p_partkey % 6 = 4 THEN 'jumper' ELSE 'unknown' END AS kind FROM part""",
)
def _(t):
    m = k("p_partkey") % 6
    label = ladder(
        [(m == 0, "Tip Dunk Shot"), (m == 1, "TipShot"), (m == 2, "Lay Up"), (m == 3, "3-pt shot"), (m == 4, "Jumper")]
    )
    score = F.when(k("p_size") % 3 == 0, 3)
    return t.part.select("p_partkey", X.shot_kind(label, F.lit(None).cast("string"), score).alias("kind"))


@query(
    "prj18_bands",
    """SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'Picks 1-5' WHEN p_size <= 14 THEN 'Picks 6-14'
        WHEN p_size <= 30 THEN 'Picks 15-30' ELSE 'Picks 31-60' END AS slot_band,
      CASE WHEN 2 * p_size - 1 <= 10 THEN 'RSCI 1-10' WHEN 2 * p_size - 1 <= 25 THEN 'RSCI 11-25'
        WHEN 2 * p_size - 1 <= 50 THEN 'RSCI 26-50' WHEN 2 * p_size - 1 <= 100 THEN 'RSCI 51-100' ELSE 'Unranked' END AS recruit,
      CASE WHEN p_retailprice > 900 AND p_retailprice <= 950 THEN 'low' WHEN p_retailprice > 950 AND p_retailprice <= 1000 THEN 'mid' END AS price_band
    FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey", B.slot_band("p_size").alias("slot_band"),
        B.recruit_group(2 * k("p_size") - 1).alias("recruit"),
        B.band("p_retailprice", [900, 950, 1000], ["low", "mid"]).alias("price_band"),
    )


@query(
    "prj19_digitize",
    """SELECT p_partkey, (p_size >= 5)::INT + (p_size >= 14)::INT + (p_size >= 30)::INT AS left_closed,
      (p_size > 5)::INT + (p_size > 14)::INT + (p_size > 30)::INT AS right_closed FROM part""",
    ints="left_closed right_closed",
)
def _(t):
    cuts = [5, 14, 30]
    return t.part.select(
        "p_partkey", B.digitize("p_size", cuts).alias("left_closed"),
        B.digitize("p_size", cuts, right_closed=True).alias("right_closed"),
    )


@query(
    "prj20_step_lookup",
    """SELECT DISTINCT year(o_orderdate) AS season, CASE WHEN year(o_orderdate) + 12 <= 2008 THEN 19.75
      WHEN year(o_orderdate) + 12 <= 2019 THEN 20.75 ELSE 22.146 END AS college,
      CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1997 THEN 22.0 ELSE 23.75 END AS pro FROM orders""",
    ints="season", rnd="college pro",
)
def _(t):
    s = t.orders.select(F.year("o_orderdate").alias("season")).distinct()
    return s.select("season", X.college_line(k("season") + 12).alias("college"), X.pro_line("season").alias("pro"))


_BOX = """(SELECT l_partkey AS entity, sum(l_quantity) AS fga, count(*) AS g,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS orb,
  sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE 0 END) AS tov, sum(l_linenumber) AS fta,
  sum(l_quantity * 2 - l_linenumber) AS pts FROM lineitem GROUP BY 1)"""


def _box(t):
    return t.lineitem.groupBy(k("l_partkey").alias("entity")).agg(
        F.sum("l_quantity").alias("fga"), F.count(F.lit(1)).alias("g"),
        F.sum(F.when(k("l_returnflag") == "R", k("l_quantity")).otherwise(0.0)).alias("orb"),
        F.sum(F.when(k("l_linestatus") == "O", k("l_linenumber")).otherwise(0)).alias("tov"),
        F.sum("l_linenumber").alias("fta"), F.sum(k("l_quantity") * 2 - k("l_linenumber")).alias("pts"),
    )


@query(
    "prj21_possessions",
    f"SELECT entity, fga - orb + tov + 0.475 * fta AS poss, pts / (2 * (fga + 0.44 * fta)) AS ts FROM {_BOX}",
    rnd="poss ts",
)
def _(t):
    return _box(t).select(
        "entity", R.possessions("fga", "orb", "tov", "fta").alias("poss"), R.true_shooting("pts", "fga", "fta").alias("ts")
    )


@query(
    "prj22_guarded_ratio",
    f"""SELECT entity, CASE WHEN tov > 0 THEN orb / tov END AS rate, CASE WHEN orb > 0 THEN pts * 40 / orb END AS per40
    FROM {_BOX}""",
    rnd="rate per40",
)
def _(t):
    return _box(t).select("entity", ratio("orb", "tov").alias("rate"), R.per("pts", "orb").alias("per40"))


@query(
    "prj23_published_or_derived",
    f"""SELECT entity, coalesce(pub, der) AS usg_pct,
      CASE WHEN pub IS NOT NULL THEN 'published' WHEN der IS NOT NULL THEN 'derived' END AS usg_pct_source
    FROM (SELECT entity, CASE WHEN entity % 3 = 0 THEN CAST(entity % 40 AS DOUBLE) END AS pub,
      CASE WHEN orb >= 40 THEN 100 * (fga + 0.44 * fta + tov) * (g * 40) / (orb * (fga * 9 + 0.44 * fta * 9 + tov * 9)) END AS der
      FROM {_BOX})""",
    rnd="usg_pct",
)
def _(t):
    five = k("g") * 40
    usg = R.usage_rate(k("fga"), k("fta"), k("tov"), k("orb"), five, k("fga") * 9, k("fta") * 9, k("tov") * 9)
    box = _box(t).withColumns(
        {"pub": F.when(k("entity") % 3 == 0, (k("entity") % 40).cast("double")), "der": F.when(k("orb") >= 40, usg)}
    )
    cols = R.published_or_derived("pub", "der", "usg_pct")
    return box.select("entity", *[c.alias(n) for n, c in cols.items()])


@query(
    "prj24_age_at_date",
    """SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), make_date(2015, 6, 25)) / 365.25 AS age FROM orders""",
    rnd="age",
)
def _(t):
    return t.orders.select("o_orderkey", R.age_at(F.lit(2015), k("o_orderdate").cast("date")).alias("age"))


@query(
    "prj25_one_hot",
    """SELECT p_partkey, (p_type = 'ECONOMY')::INT AS pos_ECONOMY, (p_type = 'SMALL')::INT AS pos_SMALL,
      CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 3 END AS code FROM part""",
    ints="pos_ECONOMY pos_SMALL code",
)
def _(t):
    flags = R.one_hot("p_type", ["ECONOMY", "SMALL"], "pos_")
    code = lookup("p_type", {"ECONOMY": 1, "SMALL": 2, "MEDIUM": 3})
    return t.part.select("p_partkey", *[c.alias(n) for n, c in flags.items()], code.alias("code"))


@query(
    "prj26_target_transforms",
    """SELECT p_partkey, ln(1 + greatest(y, 0) / 0.25) AS t_log, sqrt(greatest(y, 0)) AS t_sqrt, greatest(y, 0) AS back_log,
      greatest(y, 0) AS back_sqrt, ln(p_size) AS log_slot FROM (SELECT *, (p_retailprice - 950) / 10 AS y FROM part)""",
    rnd="t_log t_sqrt back_log back_sqrt log_slot",
)
def _(t):
    y = (k("p_retailprice") - 950) / 10
    return t.part.select(
        "p_partkey", R.to_log(y).alias("t_log"), R.to_sqrt(y).alias("t_sqrt"),
        R.from_log(R.to_log(y)).alias("back_log"), R.from_sqrt(R.to_sqrt(y)).alias("back_sqrt"),
        F.log(k("p_size").cast("double")).alias("log_slot"),
    )


@query(
    "prj27_court_coordinates",
    """SELECT l_partkey, count(*) AS n, sum(l_quantity - 25) AS dx, sum(l_linenumber - 1.0) AS dy, sum(l_quantity / 10) AS px
    FROM lineitem GROUP BY 1""",
    rnd="dx dy px",
)
def _(t):
    c, p = X.college_xy("l_quantity", "l_linenumber"), X.pro_xy("l_quantity", "l_linenumber")
    return t.lineitem.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(c["dx"]).alias("dx"), F.sum(c["dy"]).alias("dy"), F.sum(p["dx"]).alias("px")
    )


_XY = """(SELECT *, CASE WHEN NOT bad THEN dx0 END AS dx, CASE WHEN NOT bad THEN dy0 END AS dy,
  CASE WHEN NOT bad THEN d END AS dist, CASE WHEN NOT bad THEN dx0 * 22.146 / line END AS sx,
  CASE WHEN NOT bad THEN dy0 * 22.146 / line END AS sy FROM (
  SELECT *, (is_three AND d < used - 2) OR (NOT is_three AND d > used + 2) AS bad FROM (
  SELECT *, CASE WHEN abs(dx0) >= 21.5 THEN 22.0 ELSE line END AS used FROM (
  SELECT *, sqrt(dx0 * dx0 + dy0 * dy0) AS d, CASE WHEN season BETWEEN 1995 AND 1997 THEN 22.0 ELSE 23.75 END AS line
  FROM shots))))"""
_ZONE = """CASE WHEN NOT is_three AND dist < 4 THEN 'rim' WHEN NOT is_three AND dist < 14 THEN 'short_mid'
  WHEN NOT is_three AND dist >= 14 THEN 'long_mid' WHEN is_three AND abs(dx) >= 20 AND dy <= 8 THEN 'corner_three'
  WHEN is_three AND dist IS NOT NULL THEN 'above_break_three' END"""


def court_shots(t):
    s = t.shots.withColumn("line", X.pro_line("season"))
    s = SP.with_consistent_xy(s, "dx0", "dy0", "is_three", "line", X.CORNER_LINE)
    return s.withColumn("zone", X.zone("dist", "dx", "dy", "is_three"))


@query(
    "prj28_consistent_xy",
    f"""SELECT id, count(*) AS n, count(dx) AS valid, sum(dist) AS dist, sum(sx) AS sx, sum(sy) AS sy FROM {_XY} GROUP BY 1""",
    "shots", rnd="dist sx sy", places=5,
)
def _(t):
    return court_shots(t).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("xy_valid").alias("valid"), F.sum("dist").alias("dist"),
        F.sum("sx").alias("sx"), F.sum("sy").alias("sy"),
    )


@query(
    "prj29_zone_label",
    f"SELECT id, {_ZONE} AS zone, count(*) AS n FROM {_XY} GROUP BY 1, 2",
    "shots",
)
def _(t):
    return court_shots(t).groupBy("id", "zone").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj30_trailing_parenthesis",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Land ' || s_nationkey END AS country FROM supplier""",
)
def _(t):
    land = F.concat(F.lit(" (Land "), k("s_nationkey").cast("string"), F.lit(") "))
    org = F.concat("s_name", F.when(k("s_suppkey") % 3 == 0, land).when(k("s_suppkey") % 3 == 1, " (FL)").otherwise(""))
    return t.supplier.select("s_suppkey", C.trailing_parenthesis(org).alias("country"))


@query(
    "prj31_status_ladders",
    f"""SELECT entity, CASE WHEN retired AND n > 0 THEN 'Career Grade (retired)' WHEN n = 0 THEN 'Projection'
        WHEN n = 1 THEN 'Provisional (low confidence)' WHEN n <= 3 THEN 'Provisional (medium confidence)'
        WHEN n < 4 THEN 'Year-4 Verdict' ELSE 'Career Grade' END AS status,
      CASE WHEN leagues >= 3 THEN 'Legend' WHEN stars >= 2 THEN 'MVP' WHEN solids >= 2 THEN 'Superstar' END AS honour,
      CASE WHEN leagues > 0 THEN 5 WHEN stars > 0 THEN 4 WHEN best_starts >= 41 AND best_minutes >= 1800 THEN 3
        WHEN best_minutes >= 1000 THEN 2 WHEN sum_minutes >= 1000 THEN 1 ELSE 0 END AS anchor,
      CASE WHEN slot > 40 THEN 'no NBA value' WHEN slot <= 1 THEN '#1 or better' ELSE '#' || slot END AS label
    FROM (SELECT *, NOT active AS retired FROM otn WHERE period = {LAST})""",
    "otn", ints="anchor",
)
def _(t):
    o = t.otn.where(k("period") == LAST).withColumn("retired", ~k("active"))
    honours = B.honour(k("leagues") + 7, k("solids"), F.when(k("stars") >= 2, 1).otherwise(0), F.lit(0))
    return o.select(
        "entity", B.career_status("n", "retired", 4).alias("status"), honours.alias("honour"),
        B.role_anchor(k("leagues"), k("stars"), k("best_starts"), k("best_minutes"), k("sum_minutes")).alias("anchor"),
        B.equivalent_label(F.when(k("slot") <= 40, k("slot"))).alias("label"),
    )


@query(
    "prj32_code_alias",
    """SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'Brand#11' WHEN 'Brand#2' THEN 'Brand#12' ELSE p_brand END AS franchise
    FROM part""",
)
def _(t):
    moved = t.part.replace({"Brand#1": "Brand#11", "Brand#2": "Brand#12"}, subset=["p_brand"])
    return moved.select("p_partkey", k("p_brand").alias("franchise"))


# ------------------------------------------------------------------------------- predicates


@query(
    "flt1_known_at_cohort",
    """SELECT e.entity, count(*) AS rows_all, count(*) FILTER (WHERE s.cohort IS NULL OR year(l_shipdate) <= s.cohort) AS rows_known
    FROM lineitem JOIN ent e ON l_partkey = e.entity
    JOIN (SELECT entity, CASE WHEN entity % 7 <> 0 THEN cohort END AS cohort FROM ent) s ON s.entity = e.entity GROUP BY 1""",
    "ent",
)
def _(t):
    e = t.ent.select("entity", F.when(k("entity") % 7 != 0, k("cohort")).alias("cohort"))
    rows = t.lineitem.select(k("l_partkey").alias("entity"), F.year("l_shipdate").alias("period")).join(e, "entity")
    return FO.is_known_by(rows, "period", "cohort").groupBy("entity").agg(
        F.count(F.lit(1)).alias("rows_all"), F.count_if("is_known").alias("rows_known")
    )


@query(
    "flt2_cohort_filter",
    """SELECT entity, cohort FROM ent WHERE position = 'ECONOMY' AND entity IN
      (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 100) AND cohort IN (SELECT DISTINCT cohort FROM otn WHERE n = 2)""",
    "ent otn", ints="cohort",
)
def _(t):
    enough = t.lineitem.groupBy(k("l_partkey").alias("entity")).agg(F.sum("l_quantity").alias("q")).where("q >= 100")
    complete = t.otn.where("n = 2").select("cohort").distinct()
    e = t.ent.where("position = 'ECONOMY'")
    return e.join(enough, "entity", "left_semi").join(complete, "cohort", "left_semi").select("entity", "cohort")


@query(
    "flt3_eligible_groups",
    f"""SELECT id, count(dx) AS valid, count(dx) / count(*) AS coverage FROM {_XY} GROUP BY 1
    HAVING count(dx) >= 10 AND count(dx) / count(*) >= 0.4""",
    "shots", rnd="coverage",
)
def _(t):
    g = court_shots(t).groupBy("id").agg(
        F.count_if("xy_valid").alias("valid"), A.share(k("xy_valid")).alias("coverage")
    )
    return g.where((k("valid") >= 10) & (k("coverage") >= 0.4))


@query(
    "flt4_anti_membership",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
)
def _(t):
    big = t.orders.where("o_totalprice > 300000").select(k("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_anti").select("c_custkey")


@query(
    "flt5_regex_exclusion",
    """SELECT doc_id FROM documents WHERE NOT regexp_matches(coalesce(CASE WHEN doc_id % 9 <> 0 THEN text END, ''), '[0-9]{4} ')""",
)
def _(t):
    text = F.when(k("doc_id") % 9 != 0, k("text"))
    return t.documents.where(~F.coalesce(text, F.lit("")).rlike(r"[0-9]{4} ")).select("doc_id")


@query(
    "flt6_complete_rows",
    """SELECT position, count(*) AS n FROM tgt LEFT JOIN (SELECT entity, max(value) AS best FROM vals GROUP BY 1) USING (entity)
    WHERE y IS NOT NULL AND best IS NOT NULL GROUP BY 1""",
    "tgt vals",
)
def _(t):
    best = t.vals.groupBy("entity").agg(F.max("value").alias("best"))
    full = t.tgt.join(best, "entity", "left").dropna(subset=["y", "best"])
    return full.groupBy("position").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt7_holdout_window",
    "SELECT entity, y FROM tgt WHERE cohort BETWEEN 1996 AND 1997 AND y IS NOT NULL",
    "tgt", rnd="y",
)
def _(t):
    return t.tgt.where(k("cohort").between(1996, 1997) & k("y").isNotNull()).select("entity", "y")


def rankings(df, years=None, first_round=None, tiers=None, finished=None, query=None, by="peak"):
    """User filters in one place; ranks within the filter, the search keeps the rank."""
    if years:
        df = df.where(k("cohort").between(*years))
    if first_round is not None:
        df = df.where((k("slot") <= 30) if first_round else (k("slot") > 30))
    if tiers:
        df = df.where(k("tier").isin(*tiers))
    if finished is not None:
        df = df.where(k("finished") == finished)
    ranked = RK.with_position(df.where(k(by).isNotNull()), by, "entity", name="rank")
    return ranked.where(F.lower("name").contains(query.lower())) if query else ranked


@query(
    "flt8_user_filters",
    f"""SELECT entity, rank, peak FROM (SELECT *, row_number() OVER (ORDER BY peak DESC, entity) AS rank FROM otn
      WHERE period = {LAST} AND cohort BETWEEN 1994 AND 1997 AND slot <= 30 AND peak >= 1.2) WHERE contains(lower(name), 'ring')""",
    "otn", ints="rank", rnd="peak",
)
def _(t):
    o = t.otn.where(k("period") == LAST).withColumn("tier", B.digitize("peak", [1.2]))
    return rankings(o, (1994, 1997), True, [1], query="Ring").select("entity", "rank", "peak")


@query(
    "flt9_latest_before",
    """SELECT entity, period, a FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS rn
      FROM seasons WHERE period <= cohort + 2) WHERE rn = 1""",
    "seasons", ints="period", rnd="a",
)
def _(t):
    s = t.seasons.where(k("period") <= k("cohort") + 2)
    return RK.latest(s, ["entity"], [k("period").desc()]).select("entity", "period", "a")
