"""Sources, sinks and streams on data derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import joins as J
from ..session import shared_dir
from ..sources import documents as D
from ..sources import pages as PG
from ..sources import tables as TB
from ..sources import text as TX
from ..streaming import refresh as RF
from .registry import query

k = F.col
TASKS = 8  # the pages here lie in one small file


def scratch(t) -> str:
    return f"{shared_dir(t.spark)}/cohortloom/io-{uuid.uuid4().hex}"


def cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def s(name):
    return F.col(name).cast("string")


@query("src2_parquet_read", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1")
def _(t):
    """Also SRC-1: the path is that of a layer, source and name."""
    return t.part.where("p_size > 25").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("src3_parquet_write", "SELECT p_partkey, p_size, (SELECT count(*) FROM part) AS rows_n FROM part", ints="p_size rows_n")
def _(t):
    root = scratch(t)
    rows = TB.write_table(t.part, root, "staging", "shop", "parts")
    return TB.read_table(t.spark, root, "staging", "shop", "parts").select("p_partkey", "p_size", F.lit(rows).alias("rows_n"))


@query("src4_period_scan", "SELECT year(o_orderdate) AS season, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1", ints="season")
def _(t):
    root = scratch(t)
    TB.write_table(t.orders.withColumn("season", F.year("o_orderdate")), root, "raw", "shop", "orders", ["season"])
    d = TB.scan_periods(t.spark, TB.table_path(root, "raw", "shop", "orders"))
    return d.where("season >= 1998").groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query("src5_layer_registration", "SELECT r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _(t):
    names = TB.register_layer(
        t.spark, {("staging", "geo-graphy", n): f"{t.sf_dir}/{n}.parquet" for n in ("region", "nation")}
    )
    return t.spark.sql(f"SELECT r_name, count(*) AS nations FROM {names[0]} JOIN {names[1]} ON n_regionkey = r_regionkey GROUP BY 1")


@query("src6_headerless_csv", "SELECT p_partkey::VARCHAR AS id, p_name AS name, p_size::VARCHAR AS size FROM part")
def _(t):
    path = scratch(t)
    t.part.select("p_partkey", "p_name", "p_size").write.csv(path)
    return TX.headerless_csv(t.spark, path, ["id", "name", "size"])


@query("src7_header_repair_csv", "SELECT s_suppkey::VARCHAR AS rk, s_name AS fun_rk, s_nationkey::VARCHAR AS adjt FROM supplier")
def _(t):
    """The header, with one quoted cell for two columns, is read from the file."""
    path = scratch(t)
    lines = t.supplier.select(F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey").alias("value"))
    header = t.spark.createDataFrame([('Rk,"Fun Rk., adjt"',)], "value string")
    header.unionByName(lines).coalesce(1).write.text(path)
    return TX.repaired_csv(t.spark, path)


@query(
    "src23_override_csv",
    "SELECT s_suppkey::VARCHAR AS id, 'link' AS field, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_nationkey::VARCHAR END AS value FROM supplier",
)
def _(t):
    path = scratch(t)
    value = F.when(k("s_suppkey") % 2 == 0, "").otherwise(s("s_nationkey"))
    t.supplier.select(s("s_suppkey").alias("id"), F.lit("link").alias("field"), value.alias("value")).write.option("header", True).csv(path)
    return TX.commented_csv(t.spark, path)


def draft_pages(t):
    """One page per part: a hidden table with two rounds, a repeated header and two picks."""
    key = s("p_partkey")

    def row(pick, pid, name):
        return cat(
            '<tr><th data-stat="pick_overall">', pick, '</th><td data-stat="team_id"><a href="/teams/T', s("p_size"), '/">T', s("p_size"),
            '</a></td><td data-stat="player" data-append-csv="', pid, '"><a href="/players/x/', pid, '.html">', name, "</a></td></tr>",
        )

    html = cat(
        '<html><body><table id="other"><tr><td data-stat="a">1</td></tr></table><!-- <table id="stats"><thead><tr><th>head</th></tr></thead><tbody>',
        '<tr class="over_header"><th>Round 1</th></tr>', row(s("p_size"), cat("p", key), k("p_name")),
        '<tr class="thead"><th data-stat="pick_overall">Pk</th></tr><tr class="over_header"><th>Round 2</th></tr>',
        row((k("p_size") + 30).cast("string"), cat("q", key), F.upper("p_name")), '<tr><td data-stat="player">none</td></tr></tbody></table> --></body></html>',
    )
    return t.part.select(k("p_partkey").alias("page_id"), cat("/draft/", key).alias("url"), html.alias("html"))


@query(
    "src8_html_table_rows",
    """SELECT p_partkey AS page_id, p_size::VARCHAR AS pick, p_name AS player, '/players/x/p' || p_partkey || '.html' AS href, 'p' || p_partkey AS pid FROM part
    UNION ALL SELECT p_partkey, (p_size + 30)::VARCHAR, upper(p_name), '/players/x/q' || p_partkey || '.html', 'q' || p_partkey FROM part
    UNION ALL SELECT p_partkey, NULL, 'none', NULL, NULL FROM part""",
)
def _(t):
    """Also UDF-7: a page in, its rows out."""
    rows = PG.data_rows(PG.table_rows(draft_pages(t), tasks=TASKS), "stats")
    return rows.select(
        "page_id", PG.cell("pick_overall").alias("pick"), PG.cell("player").alias("player"), PG.cell("player__href").alias("href"),
        PG.cell("player__id").alias("pid"),
    )


@query(
    "src9_rounds_carried_down",
    """SELECT p_partkey AS page_id, 1 AS round, p_size AS pick, 'T' || p_size AS team, 'p' || p_partkey AS player_id FROM part
    UNION ALL SELECT p_partkey, 2, p_size + 30, 'T' || p_size, 'q' || p_partkey FROM part""",
    ints="round pick",
)
def _(t):
    return PG.ranked_rounds(PG.table_rows(draft_pages(t), tasks=TASKS), "stats").select("page_id", "round", "pick", "team", "player_id")


@query(
    "src10_bio_fields",
    """SELECT c_custkey AS page_id, 'Shooting Guard' AS position, 'Right' AS shoots, 190 + c_custkey % 20 AS height_cm, 72 + c_custkey % 12 AS height_in, 210 AS weight_lb, 95 AS weight_kg,
      lower(c_mktsegment) AS colleges, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 100 + 1 END AS recruit_rank, CASE WHEN c_custkey % 3 = 0 THEN 2010 END AS recruit_year,
      CASE WHEN c_custkey % 4 = 0 THEN 'Old School in Town' END AS high_school, 'Team, 1st round' AS draft_text, 'October 3, 2012' AS debut, 'Town ' || c_nationkey AS birthplace,
      CASE WHEN c_custkey % 5 > 0 THEN 'us' END AS birth_country, CAST('1980-01-01' AS DATE) + CAST(c_custkey % 3000 AS INT) AS birth_date,
      CASE WHEN c_custkey % 2 = 0 THEN 'player-' || c_custkey || '-1' END AS college_id FROM customer""",
    ints="height_cm height_in weight_lb weight_kg recruit_rank recruit_year",
)
def _(t):
    key = k("c_custkey")
    born = F.date_add(F.lit("1980-01-01").cast("date"), (key % 3000).cast("int"))
    html = cat(
        '<div><div id="meta"><p>Position: <b>Shooting Guard</b> ▪ Shoots: Right</p><p>6-', (key % 12).cast("string"), ", 210lb (", (190 + key % 20).cast("string"),
        'cm, 95kg)</p><p>Born: <span id="necro-birth" data-birth="', born.cast("string"), '">May 1</span> in Town ', s("c_nationkey"),
        F.when(key % 5 > 0, " us").otherwise(""), "</p><p>College: <a>", F.lower("c_mktsegment"), "</a></p>",
        F.when(key % 4 == 0, "<p>High School: Old School in Town</p>").otherwise(""),
        F.when(key % 3 == 0, cat("<p>Recruiting Rank: 2010 (", (key % 100 + 1).cast("string"), ")</p>")).otherwise(""),
        "<p>Draft: Team, 1st round</p><p>NBA Debut: October 3, 2012</p><p>Career Length: 3 years</p></div><p>after</p>",
        F.when(key % 2 == 0, cat('<a href="https://www.example.org/cbb/players/player-', s("c_custkey"), '-1.html">College</a>')).otherwise(""), "</div>",
    )
    return PG.player_bios(t.customer.select(key.alias("page_id"), html.alias("html")), tasks=TASKS).select(
        "page_id", "position", "shoots", "height_cm", "height_in", "weight_lb", "weight_kg", "colleges", "recruit_rank", "recruit_year", "high_school", "draft_text",
        "debut", "birthplace", "birth_country", "birth_date", "college_id")


def move_pages(t):
    key = s("o_orderkey")
    when = F.date_format("o_orderdate", "MMMM d, yyyy")
    team_a, team_b = (k("o_custkey") % 30).cast("string"), (k("o_custkey") % 29 + 30).cast("string")
    html = cat(
        '<div id="div_transactions"><p class="transaction"><strong>', when, '</strong>: Drafted by the <a data-attr-to="T', team_a, '" href="/teams/x">A</a></p>',
        '<p class="transaction"><strong>', when, '</strong>: ', F.when(k("o_custkey") % 5 == 0, "As part of a 3-team trade, traded").otherwise("Traded"),
        ' by the <a data-attr-from="T', team_a, '" href="/t">A</a> with <a href="/players/m/m', key, '.html">M</a> and a 2020 draft pick to the <a data-attr-to="T', team_b,
        '" href="/t">B</a>', F.when(k("o_custkey") % 4 == 0, ".").otherwise(cat(' for <a href="/players/n/n', key, '.html">N</a> and a 1st round draft pick (Z was later selected)')),
        "</p></div>",
    )
    return t.orders.select(k("o_orderkey").alias("page_id"), html.alias("html"))


@query(
    "src11_transactions",
    """SELECT o_orderkey AS page_id, CAST(o_orderdate AS DATE) AS date, 'drafted' AS kind, NULL AS team_from, 'T' || (o_custkey % 30) AS team_to FROM orders
    UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE), 'traded', 'T' || (o_custkey % 30), 'T' || (o_custkey % 29 + 30) FROM orders""",
)
def _(t):
    return PG.transactions(move_pages(t), tasks=TASKS).select("page_id", "date", "kind", "team_from", "team_to")


@query(
    "grd12_trade_sides",
    """SELECT o_orderkey AS page_id, 'm' || o_orderkey || ',s' || o_orderkey AS sent, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'n' || o_orderkey END AS received, 1 AS sent_unresolved,
      0 AS received_unresolved, o_custkey % 5 = 0 AS multi_team, o_custkey % 4 <> 0 AS has_return FROM orders""",
    ints="sent_unresolved received_unresolved",
)
def _(t):
    moves = PG.transactions(move_pages(t), tasks=TASKS).withColumn("subject", cat("s", s("page_id")))
    return PG.trade_sides(moves, "subject").select(
        "page_id", F.array_join("sent", ",").alias("sent"), F.array_join("received", ",").alias("received"), "sent_unresolved",
        "received_unresolved", "multi_team", "has_return",
    )


@query(
    "src12_manifest_union",
    """SELECT p_partkey AS page_id, 1994 + p_partkey % 6 AS season, CASE WHEN p_partkey % 2 = 0 THEN 'regular' ELSE 'playoffs' END AS phase, 'p' || p_partkey AS pid FROM part
    UNION ALL SELECT p_partkey, 1994 + p_partkey % 6, CASE WHEN p_partkey % 2 = 0 THEN 'regular' ELSE 'playoffs' END, 'q' || p_partkey FROM part""",
    ints="season",
)
def _(t):
    key = k("p_partkey")
    manifest = t.part.select(
        cat("/draft/", s("p_partkey")).alias("url"), (1994 + key % 6).alias("season"), F.lit("stats").alias("table_id"),
        F.when(key % 2 == 0, "regular").otherwise("playoffs").alias("phase"),
    )
    pages = draft_pages(t)
    rows = PG.data_rows(PG.table_rows(pages, tasks=TASKS), "stats").where(PG.cell("player__id").isNotNull())
    tagged = PG.with_manifest(pages.select("page_id", "url"), manifest.drop("table_id"))
    return rows.join(tagged, "page_id").select("page_id", "season", "phase", PG.cell("player__id").alias("pid"))


@query(
    "src13_page_titles_and_links",
    """SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links FROM pages""",
    ints="links",
)
def _(t):
    d = PG.links_and_title(t.pages)
    return d.select("page_id", "title", F.size("links").alias("links"))


def season_text(year):
    return F.format_string("%d-%02d", year - 1, F.pmod(year, F.lit(100)))


def reference_pages(t):
    """One page per order with a table of one kind, by key: finals, averages, cap, index, or a player's tables."""
    key = k("o_orderkey")
    year = F.year("o_orderdate")
    season = season_text(year)
    pid = cat("p", s("o_custkey"))

    def table(name, *cells):
        return cat('<table id="', name, '"><tbody><tr>', *[x for c, v in cells for x in (f'<td data-stat="{c}">', v, "</td>")], "</tr></tbody></table>")

    named = cat('<table id="finals_mvp_NBA"><tbody><tr><th data-stat="season">', season, '</th><td data-stat="player" data-append-csv="', pid, '">n</td></tr>',
                '<tr><th data-stat="season">', season, '</th><td data-stat="player">nobody</td></tr></tbody></table>')
    listed = cat('<table id="players"><tbody><tr><th data-stat="player" data-append-csv="', pid, '">n</th><td data-stat="year_min">', (year - 3).cast("string"),
                 '</td><td data-stat="year_max">', year.cast("string"), '</td><td data-stat="pos">G</td><td data-stat="colleges">', k("o_orderpriority"), "</td></tr></tbody></table>")
    averages = cat(table("stats-Regular-Season", ("season", season), ("pts_per_g", k("o_orderpriority"))), "")
    cap = table("salary_cap_history", ("year_id", season), ("cap", cat("$", F.format_number(key, 0))))
    own = cat(table("all_salaries", ("season", season), ("team_name", cat("T", s("o_custkey"))), ("salary", cat("$", F.format_number(key * 7, 0)))), "<!-- ",
              table("all_college_stats", ("season", season), ("g", s("o_custkey"))), " -->")
    which = F.pmod(key, F.lit(5))
    html = F.when(which == 0, named).when(which == 1, averages).when(which == 2, cap).when(which == 3, listed).otherwise(own)
    return t.orders.select(key.alias("page_id"), html.alias("html"))


@query(
    "src13_reference_tables",
    """WITH o AS (SELECT o_orderkey AS page_id, o_orderkey % 5 AS w, CAST(year(o_orderdate) AS INT) AS y, * FROM orders)
    SELECT page_id, 'finals' AS kind, y AS season, 'p' || o_custkey AS id, NULL AS text, NULL AS amount FROM o WHERE w = 0
    UNION ALL SELECT page_id, 'averages', y, NULL, o_orderpriority, NULL FROM o WHERE w = 1 UNION ALL SELECT page_id, 'cap', y, NULL, NULL, page_id FROM o WHERE w = 2
    UNION ALL SELECT page_id, 'index', y, 'p' || o_custkey, 'G ' || o_orderpriority, y - 3 FROM o WHERE w = 3
    UNION ALL SELECT page_id, 'salaries', y, NULL, 'T' || o_custkey, page_id * 7 FROM o WHERE w = 4 UNION ALL SELECT page_id, 'college', y, NULL, o_custkey::VARCHAR, NULL FROM o WHERE w = 4""",
    ints="season amount",
)
def _(t):
    """Pages are read once; their rows are routed to six typed tables."""
    rows = t.stage("reference_rows", lambda: PG.table_rows(reference_pages(t), tasks=TASKS))
    d = PG.reference_tables(rows)
    none, no_amount = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def out(kind, season, id_, text, amount):
        return d[kind].select("page_id", F.lit(kind).alias("kind"), season.alias("season"), id_.alias("id"), text.alias("text"), amount.cast("bigint").alias("amount"))

    parts = [
        out("finals", k("season"), k("player_id"), none, no_amount), out("averages", k("season"), none, k("cells")["pts_per_g"], no_amount),
        out("cap", k("season"), none, none, k("cap")), out("index", k("last_year"), k("player_id"), F.concat_ws(" ", "position", "colleges"), k("first_year")),
        out("salaries", k("season"), none, k("team"), k("salary")), out("college", k("season"), none, k("cells")["g"], no_amount),
    ]
    return J.union_all(*parts)


@query(
    "src14_year_rows_only",
    "SELECT p_partkey AS page_id, (1990 + p_size) || '-' || lpad(((1991 + p_size) % 100)::VARCHAR, 2, '0') AS year_id FROM part",
)
def _(t):
    """Career and total rows under a player's table go; season rows stay."""
    year = F.format_string("%d-%02d", 1990 + k("p_size"), F.pmod(1991 + k("p_size"), F.lit(100)))
    html = cat(
        '<table id="totals"><tbody><tr><th data-stat="year_id">', year, '</th></tr><tr><th data-stat="year_id">Career</th></tr></tbody></table>'
    )
    rows = PG.data_rows(PG.table_rows(t.part.select(k("p_partkey").alias("page_id"), html.alias("html")), tasks=TASKS), "totals")
    return rows.where(PG.cell("year_id").rlike(r"^\d{4}-\d{2}$")).select("page_id", PG.cell("year_id").alias("year_id"))


@query("src15_result_set_json", "SELECT p_partkey AS page, p_partkey::VARCHAR AS id, p_name AS name FROM part")
def _(t):
    sets = F.array(
        F.struct(
            F.lit("Main").alias("name"), F.array(F.lit("ID"), F.lit("NAME")).alias("headers"),
            F.array(F.array(s("p_partkey"), k("p_name"))).alias("rowSet"),
        )
    )
    body = t.part.select(k("p_partkey").alias("page"), F.to_json(F.struct(sets.alias("resultSets"))).alias("body"))
    r = D.result_sets(body, "body", ["page"])
    return r.select("page", k("cells")["ID"].alias("id"), k("cells")["NAME"].alias("name"))


def game_bodies(t):
    """One game document per order: a made shot with an assist, a free throw, a shot off the map."""
    key = k("o_orderkey")

    def who(x):
        return F.struct(F.struct(x.cast("string").alias("id")).alias("athlete"))

    def play(text, x, people):
        return F.struct(
            F.lit(True).alias("shootingPlay"), (key % 2 == 0).alias("scoringPlay"), F.lit(2).alias("scoreValue"), F.lit(text).alias("text"),
            F.struct(F.lit(text).alias("text")).alias("type"), F.struct((k("o_custkey") % 30).cast("string").alias("id")).alias("team"),
            F.struct(x.cast("double").alias("x"), F.lit(10.0).alias("y")).alias("coordinate"), people.alias("participants"),
        )

    two, one = F.array(who(k("o_custkey")), who(key)), F.array(who(k("o_custkey")))
    plays = F.array(play("Jumper", key % 40, two), play("Free Throw", F.lit(1), one), play("Layup", F.lit(-214748340), one))
    ath = F.struct(F.struct(s("o_custkey").alias("id"), cat("N", s("o_custkey")).alias("displayName")).alias("athlete"))
    box = F.struct(F.array(F.struct(F.struct(F.lit("7").alias("id")).alias("team"), F.array(F.struct(F.array(ath, ath).alias("athletes"))).alias("statistics"))).alias("players"))
    comp = F.struct(
        (key % 3 == 0).alias("neutralSite"), F.array(F.struct(F.lit("9").alias("id"), F.lit("away").alias("homeAway")), F.struct(F.lit("7").alias("id"), F.lit("home").alias("homeAway"))).alias("competitors")
    )
    body = F.to_json(F.struct(plays.alias("plays"), box.alias("boxscore"), F.struct(F.array(comp).alias("competitions")).alias("header")))
    return D.parsed_games(t.orders.select(key.alias("game_id"), body.alias("body")), "body", "game_id")


@query(
    "src16_play_by_play",
    """SELECT o_orderkey AS game_id, 'Jumper' AS shot_type, o_custkey AS athlete_id, o_orderkey AS assist_athlete_id, CAST(o_orderkey % 40 AS DOUBLE) AS x, o_orderkey % 2 = 0 AS made FROM orders
    UNION ALL SELECT o_orderkey, 'Layup', o_custkey, NULL, NULL, o_orderkey % 2 = 0 FROM orders""",
    rnd="x",
)
def _(t):
    return D.game_shots(game_bodies(t), "game_id").select("game_id", "shot_type", "athlete_id", "assist_athlete_id", "x", "made")


@query(
    "src16_rosters_and_info",
    "SELECT o_orderkey AS game_id, o_custkey AS athlete_id, 'N' || o_custkey AS athlete_name, 3 AS n_plays, o_orderkey % 3 = 0 AS neutral_site, 7 AS home_team_id FROM orders",
    ints="n_plays home_team_id",
)
def _(t):
    g = game_bodies(t)
    return D.game_rosters(g, "game_id").drop("team_id").join(D.game_info(g, "game_id").drop("conference_game"), "game_id")


@query(
    "src17_schedule_json",
    """SELECT o_orderkey AS game_id, 'G' || o_orderkey AS name, CASE o_orderkey % 3 WHEN 0 THEN 'A,B' WHEN 1 THEN 'A' END AS broadcast FROM orders""",
)
def _(t):
    key = k("o_orderkey")

    def show(name, cond):
        return F.struct(F.struct(F.when(cond, name).alias("shortName")).alias("media"))

    comp = F.struct(F.array(show("A", key % 3 < 2), show("B", key % 3 == 0)).alias("broadcasts"))
    event = F.struct(s("o_orderkey").alias("id"), cat("G", s("o_orderkey")).alias("name"), F.array(comp).alias("competitions"))
    body = F.to_json(F.struct(F.array(event).alias("events")))
    d = D.schedule(t.orders.select(F.lit(1).alias("team"), body.alias("body")), "body", ["team"])
    return d.select("game_id", "name", "broadcast")


@query(
    "src18_partitioned_pull",
    "SELECT season, count(*) AS games FROM (SELECT DISTINCT l_orderkey, year(l_shipdate) AS season FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-06-01') GROUP BY 1",
    ints="season",
)
def _(t):
    root = scratch(t)
    games = t.lineitem.where(k("l_shipdate") < F.lit("2001-06-01").cast("timestamp")).select("l_orderkey", F.year("l_shipdate").alias("season")).dropDuplicates()
    TB.write_table(games, root, "raw", "feed", "games", ["season"])
    return TB.scan_periods(t.spark, TB.table_path(root, "raw", "feed", "games")).groupBy("season").agg(F.count(F.lit(1)).alias("games"))


@query(
    "src19_early_periods",
    "SELECT entity, period, nth FROM (SELECT entity, period, row_number() OVER (PARTITION BY entity ORDER BY period) AS nth FROM seasons) WHERE nth <= 4",
    "seasons", ints="period nth",
)
def _(t):
    return TB.early_periods(t.seasons, "entity", "period").select("entity", "period", "nth")


@query(
    "src20_key_universe",
    "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 OR c_acctbal > 5000",
)
def _(t):
    c = t.customer.withColumnRenamed("c_custkey", "id")
    return TB.universe(c.where("id % 2 = 0"), c, "id", k("c_acctbal") > 5000)


@query(
    "src17_team_json",
    """SELECT n_nationkey AS team_id, r_name AS location, n_name AS display_name, n_name[1:3] AS abbrev FROM nation JOIN region ON r_regionkey = n_regionkey""",
    ints="team_id",
)
def _(t):
    """One body per region lists its teams."""
    n = t.nation.join(t.region, k("n_regionkey") == k("r_regionkey"))
    team = F.struct(
        s("n_nationkey").alias("id"), k("r_name").alias("location"), k("n_name").alias("displayName"), F.substring("n_name", 1, 3).alias("abbreviation")
    )
    leagues = F.array(F.struct(F.collect_list(F.struct(team.alias("team"))).alias("teams")))
    bodies = n.groupBy("r_regionkey").agg(F.to_json(F.struct(F.array(F.struct(leagues.alias("leagues"))).alias("sports"))).alias("body"))
    return D.teams(bodies, "body")


@query("src21_export_bundle", "SELECT vec_id, CAST(embedding[1] AS FLOAT)::DOUBLE AS c0, label FROM embeddings", ints="label", rnd="c0", places=7)
def _(t):
    path = scratch(t)
    wide = t.embeddings.select("vec_id", k("embedding")[0].cast("double").alias("c0"), k("embedding")[1].alias("extra"), "label")
    TB.export(wide, path, ["vec_id", "c0", "label", "absent"])
    return t.spark.read.parquet(path).withColumn("c0", k("c0").cast("double"))


@query(
    "src21_export_list",
    """SELECT * FROM (SELECT 'core' AS source, 'parts' AS name, 2 AS columns, count(*) AS rows FROM part UNION ALL SELECT 'core', 'nations', 3, count(*) FROM nation
      UNION ALL SELECT 'grids', 'maps', 3, count(*) FROM embeddings UNION ALL SELECT 'outcomes', 'params', 2, 1)""",
    ints="columns rows",
)
def _(t):
    """A list of tables pruned and copied with their params; the sizes are checked."""
    root = scratch(t)
    TB.write_table(t.part, root, "modeled", "core", "parts")
    TB.write_table(t.nation, root, "modeled", "core", "nations")
    TB.write_table(t.embeddings.select("vec_id", k("embedding")[0].alias("c0"), k("embedding")[1].alias("c1"), "label"), root, "modeled", "grids", "maps")
    entries = [("core", "parts", ["p_partkey", "p_name", "absent"]), ("core", "nations", None), ("grids", "maps", ["vec_id", "c0", "c1"])]
    done = TB.export_bundle(t.spark, root, f"{root}/bundle", entries, {"horizon": "2", "cuts": "0.5,1.2"}, limit=10**12)
    return done.select("source", "name", "columns", "rows")


@query("src22_report_csv", "SELECT p_type, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1", rnd="price", places=4)
def _(t):
    path = scratch(t)
    TB.write_report(t.part.groupBy("p_type").agg(F.avg("p_retailprice").alias("price")), path)
    return t.spark.read.option("header", True).schema("p_type string, price double").csv(path)


# ---------------------------------------------------------------------------------- streams


def events_stream(t):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events*.parquet")


@query(
    "str1_incremental_refresh",
    "SELECT CAST(ts AS DATE) AS day, user_id, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1, 2",
    rnd="total", places=2, ints="n",
)
def _(t):
    root = scratch(t)
    rows = events_stream(t).select(k("ts").cast("date").alias("day"), "user_id", k("value").alias("total"), F.lit(1).cast("long").alias("n"))
    q = RF.refresh_partitions(rows, f"{root}/table", "day", ["user_id"], {"total": F.sum, "n": F.sum}, f"{root}/state")
    q.awaitTermination()
    return t.spark.read.parquet(f"{root}/table").select("day", "user_id", "total", "n")


@query(
    "str2_live_totals",
    """SELECT user_id, CAST(count(*) AS DOUBLE) AS games, sum(value) AS value, CASE WHEN sum(value) * 200 / count(*) > 10000 THEN 'pacing above ceiling' WHEN sum(value) * 200 / count(*) < 5000 THEN 'pacing below floor' ELSE 'within range' END AS status
    FROM events GROUP BY 1""",
    rnd="games value", places=4,
)
def _(t):
    root = scratch(t)
    totals = RF.running_totals(events_stream(t), "user_id", {"games": F.lit(1.0), "value": k("value")})
    bands = t.events.select("user_id").distinct().withColumns({"floor": F.lit(5000.0), "ceiling": F.lit(10000.0)})

    def publish(batch, batch_id):
        changed = RF.tracker(bands.join(batch, "user_id", "left_semi"), batch, "user_id", F.lit(200.0))
        RF.replace_rows(changed, batch_id, f"{root}/table", "user_id", f"{root}/state")

    q = totals.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{root}/state/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(f"{root}/table").select("user_id", "games", "value", "status")
