import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortloom.sources import pages as PG
from cohortloom.sources import tables as TB
from cohortloom.sources import text as TX
from cohortloom.streaming import refresh as RF

TRADE = """<!-- <div id="div_transactions"><p class="transaction"><strong>June 21, 2018</strong>: Drafted by the
<a data-attr-to="CHO" href="/t">Hornets</a>.</p><p class="transaction"><strong>June 21, 2018</strong>: Traded by the
<a data-attr-from="CHO" href="/t">Hornets</a> with a 2021 draft pick to the <a data-attr-to="LAC" href="/t">Clippers</a> for
<a href="/players/b/bridgmi02.html">Miles Bridges</a> and a 2020 2nd round draft pick (Vernon Carey was later selected).</p>
<p class="transaction"><strong>July 1, 2019</strong>: As part of a 3-team trade, traded by the <a data-attr-from="LAC">C</a>
to the <a data-attr-to="OKC">T</a> for picks</p></div> -->"""


def test_trade_sides(spark):
    t = PG.transactions(spark.createDataFrame([("gilgesh01", TRADE)], "page_id string, html string"))
    rows = t.orderBy("seq").collect()
    assert [r.kind for r in rows] == ["drafted", "traded", "traded"]
    assert rows[0].date == dt.date(2018, 6, 21) and (rows[1].team_from, rows[1].team_to) == ("CHO", "LAC")
    s = PG.trade_sides(t, "page_id").orderBy("seq").collect()
    assert s[0].sent == ["gilgesh01"] and s[0].received == ["bridgmi02"]
    assert (s[0].sent_unresolved, s[0].received_unresolved, s[0].multi_team) == (1, 0, False)
    assert s[1].multi_team and s[1].has_return


def test_rows_prefer_the_visible_table(spark):
    html = (
        '<!-- <table id="a"><tbody><tr><td data-stat="x">hidden</td></tr></tbody></table> -->'
        '<table id="a"><thead><tr><td data-stat="x">head</td></tr></thead><tbody><tr class="thead"><td data-stat="x">again</td></tr>'
        '<tr><td data-stat="x"> <b>shown</b> <i>now</i></td></tr></tbody></table><table id="b"><tr><td data-stat="y">no body</td></tr></table>'
    )
    rows = PG.table_rows(spark.createDataFrame([(1, html)], "page_id int, html string"))
    assert [r.c for r in PG.data_rows(rows, "a").select(PG.cell("x").alias("c")).collect()] == ["shownnow"]
    assert [r.c for r in PG.data_rows(rows, "b").select(PG.cell("y").alias("c")).collect()] == ["no body"]


def test_csv_header_and_width(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('Team,"Fun Rk, adjt",W.L\nx,1,2,3\ny,4,5,6\n')
    df = TX.repaired_csv(spark, str(p))
    assert df.columns == ["team", "fun_rk", "adjt", "wl"] and df.count() == 2
    o = tmp_path / "o.csv"
    o.write_text("# note\nid,field,value\na,link,\nb,link,7\n")
    assert {(r.id, r.value) for r in TX.commented_csv(spark, str(o)).collect()} == {("a", ""), ("b", "7")}


def test_names_and_observed_counts(spark, tmp_path):
    assert TB.identifier("staging", "a-b", "c.d") == "staging__a_b__c_d"
    assert TB.write_table(spark.range(17), str(tmp_path), "raw", "s", "n") == 17


def test_refresh_equals_full_recompute_and_ignores_replays(spark, tmp_path):
    src, table, state = (str(tmp_path / n) for n in ("src", "table", "state"))
    one = spark.range(100).select((F.col("id") % 3).alias("day"), (F.col("id") % 5).alias("u"), F.lit(1).cast("long").alias("n"))
    for _ in range(3):
        one.write.mode("append").parquet(src)
        stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 2).parquet(src)
        RF.refresh_partitions(stream, table, "day", ["u"], {"n": F.sum}, state).awaitTermination()
    got = {(r.day, r.u): r.n for r in spark.read.parquet(table).collect()}
    full = spark.read.parquet(src).groupBy("day", "u").agg(F.sum("n").alias("n")).collect()
    assert got == {(r.day, r.u): r.n for r in full}


def _batches(spark, src, table, state):
    stream = spark.readStream.schema("day long, u long, n long").parquet(src)
    return RF.refresh_partitions(stream, table, "day", ["u"], {"n": F.sum}, state)


def test_refresh_fails_on_an_unreadable_table_and_leaves_it(spark, tmp_path):
    src, table, state = (str(tmp_path / n) for n in ("src", "table", "state"))
    spark.createDataFrame([(1, 1, 11)], "day long, u long, n long").write.parquet(src)
    _batches(spark, src, table, state).awaitTermination()
    bad = tmp_path / "table" / "day=1" / "part-bad.parquet"
    bad.write_bytes(b"no parquet")
    before = sorted(p.name for p in (tmp_path / "table").rglob("*.parquet"))
    spark.createDataFrame([(1, 1, 100)], "day long, u long, n long").write.mode("append").parquet(src)
    with pytest.raises(Exception):
        _batches(spark, src, table, state).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "table").rglob("*.parquet")) == before


def test_replay_finishes_a_half_written_batch(spark, tmp_path):
    """The first attempt wrote one of two partitions and died before its offsets were committed."""
    src, table, state = (str(tmp_path / n) for n in ("src", "table", "state"))
    rows = spark.createDataFrame([(1, 1, 5), (2, 1, 7)], "day long, u long, n long")
    rows.write.parquet(src)
    rows.where("day = 1").withColumn("_batch", F.lit(0)).write.partitionBy("day").parquet(table)
    _batches(spark, src, table, state).awaitTermination()
    assert {(r.day, r.n) for r in spark.read.parquet(table).collect()} == {(1, 5), (2, 7)}


def test_changed_rows_replace_their_keys_only(spark, tmp_path):
    table, state = str(tmp_path / "t"), str(tmp_path / "s")
    frame = lambda *rows: spark.createDataFrame(list(rows), "u long, v long")
    RF.replace_rows(frame((1, 1), (2, 2), (3, 3)), 0, table, "u", state, buckets=2)
    for _ in range(2):  # a replay changes nothing
        RF.replace_rows(frame((2, 20), (4, 40)), 1, table, "u", state, buckets=2)
    RF.replace_rows(frame(), 2, table, "u", state, buckets=2)
    assert {(r.u, r.v) for r in spark.read.parquet(table).collect()} == {(1, 1), (2, 20), (3, 3), (4, 40)}


def test_tracker_status(spark):
    bands = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0), (3, 1.0, 2.0), (4, 1.0, 2.0)], "e int, floor double, ceiling double")
    now = spark.createDataFrame([(1, 41.0, 1.5), (2, 41.0, 0.2), (3, 41.0, 0.75)], "e int, games double, value double")
    got = {r.e: r.status for r in RF.tracker(bands, now, "e", F.lit(82.0)).collect()}
    assert got == {1: "pacing above ceiling", 2: "pacing below floor", 3: "within range", 4: "no games yet"}


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from cohortloom.session import shared_dir

    def session(master, warehouse, folder=None):
        conf = {"spark.sql.warehouse.dir": warehouse} | ({"spark.checkpoint.dir": folder} if folder else {})
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, *default: conf.get(key, *default)),
                               sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    assert shared_dir(session("yarn", "file:/w", "hdfs://n/c/")) == "hdfs://n/c"
    assert shared_dir(session("yarn", "hdfs://n/w")) == "hdfs://n/w/cohortloom-work"
    assert shared_dir(session("local[4]", "file:/w")) == "file:/w/cohortloom-work"
    for warehouse in ("file:/w", "/w"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session("spark://host:7077", warehouse))


def test_entry_without_the_corpus_folder(tmp_path):
    """Without a library that the corpus operators need, the other queries are still there."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op1') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 240 and out[1] == "False"


BIO = "Jane Doe Position: Power Forward and Center ▪ Shoots: Left 6-9, 250lb (205cm, 113kg) Born: July 6, 2000 in Salisbury, North Carolina us College: Duke High School: Day School in Town Recruiting Rank: 2018 (4) Draft: Hornets, 1st round (1st pick, 1st overall), 2019 Draft NBA Debut: January 22, 2020 Experience: 5 years"


def test_bio_block_is_cut_at_its_labels(spark):
    rows = [(1, BIO), (2, "Nothing here"), (3, ""), (4, None), (5, "Born: May 1, 1990 Draft: Team Died: 2020"), (6, "Position: Guard Shoots: Right Career Length: 2 years")]
    out = {r.id: r for r in PG.bio_fields(spark.createDataFrame(rows, "id int, text string")).collect()}
    one = out[1].asDict()
    assert {c: one[c] for c in one if c not in ("id", "text")} == {
        "position": "Power Forward and Center", "shoots": "Left", "height_cm": 205, "weight_kg": 113, "weight_lb": 250, "height_in": 81, "colleges": "Duke",
        "high_school": "Day School in Town", "recruit_year": 2018, "recruit_rank": 4, "draft_text": "Hornets, 1st round (1st pick, 1st overall), 2019 Draft",
        "debut": "January 22, 2020", "birthplace": "Salisbury, North Carolina", "birth_country": "us"}
    for i in (2, 3, 4):
        assert all(v is None for c, v in out[i].asDict().items() if c not in ("id", "text"))
    assert out[5].birthplace is None and out[5].draft_text == "Team" and out[6].position == "Guard" and out[6].height_in is None


def test_player_page(spark):
    html = f'<div id="meta"><p>{BIO.replace("July 6, 2000", "<span id=necro-birth data-birth=2000-07-06>July 6, 2000</span>")}</p></div><a href="https://x.org/cbb/players/jane-doe-1.html">c</a>'
    out = PG.player_bios(spark.createDataFrame([("p1", html), ("p2", "<p>none</p>")], "page_id string, html string")).collect()
    (row,) = [r for r in out if r.page_id == "p1"]
    assert (str(row.birth_date), row.college_id, row.height_in, row.birthplace) == ("2000-07-06", "jane-doe-1", 81, "Salisbury, North Carolina")


def test_bundle_above_its_limit_is_an_error(spark, tmp_path):
    TB.write_table(spark.range(1000), str(tmp_path), "modeled", "a", "b")
    done = TB.export_bundle(spark, str(tmp_path), f"{tmp_path}/out", [("a", "b", None)], limit=10**9).collect()
    assert done[0].rows == 1000 and done[0].bytes > 0
    with pytest.raises(ValueError, match="more than 10"):
        TB.export_bundle(spark, str(tmp_path), f"{tmp_path}/out2", [("a", "b", ["id"])], limit=10)
