"""Sources: malformed odds feeds, scoreboard shapes, files, year filters."""

import datetime as dt
import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lineup.operators import filters as FL
from lineup.session import shared_dir
from lineup.sources import files as FS
from lineup.sources.odds_json import dropped_documents, flatten_odds
from lineup.sources.schedule_json import flatten_events, flatten_scoreboard


def _book(key, outcomes, market="h2h"):
    b = {"markets": [{"key": "totals", "outcomes": []}, {"key": market, "outcomes": outcomes}]}
    if key is not None:
        b["key"] = key
    return b


def _game(gid, home="A", away="B", books=None, ct="2024-01-01T19:00:00Z"):
    g = {"id": gid, "commence_time": ct, "home_team": home, "bookmakers": books or []}
    if away is not None:
        g["away_team"] = away
    return g


def test_malformed_odds_parts_are_skipped_one_by_one(spark):
    ok = [{"name": "A", "price": 150}, {"name": "B", "price": -170}]
    doc = [
        "junk",                                                           # element not an object
        _game("1", books=[_book("dk", ok), "oops", _book(None, ok),      # book not object / no key
                          _book("fd", ok, market="spreads"),              # no h2h market
                          _book("mg", {"name": "A"}),                     # outcomes not a list
                          _book("cz", [{"name": "A", "price": "even"}, {"name": "B", "price": None}]),
                          _book("br", [{"name": "A", "price": 120}, {"name": "A", "price": 130},
                                       {"name": "B", "price": 0}])]),
        _game("2", away=None, books=[_book("dk", ok)]),                   # team missing
        _game("3", ct="tomorrow", books=[_book("dk", ok)]),
    ]
    docs = spark.createDataFrame([(json.dumps(doc),), ('{"message": "quota"}',)], "doc string")
    rows = {(r.game_id, r.bookmaker): r for r in flatten_odds(docs).collect()}
    assert set(rows) == {("1", "dk"), ("1", "cz"), ("1", "br"), ("3", "dk")}
    assert rows[("1", "dk")].home_prob == pytest.approx(0.4) and rows[("1", "dk")].away_prob is None
    assert rows[("1", "cz")].home_odds is None and rows[("1", "cz")].home_prob is None
    assert rows[("1", "br")].home_odds == 130 and rows[("1", "br")].away_prob is None   # last wins; 0 -> NULL
    assert rows[("3", "dk")].commence_time is None
    assert rows[("1", "dk")].commence_time == dt.datetime(2024, 1, 1, 19, 0)
    d = dropped_documents(docs).first()
    assert (d.documents, d.not_a_list) == (2, 1)
    assert {r.bookmaker for r in flatten_odds(docs, bookmakers=["dk", ""]).collect()} == {"dk"}
    with pytest.raises(Exception):
        flatten_odds(docs, strict=True).collect()


def test_scoreboard_shapes(spark):
    a = {"scoreboard": {"games": [{"gameId": "g1", "gameTimeUTC": "2024-01-02T02:30:00Z",
                                   "homeTeam": {"teamTricode": "LAL"}, "awayTeam": {"teamTricode": "BOS"},
                                   "gameStatus": 1}]}}
    b = {"events": [{"id": "e1", "date": "2024-01-01T20:00Z", "competitions": [{"competitors": [
        {"homeAway": "away", "team": {"abbreviation": "MIA"}},
        {"homeAway": "home", "team": {"abbreviation": "NYK"}}], "status": {"type": {"name": "FINAL"}}}]},
        {"id": "e2", "competitions": [{"competitors": [{"homeAway": "home", "team": {"abbreviation": "X"}}]}]}]}
    ra = flatten_scoreboard(spark.createDataFrame([(json.dumps(a),)], "doc string")).first()
    assert ra.game_date == dt.date(2024, 1, 1) and ra.arena == "" and ra.home_team == "LAL"
    assert flatten_scoreboard(spark.createDataFrame([(json.dumps(a),)], "doc string"),
                              target_date="2024-01-02").count() == 0
    rb = flatten_events(spark.createDataFrame([(json.dumps(b),)], "doc string"), target_date="2024-01-01").collect()
    assert len(rb) == 1 and (rb[0].home_team, rb[0].away_team, rb[0].arena) == ("NYK", "MIA", "")


def test_csv_roundtrip_and_multi_file(spark):
    df = spark.createDataFrame([(1, "2020-10-01", "A"), (2, "2021-01-05", "B")], "id int, d string, t string")
    base = shared_dir(spark, "t_csv")
    FS.write_csv(df, base, partition_by="t")
    back = FS.read_many(spark, [f"{base}/t=A", f"{base}/t=B", f"{base}/t=Z"], "id int, d date")
    assert back.count() == 2
    with pytest.raises(FileNotFoundError):
        FS.read_many(spark, [f"{base}/t=Z"], "id int, d date")
    assert FS.fresh_only(back, 7).count() == 2
    size = FS.files_size(back).first()
    assert size.files == 2 and size.bytes > 0
    stale = next(p for p in glob.glob(f"{base.removeprefix('file:')}/t=A/*.csv"))
    os.utime(stale, (time.time() - 8 * 86400,) * 2)
    spark.catalog.clearCache()
    again = FS.read_many(spark, [f"{base}/t=A", f"{base}/t=B"], "id int, d date")
    assert [r.id for r in FS.fresh_only(again, 7).select("id").collect()] == [2]


def test_headers():
    assert FS.normalize_headers([("Unnamed: 0_level_0", "Team"), ("Offense", " Pts Per G "), " Rk "]) == \
        ["unnamed:_0_level_0_team", "offense__pts_per_g", "rk"]


def test_year_filters(spark):
    df = spark.createDataFrame([(1, "2020-21", "2020-11-01", 2020), (2, "2019-20", "bad", 2019),
                                (3, "n/a", "2022-01-01", 2022)], "id int, season string, game_date string, yr int")
    assert [r.id for r in df.where(FL.season_text_year("season", 2020, 2021)).collect()] == [1]
    assert [r.id for r in df.where(FL.date_year(df, "game_date", 2020, 2022)).orderBy("id").collect()] == [1, 3]
    assert FL.date_like_columns(df) == ["season", "game_date"]
    for order in ("id", "-id", "id % 2"):  # the choice of the column never depends on the order of rows
        ordered = df.orderBy(F.expr(order))
        assert [r.id for r in FL.filter_by_year_range(ordered, 2020, 2020).collect()] == [1]
    dates = df.select("id", F.col("game_date").alias("season"))
    assert sorted(r.id for r in FL.filter_by_year_range(dates, 2020, 2022).collect()) == [1, 3]
    assert FL.filter_by_year_range(df.select("id"), 2020, 2020).count() == 3
    typed = df.withColumn("d", F.to_date(F.lit("2021-03-01")))
    plan = typed.where(FL.date_year(typed, "d", 2021, 2021))._jdf.queryExecution().optimizedPlan().toString()
    assert "year(" not in plan


def test_csv_files_are_aligned_by_name(spark):
    import gzip
    base = shared_dir(spark, "t_headers").removeprefix("file:")
    os.makedirs(f"{base}/sub")
    put = {"a.csv": "team_name,games,wins\nX,10,4\n", "b.csv": "\ufeffWins, Team Name ,Games\n4,Y,10\n",
           "c.csv": "team_name,games\nZ,1\n", "d.csv": "", "e.csv": 'wins,"team_name",note,games\n5,"V, W","a ""b""",11\n',
           "f.csv": "wins,wins,team_name,games\n1,2,Q,3\n", "sub/h.csv": "games,wins,team_name\n7,6,S\n", "_hidden.csv": "x\n1\n"}
    for name, text in put.items():
        with open(f"{base}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    with gzip.open(f"{base}/g.csv.gz", "wt") as f:
        f.write("wins,games,team_name\n8,9,G\n")
    schema = "team_name string, wins int, games int"
    df, rejected = FS.scan_csv(spark, [base, f"{base}/none"], schema, source_col="src")
    assert {(r.team_name, r.wins, r.games) for r in df.collect()} == {
        ("X", 4, 10), ("Y", 4, 10), ("V, W", 5, 11), ("S", 6, 7), ("G", 8, 9)}
    assert {(os.path.basename(p), why) for p, why in rejected} == {
        ("c.csv", "lacks wins"), ("d.csv", "empty"), ("f.csv", "repeats a column"), ("none", "missing")}
    assert {os.path.basename(r.src) for r in df.collect()} == {"a.csv", "b.csv", "e.csv", "g.csv.gz", "h.csv"}
    loose, _ = FS.scan_csv(spark, [base], schema, required=["team_name"])
    assert ("Z", None, 1) in {(r.team_name, r.wins, r.games) for r in loose.collect()}
    assert [tuple(r) for r in FS.read_csv(spark, f"{base}/b.csv", schema).collect()] == [("Y", 4, 10)]
    with pytest.raises(ValueError):
        FS.read_csv(spark, base, schema)
    with pytest.raises(ValueError):
        FS.scan_csv(spark, [f"{base}/c.csv"], schema)
    bad = spark.createDataFrame([("1,x",), ("2,3,4",)], "value string")
    bad.coalesce(1).write.text(f"{base}/bad")
    assert FS.read_csv(spark, f"{base}/a.csv", schema + ", _corrupt_record string").columns[-1] == "_corrupt_record"


def test_a_partition_written_again_replaces_itself_only(spark):
    for write, read in ((FS.write_parquet, lambda p: spark.read.parquet(p)),
                        (FS.write_csv, lambda p: FS.read_csv(spark, p, "id int, season int"))):
        path = shared_dir(spark, "t_upsert")
        write(spark.createDataFrame([(1, 2020), (2, 2021)], "id int, season int"), path, "season")
        for _ in range(2):
            write(spark.createDataFrame([(3, 2021), (4, 2022)], "id int, season int"), path, "season")
        assert sorted((r.id, r.season) for r in read(path).collect()) == [(1, 2020), (3, 2021), (4, 2022)]
        broken = spark.createDataFrame([(5, 2020), (6, 2022)], "id int, season int").withColumn(
            "id", F.when(F.col("id") == 6, F.raise_error(F.lit("stop"))).otherwise(F.col("id")))
        with pytest.raises(Exception):
            write(broken, path, "season")
        assert sorted((r.id, r.season) for r in read(path).collect()) == [(1, 2020), (3, 2021), (4, 2022)]


def test_freshness_in_parts_of_an_hour(spark):
    path = shared_dir(spark, "t_fresh")
    FS.write_parquet(spark.range(3).coalesce(1).toDF("id"), path)
    df = spark.read.parquet(path)
    ahead = dt.datetime.now(dt.timezone.utc) + dt.timedelta(minutes=30)
    assert FS.fresh_only(df, 0.6 / 24, ahead).count() == 3 and FS.fresh_only(df, 0.4 / 24, ahead).count() == 0


def test_metadata_comes_from_footers(spark):
    path = shared_dir(spark, "t_footers")
    df = spark.range(5000).select("id", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("day"),
                                  (F.col("id") % 3).alias("part"))
    FS.write_parquet(df, path, "part")
    got = FS.file_metadata(spark, path, ["day"]).first()
    assert (got.rows, got.min_day, got.max_day, got.n_columns) == (5000, "2020-01-01", "2021-02-03", 3)
    assert got.files == len(FS.data_files(spark, path)) and got.bytes > 0 and got.columns == ["id", "day", "part"]
    own = FS.statistics_session(spark)
    plan = FS.dataset_metadata(own.read.parquet(path), ["day"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(day), MAX(day)]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    # without statistics in the footers the rows are read
    bare = shared_dir(spark, "t_bare")
    df.write.option("parquet.column.statistics.enabled", "false").parquet(bare)
    assert FS.file_metadata(spark, bare, ["day"]).first()[:3] == got[:3]
