"""The odds quote stream: equal to a batch over the latest snapshot, late data, moved starts."""

import json

import pytest
from pyspark.sql import functions as F

from lineup.plans import derive
from lineup.session import shared_dir
from lineup.sources.odds_json import flatten_odds
from lineup.streaming.odds_stream import consensus_from_quotes, latest_quotes, run_quotes, run_windows, window_consensus


def _write(spark, src, time, docs):
    docs.select(F.lit(time).cast("timestamp").alias("snapshot_ts"), "doc").coalesce(1).write.mode("append").json(src)


def test_stream_equals_batch_of_the_last_snapshot(spark, small_dir):
    src, sink, ck = shared_dir(spark, "t_snap"), shared_dir(spark, "t_quotes"), shared_dir(spark, "t_ck")
    for time, move in (("2024-01-01 12:00:00", 0), ("2024-01-01 12:10:00", 29)):
        _write(spark, src, time, derive.odds_documents(spark, small_dir, move))
    run_quotes(spark, src, sink, ck, lateness="1 hour", files_per_trigger=1)
    quotes = spark.read.parquet(sink)
    assert quotes.select("batch").distinct().count() > 1
    last = flatten_odds(derive.odds_documents(spark, small_dir, 29)).withColumn(
        "snapshot_ts", F.lit("2024-01-01 12:10:00").cast("timestamp"))
    first = flatten_odds(derive.odds_documents(spark, small_dir, 0)).withColumn(
        "snapshot_ts", F.lit("2024-01-01 12:00:00").cast("timestamp"))
    cols = ["game_id", "commence_time", "home_odds", "away_odds", "n_books"]
    a, b, c = (consensus_from_quotes(x).toPandas().sort_values("game_id").reset_index(drop=True)[cols]
               for x in (quotes, last, first))
    assert a.equals(b) and not a.equals(c)
    assert (a["home_odds"].dropna() > 1).all()


def _doc(home, start="2024-01-05T20:00:00Z", game="g1", book="b1"):
    price = [{"name": "H", "price": home}, {"name": "A", "price": -110}]
    return json.dumps([{"id": game, "commence_time": start, "home_team": "H", "away_team": "A", "bookmakers": [
        {"key": book, "markets": [{"key": "h2h", "outcomes": price}]}]}])


def test_quote_time_not_game_time_decides(spark):
    src, sink, ck = shared_dir(spark, "t_snap"), shared_dir(spark, "t_quotes"), shared_dir(spark, "t_ck")
    feed = [("2024-01-01 10:00:00", _doc(110)),
            ("2024-01-01 10:05:00", _doc(120, "2024-01-15T20:00:00Z", "far")),  # a game ten days later
            ("2024-01-01 10:10:00", _doc(150, "2024-01-06T20:00:00Z")),         # new price, moved start
            ("2024-01-02 18:00:00", _doc(130, game="g2")),
            ("2024-01-01 09:00:00", _doc(999))]                                 # far too late
    for time, doc in feed:
        _write(spark, src, time, spark.createDataFrame([(doc,)], "doc string"))
    run_quotes(spark, src, sink, ck, lateness="1 hour", files_per_trigger=1)
    got = {r.game_id: r for r in latest_quotes(spark.read.parquet(sink)).collect()}
    assert got["g1"].home_odds == 150 and str(got["g1"].commence_time) == "2024-01-06 20:00:00"
    assert got["far"].home_odds == 120 and got["g2"].home_odds == 130
    assert spark.read.parquet(sink).where("home_odds = 999").count() == 0
    c = {r.game_id: r for r in consensus_from_quotes(spark.read.parquet(sink)).collect()}
    assert c["g1"].home_odds == pytest.approx(2.5)


def test_one_sided_and_empty_books_are_tolerated(spark):
    docs = [json.dumps([{"id": "g", "home_team": "H", "away_team": "A", "bookmakers": [
        {"key": "one", "markets": [{"key": "h2h", "outcomes": [{"name": "H", "price": -150}]}]},
        {"key": "none", "markets": [{"key": "h2h", "outcomes": []}]}]}])]
    rows = {r.bookmaker: r for r in flatten_odds(spark.createDataFrame([(d,) for d in docs], "doc string")).collect()}
    assert rows["one"].home_odds == -150 and rows["one"].away_odds is None
    assert rows["none"].home_odds is None and rows["none"].away_odds is None


def test_windows_equal_their_batch_form(spark):
    """Duplicates count once, late rows are dropped, open windows are not given, and a second run goes on."""
    src, sink, ck = (shared_dir(spark, f"t_win_{n}") for n in ("src", "out", "ck"))

    def feed(rows):
        for time, doc in rows:
            _write(spark, src, time, spark.createDataFrame([(doc,)], "doc string"))
        run_windows(spark, src, sink, ck, lateness="30 minutes", files_per_trigger=1)
        return {(str(r.window_start)[11:16], r.game_id): (r.home_odds, r.n_quotes) for r in spark.read.parquet(sink).collect()}

    on_time = [("2024-01-01 10:00:00", _doc(100)), ("2024-01-01 10:05:00", _doc(200)), ("2024-01-01 10:05:00", _doc(200)),
               ("2024-01-01 10:16:00", _doc(300)), ("2024-01-01 10:01:00", _doc(500, book="b2"))]
    # with two stateful operators a row is late by the watermark before the last one: one batch lies between
    first = feed(on_time + [("2024-01-01 12:00:00", _doc(100, game="g2")), ("2024-01-01 12:01:00", "[]"),
                            ("2024-01-01 10:02:00", _doc(900, book="b3"))])
    assert first == {("10:00", "g1"): (pytest.approx((2 + 3 + 6) / 3), 3), ("10:15", "g1"): (4.0, 1)}
    second = feed([("2024-01-01 10:03:00", _doc(900, book="b4")), ("2024-01-01 15:00:00", "[]"), ("2024-01-01 15:01:00", "[]")])
    assert second == first | {("12:00", "g2"): (2.0, 1)}
    rows = spark.createDataFrame(on_time, "ts string, doc string").select(F.col("ts").cast("timestamp").alias("snapshot_ts"), "doc")
    batch = window_consensus(flatten_odds(rows, keep=("snapshot_ts",)).dropDuplicates(["game_id", "bookmaker", "snapshot_ts"]))
    assert {(str(r.window_start)[11:16], r.game_id): (r.home_odds, r.n_quotes) for r in batch.collect()} == first


@pytest.mark.parametrize("query", ["odds_stream_consensus", "odds_stream_windows"])
def test_the_feed_is_stored_compressed(spark, small_dir, monkeypatch, query):
    import glob

    from lineup.plans import q_stream
    made = {}
    monkeypatch.setattr(q_stream, "shared_dir", lambda s, name: made.setdefault(name, shared_dir(s, name)))
    rows = getattr(q_stream, query)(spark, small_dir).count()
    src = made["odds_snapshots" if query.endswith("consensus") else "odds_windows"].removeprefix("file:")
    files = glob.glob(f"{src}/part-*")
    assert rows > 0 and files and all(f.endswith(".json.gz") for f in files)


def test_feed_and_state_are_cut_by_rows_and_state_lies_on_disk(spark, small_dir, monkeypatch):
    """Neither hundreds of small files and state partitions for hundreds of shuffle partitions, nor state in the heap."""
    import glob
    import os

    from lineup.plans import q_stream
    made, key = {}, "spark.sql.shuffle.partitions"
    monkeypatch.setattr(q_stream, "shared_dir", lambda s, name: made.setdefault(name, shared_dir(s, name).removeprefix("file:")))
    before = spark.conf.get(key)
    spark.conf.set(key, "40")
    try:
        assert q_stream.odds_stream_windows(spark, small_dir).count() > 0
        assert spark.conf.get(key) == "40" and spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith(".HDFSBackedStateStoreProvider")
    finally:
        spark.conf.set(key, before)
    cores = spark.sparkContext.defaultParallelism
    assert len(glob.glob(f"{made['odds_windows']}/part-*")) <= (len(q_stream.WINDOW_SNAPSHOTS) + 1) * cores
    for operator in (0, 1):
        parts = [p for p in os.listdir(f"{made['odds_windows_ck']}/state/{operator}") if p.isdigit()]
        assert len(parts) == cores
        assert all(glob.glob(f"{made['odds_windows_ck']}/state/{operator}/{p}/*.zip") for p in parts)


def test_more_documents_make_more_files(spark, tmp_path, monkeypatch):
    spark.range(1001).selectExpr("id as o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert derive.feed_files(spark, str(tmp_path)) == cores
    monkeypatch.setattr(derive, "DOCS_PER_FILE", 50)
    assert derive.feed_files(spark, str(tmp_path)) == 21


@pytest.mark.parametrize("move", [0, 29])
def test_text_building_is_compiled(spark, small_dir, move):
    """A method of more than 8,000 bytes is interpreted row by row."""
    import re
    adaptive = "spark.sql.adaptive.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        shown = derive.odds_documents(spark, small_dir, move)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set(adaptive, before)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 7600
