"""Streaming query (R1): odds snapshots -> latest quote per book -> consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineup.plans import derive
from lineup.plans.catalog import register
from lineup.plans.q_markets import _decimal_sql
from lineup.session import shared_dir
from lineup.streaming.odds_stream import consensus_from_quotes, run_quotes, run_windows

#: The snapshots of the fixture: time and price movement; the second also moves some starts.
SNAPSHOTS = [("2024-01-01 12:00:00", 0), ("2024-01-01 12:10:00", 29)]


@register("odds_stream_consensus",
          "with " + derive.cte_odds_rows(SNAPSHOTS[-1][1]) + " select game_id, max(commence_time) as commence_time, "
          "avg(" + _decimal_sql("home_odds") + ") as home_odds, avg(" + _decimal_sql("away_odds") + ") as away_odds, "
          "count(*) as n_books from odds_rows group by game_id", doubles=["home_odds", "away_odds"])
def odds_stream_consensus(spark, sf_dir):
    """Two snapshots of every feed document arrive as files, the second with other
    prices and some moved starts; the consensus read from the stream's output is that of the last."""
    src = shared_dir(spark, "odds_snapshots")
    for time, move in SNAPSHOTS:
        docs = derive.odds_documents(spark, sf_dir, move)
        docs.select(F.lit(time).cast("timestamp").alias("snapshot_ts"), "doc").write.mode("append").json(src, compression="gzip")
    sink, ck = shared_dir(spark, "odds_quotes"), shared_dir(spark, "odds_quotes_ck")
    run_quotes(spark, src, sink, ck, lateness="1 hour", files_per_trigger=64)
    out = consensus_from_quotes(spark.read.parquet(sink))
    return out.withColumn("commence_time", F.col("commence_time").cast("timestamp_ntz"))


#: Time and movement of the snapshots of the window query; the third repeats the second, the last two share no window.
WINDOW_SNAPSHOTS = [("2024-01-01 12:00:00", 0), ("2024-01-01 12:10:00", 29), ("2024-01-01 12:10:00", 29),
                    ("2024-01-01 12:20:00", 58)]
#: A document without games that ends the stream's time, beyond all windows and their lateness.
LAST_SNAPSHOT = "2024-01-01 18:00:00"


def _windows_sql() -> str:
    parts = " union all ".join(
        "select * from (with " + derive.cte_odds_rows(move) + f" select game_id, timestamp '{time}' as seen, "
        + _decimal_sql("home_odds") + " as ho, " + _decimal_sql("away_odds") + " as ao from odds_rows)"
        for time, move in dict.fromkeys(WINDOW_SNAPSHOTS))
    return ("select time_bucket(interval 15 minutes, seen) as window_start, game_id, avg(ho) as home_odds, avg(ao) as "
            "away_odds, count(*) as n_quotes, max(seen) as last_seen from (" + parts + ") group by 1, 2")


@register("odds_stream_windows", _windows_sql(), doubles=["home_odds", "away_odds"])
def odds_stream_windows(spark, sf_dir):
    """Consensus per 15-minute window of the feed in append mode, a snapshot that arrives twice counted once."""
    src, files = shared_dir(spark, "odds_windows"), derive.feed_files(spark, sf_dir)
    for time, move in WINDOW_SNAPSHOTS:
        docs = derive.odds_documents(spark, sf_dir, move, files)
        docs.select(F.lit(time).cast("timestamp").alias("snapshot_ts"), "doc").write.mode("append").json(src, compression="gzip")
    end = spark.createDataFrame([("[]",)], "doc string")
    end.select(F.lit(LAST_SNAPSHOT).cast("timestamp").alias("snapshot_ts"), "doc").write.mode("append").json(src, compression="gzip")
    sink, ck = shared_dir(spark, "odds_windows_out"), shared_dir(spark, "odds_windows_ck")
    run_windows(spark, src, sink, ck, lateness="1 hour", files_per_trigger=64, state_partitions=files)
    out = spark.read.parquet(sink).select("window_start", "game_id", "home_odds", "away_odds", "n_quotes", "last_seen")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "last_seen")})
