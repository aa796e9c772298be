"""Odds snapshots as a stream.

File source of feed snapshots -> the batch flatten (S6) -> per (day of the
snapshot, game, bookmaker) the latest quote, kept in watermarked state and
written per micro-batch.  Event time is the time of the snapshot, when the
prices were quoted, not the start of the game: a quote for a game next week does
not make tonight's quotes late, and a moved start replaces the old one.  State of a
day goes once the watermark has passed it.

The consensus over bookmakers (A23) is computed from the written quotes: the
latest version of a (game, bookmaker) replaces the earlier ones.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineup.operators.markets import decimal_quotes
from lineup.sources.odds_json import flatten_odds

SNAPSHOT_SCHEMA = "snapshot_ts timestamp, doc string"
QUOTE = ("snapshot_ts", "commence_time", "home_odds", "away_odds")


def quotes_stream(spark: SparkSession, source: str, lateness: str = "2 hours",
                  files_per_trigger: int = 4) -> DataFrame:
    """Streaming DataFrame of the latest quote per (snapshot day, game, bookmaker).
    Snapshots older than the newest seen by more than ``lateness`` are late and dropped."""
    snaps = (spark.readStream.schema(SNAPSHOT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
             .json(source))
    rows = flatten_odds(snaps, "doc", keep=("snapshot_ts",)).withWatermark("snapshot_ts", lateness)
    # the struct orders by snapshot time first; the other fields only break ties
    return (rows.groupBy(F.window("snapshot_ts", "1 day").alias("w"), "game_id", "bookmaker")
            .agg(F.max(F.struct(*QUOTE)).alias("q"))
            .select("game_id", "bookmaker", *[F.col(f"q.{c}").alias(c) for c in QUOTE]))


def run_quotes(spark: SparkSession, source: str, sink: str, checkpoint: str, **kw) -> None:
    """Run the quote stream to completion (``availableNow``) in update mode; each
    micro-batch writes its updated keys to a folder of its own, so a repeated batch
    replaces its rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    q = (quotes_stream(spark, source, **kw).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """One row per (game, bookmaker): the latest written version.  Writing this table anew
    compacts a long-running sink."""
    return (quotes.groupBy("game_id", "bookmaker").agg(F.max(F.struct(*QUOTE)).alias("q"))
            .select("game_id", "bookmaker", *[F.col(f"q.{c}").alias(c) for c in QUOTE]))


def consensus_from_quotes(quotes: DataFrame) -> DataFrame:
    """Mean decimal price per game over the latest quote of each bookmaker, with the start
    that the newest of them names."""
    latest = decimal_quotes(latest_quotes(quotes))
    return latest.groupBy("game_id").agg(
        F.max(F.struct("snapshot_ts", "commence_time"))["commence_time"].alias("commence_time"),
        F.avg("home_odds").alias("home_odds"), F.avg("away_odds").alias("away_odds"),
        F.count(F.lit(1)).alias("n_books"))


def window_consensus(quotes: DataFrame, width: str = "15 minutes") -> DataFrame:
    """R1 + A23 per window of event time: mean decimal price of each side, quotes and newest snapshot of
    every (window, game), over rows that are distinct in (game, bookmaker, snapshot).  The same
    for a batch and for a stream."""
    decimal = decimal_quotes(quotes)
    return (decimal.groupBy(F.window("snapshot_ts", width).alias("w"), "game_id").agg(
        F.avg("home_odds").alias("home_odds"), F.avg("away_odds").alias("away_odds"),
        F.count(F.lit(1)).alias("n_quotes"), F.max("snapshot_ts").alias("last_seen"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "game_id", "home_odds",
                "away_odds", "n_quotes", "last_seen"))


def windows_stream(spark: SparkSession, source: str, width: str = "15 minutes", lateness: str = "2 hours",
                   files_per_trigger: int = 4) -> DataFrame:
    """Streaming windows of the feed, each given once, when the watermark has passed its end.

    A file that arrives twice, or a snapshot that overlaps another, repeats (game, bookmaker, snapshot):
    only the first such row counts (``dropDuplicatesWithinWatermark``, whose state goes with the
    watermark).  Rows older than the newest snapshot by more than ``lateness`` are dropped by both
    operators.  The watermark stands before the flatten, so that a document without games
    still moves time on."""
    snaps = (spark.readStream.schema(SNAPSHOT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(source)
             .withWatermark("snapshot_ts", lateness))
    rows = flatten_odds(snaps, "doc", keep=("snapshot_ts",))
    return window_consensus(rows.dropDuplicatesWithinWatermark(["game_id", "bookmaker", "snapshot_ts"]), width)


#: State on the executors' disks with bounded memory: one key for each quote of the last hours is too much for a heap.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # counting the rows costs another look-up of every key that is put
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def _configured(spark: SparkSession, conf: dict):
    """The session with ``conf`` inside, as before afterwards.  A stream that starts inside keeps it."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_windows(spark: SparkSession, source: str, sink: str, checkpoint: str, state_partitions: int | None = None,
                **kw) -> None:
    """Run the windows to completion (``availableNow``) in append mode into a Parquet sink, which
    commits every micro-batch once.  ``state_partitions`` (without it the session's shuffle partitions) cuts the state of a
    new checkpoint, which keeps it; every micro-batch opens and commits each part of both operators."""
    conf = DISK_STATE | ({"spark.sql.shuffle.partitions": str(state_partitions)} if state_partitions else {})
    stream = (windows_stream(spark, source, **kw).writeStream.outputMode("append").format("parquet")
              .option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True))
    with _configured(spark, conf):
        q = stream.start()
    q.awaitTermination()
