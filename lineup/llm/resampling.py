"""Importance resampling towards a target distribution, with features from prefix CRCs.

A document's words, joined by one space, are scanned once; the CRC-32 of everything up to the
start and up to the end of each word is noted.  CRCs are linear over GF(2),

    crc(AB) = shift(crc(A), |B|) xor crc(B),

so the CRC of any run of words follows from two noted values, without its bytes: the one at its
end, xor the one at its start shifted by the run's length.  The shift by 2**k bytes is a linear map,
kept as four tables of 256 values.

The buckets of all features (CRC modulo their number) are written once.  Counts over all
documents and all target texts give a gain per bucket; a document's weight is the floored mean of its
features' gains, its score adds Gumbel noise fixed by its identifier, and the highest
scores are drawn.  Scores are whole numbers of a bounded range: their histogram gives the lowest
drawn score, only documents at or above it are put in order (by range partitions), and the
rest never moves.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineup.llm.common import byte_slices, partitions
from lineup.llm.words import ALNUM_LOWER
from lineup.session import shared_dir

#: The reflected CRC-32 polynomial (fixed value).
POLYNOMIAL = 0xEDB88320
#: Bytes of a text that are cut into words at once.
CHUNK = 1 << 20


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_BYTE = _byte_table()


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24])


def _shift_levels(levels: int = 40) -> list[np.ndarray]:
    """Level k: the linear map "2**k zero bytes follow", as tables for the four bytes of a CRC."""
    every = np.arange(256, dtype=np.uint32)
    columns = [every << np.uint32(8 * j) for j in range(4)]
    out = [np.array([_BYTE[c & 255] ^ (c >> 8) for c in columns])]
    while len(out) < levels:
        out.append(np.array([_apply(out[-1], _apply(out[-1], c)) for c in columns]))
    return out


_LEVELS = _shift_levels()


def shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """``crc`` of a text as it counts towards the CRC of that text and ``n_bytes`` more."""
    out, k = crc.astype(np.uint32), 0
    left = np.asarray(n_bytes, np.int64)
    while len(left) and (left >> k).any():
        at = np.flatnonzero((left >> k) & 1)
        out[at] = _apply(_LEVELS[k], out[at])
        k += 1
    return out


def prefix_crcs(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(CRC of the joined words up to the end of each word, length of each word in bytes)."""
    crcs: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    crc, first = 0, True
    data = (text or b"").translate(ALNUM_LOWER)
    at = 0
    while at < len(data):
        stop = data.find(b"\n", at + CHUNK)
        stop = len(data) if stop < 0 else stop
        found = []
        words = data[at:stop].split()
        for word in words:
            crc = crc32(word) if first else crc32(word, crc32(b" ", crc))
            first = False
            found.append(crc)
        crcs.append(np.array(found, np.uint32))
        lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
        at = stop
    if not crcs:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(crcs), np.concatenate(lengths)


def gram_crcs(ends: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """CRC-32 of every run of ``n`` words of one document, from its prefix CRCs."""
    count = len(ends) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint32)
    # up to the start of a word: the end of the one before and a space
    flipped = ~ends[:-1]
    starts = np.concatenate([[np.uint32(0)], ~(_BYTE[(flipped ^ np.uint32(32)) & 255] ^ (flipped >> 8))])
    stop = np.cumsum(lengths + 1) - 1
    size = stop[n - 1:] - (stop - lengths)[:count]
    return ends[n - 1:] ^ shift(starts[:count], size)


def features(rows: DataFrame, keys: list[str], max_n: int, buckets: int) -> DataFrame:
    """``keys``, ``n_words, n_features, buckets``: the buckets of all runs of 1 to ``max_n`` words of
    ``text``, as little-endian integers of 2 bytes, or 4 beyond 65,536 buckets."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def find(batches: Iterable[pa.RecordBatch]):
        for batch, texts in byte_slices(batches):
            words, counts, data = [], [], []
            for text in texts:
                ends, lengths = prefix_crcs(text)
                found = [(gram_crcs(ends, lengths, n) % np.uint32(buckets)).astype(kind) for n in range(1, max_n + 1)]
                words.append(len(ends))
                counts.append(sum(map(len, found)))
                data.append(b"".join(f.tobytes() for f in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keys))]
                + [pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(data, pa.binary())],
                [*keys, "n_words", "n_features", "buckets"])

    return rows.select(*keys, "text").mapInArrow(
        find, ", ".join([f"{k} long" for k in keys] + ["n_words long, n_features long, buckets binary"]))


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: counted per task, then added up (``buckets`` rows come back)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterable[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(data, kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of target share over source share), both smoothed by one."""
    t_all, s_all, m = float(target.sum()), float(source.sum()), len(target)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m))))
                     for t, s in zip(target.tolist(), source.tolist())], np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, tie, n_words, n_features, weight``: the floored mean gain (no feature: 0)."""
    shared = found.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def weigh(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out = []
            for data in batch.column(4).to_pylist():
                at = np.frombuffer(data, kind)
                out.append(int(shared.value[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(out, pa.int64())],
                                             ["doc_id", "tie", "n_words", "n_features", "weight"])

    return found.select("doc_id", "tie", "n_words", "n_features", "buckets").mapInArrow(
        weigh, "doc_id long, tie long, n_words long, n_features long, weight long")


def draw(scored: DataFrame, eligible, percent: int) -> DataFrame:
    """Add ``rank`` (1, 2, ... by falling ``score``, ties to the smaller doc_id, NULL for what is not
    drawn) to a written table; floor(percent * N / 100) of the N eligible rows are drawn."""
    spark = scored.sparkSession
    histogram = {r["score"]: r["n"] for r in scored.where(eligible).groupBy("score").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # whole scores of a bounded range, not rows
    wanted = percent * sum(histogram.values()) // 100
    least, above = None, 0
    for s in sorted(histogram, reverse=True):
        if above >= wanted:
            break
        least, above = s, above + histogram[s]
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    chosen = eligible & (F.col("score") >= least)
    # the row number as last key splits rows that are equal in all others
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("_row")]
    path = shared_dir(spark, "drawn")
    (scored.where(chosen).withColumn("_row", F.monotonically_increasing_id())
     .repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
     .withColumn("_at", F.monotonically_increasing_id()).drop("_row").write.parquet(path))
    top = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    first = []
    at = 0
    for r in sorted(top.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row a partition
        first.append((r["_part"], at))
        at += r["n"]
    top = top.join(F.broadcast(spark.createDataFrame(first, "_part long, _first long")), "_part")
    rank = F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    top = top.withColumn("rank", F.when(rank <= wanted, rank)).drop("_part", "_at", "_first")
    rest = scored.where(~F.coalesce(chosen, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return rest.unionByName(top.select(rest.columns))


def resample(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, min_words: int = 20,
             percent: int = 10, seed: int = 2024) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``docs(doc_id, text)``;
    ``target(text)`` shows the wanted distribution.

    Defined cases.  A NULL or empty text has no words (weight 0, never drawn); a very long text is cut into
    words in pieces; a NULL doc_id is smaller than any other and its noise is that of an empty
    identifier; rows of one doc_id and score are ordered by a hash of the text, equal rows in any order,
    each with a rank of its own; an empty table gives an empty result, an empty target only smooths;
    other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    path = shared_dir(spark, "features")
    features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"),
                         text.cast("binary").alias("text")), ["doc_id", "tie"], max_n, buckets).write.parquet(path)
    found = spark.read.parquet(path)
    wanted = bucket_counts(features(target.select(text.cast("binary").alias("text")), [], max_n, buckets), buckets)
    weighted = weights(found, gains(wanted, bucket_counts(found, buckets)))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    path = shared_dir(spark, "scores")
    weighted.withColumn("score", (F.col("weight") + noise).cast("long")).write.parquet(path)
    scored = spark.read.parquet(path)
    return draw(scored, F.col("n_words") >= min_words, percent).drop("tie")
