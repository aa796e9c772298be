"""Benchmark decontamination with a broadcast set of test n-grams.

Words are runs of ASCII letters and digits and of non-ASCII characters, with
A-Z lower-cased.  A test item of at least ``n`` words gives all its n-word
windows, a shorter one is a single window, an empty one none.  Training texts
are scanned once: the hash of every window is looked up in the set, hits are
verified word by word, and all words inside verified windows are hit.

The set is broadcast only up to ``MAX_WINDOWS`` windows.  A larger benchmark is
cut into blocks of about that size, long items between their windows by the executors; the
documents are scanned once per block and the hits of each row are put together by a row number
written before.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineup.llm.common import boxed, byte_slices, unboxed
from lineup.llm.words import ALNUM_LOWER, Words
from lineup.session import shared_dir

#: Windows of one broadcast set, each well under 200 bytes of a worker's memory for common words.
MAX_WINDOWS = 200_000

RESULT = "doc_id long, n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<lo: int, hi: int>>"


class WindowSet:
    """Windows of some test items: sorted hashes, the words and the items of each."""

    def __init__(self, items: list[tuple[str, bytes | None]], n: int):
        found: dict[tuple[int, bytes], set[str]] = {}
        hashes: dict[tuple[int, bytes], int] = {}
        words = Words([t for _, t in items], ALNUM_LOWER)
        by_length: dict[int, np.ndarray] = {}
        for k, (item, _) in enumerate(items):
            lo, hi = int(words.first[k]), int(words.first[k + 1])
            if hi == lo:
                continue
            length = min(n, hi - lo)
            if length not in by_length:
                by_length[length] = words.windows(length)
            own = words.list(lo, hi)
            for i in range(hi - lo - length + 1):
                key = (length, b" ".join(own[i:i + length]))
                found.setdefault(key, set()).add(item)
                hashes[key] = int(by_length[length][lo + i])
        self.lengths = sorted({k[0] for k in found})
        self.items = {k: sorted(v) for k, v in found.items()}
        self.hashes = {m: np.unique(np.array([h for k, h in hashes.items() if k[0] == m], np.uint64))
                       for m in self.lengths}
        self.bits = {}
        for m, h in self.hashes.items():
            size = 1 << max(16, int(len(h) * 16).bit_length())
            table = np.zeros(size, bool)
            table[h & np.uint64(size - 1)] = True
            self.bits[m] = table

    def hits(self, words: Words) -> list[tuple[int, int, list[str]]]:
        """(first word, words, items) of each verified window, of all texts of ``words``."""
        out = []
        for m in self.lengths:
            h = words.windows(m)
            table = self.bits[m]
            maybe = np.flatnonzero(table[h & np.uint64(len(table) - 1)] & words.whole(m))
            known = self.hashes[m]
            at = np.searchsorted(known, h[maybe])
            maybe = maybe[known[np.minimum(at, len(known) - 1)] == h[maybe]]
            for i in maybe.tolist():
                items = self.items.get((m, words.text(i, i + m)))
                if items is not None:
                    out.append((i, m, items))
        return out


def _merge(hits: list[tuple[int, int, list[str]]]) -> tuple[list[str], list[dict]]:
    """Item ids sorted as strings, and the union of the windows as [lo, hi) word ranges."""
    spans: list[list[int]] = []
    for lo, m, _ in sorted(h[:2] + (0,) for h in hits):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], lo + m)
        else:
            spans.append([lo, lo + m])
    return sorted({i for h in hits for i in h[2]}), [{"lo": lo, "hi": hi} for lo, hi in spans]


_SPAN = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])


def _scanned(batches: Iterable[pa.RecordBatch], shared) -> Iterable[tuple[pa.RecordBatch, Words, list[tuple]]]:
    """Slices of the batches with their words, and per row (items, spans)."""
    windows = shared.value
    for rows, texts in byte_slices(batches):
        words = Words(texts, ALNUM_LOWER)
        per: list[list] = [[] for _ in texts]
        found = windows.hits(words)
        owner = np.searchsorted(words.first, [h[0] for h in found], side="right") - 1
        for d, (lo, m, items) in zip(owner.tolist(), found):
            per[d].append((lo - int(words.first[d]), m, items))
        yield rows, words, [_merge(h) if h else ([], []) for h in per]


def _scan(docs: DataFrame, shared) -> DataFrame:
    """RESULT for each row of ``doc_id, text``."""
    def scan(batches: Iterable[pa.RecordBatch]):
        for rows, words, merged in _scanned(batches, shared):
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column(0), "n_words": pa.array(words.count, pa.int64()),
                "n_hit": pa.array([sum(s["hi"] - s["lo"] for s in m[1]) for m in merged], pa.int64()),
                "item_ids": pa.array([m[0] for m in merged], pa.list_(pa.string())),
                "hit_spans": pa.array([m[1] for m in merged], pa.list_(_SPAN))})

    return docs.mapInArrow(scan, RESULT)


def _scan_hits(docs: DataFrame, shared) -> DataFrame:
    """``row, item_ids, hit_spans`` for the rows of ``row, text`` with a hit."""
    def scan(batches: Iterable[pa.RecordBatch]):
        for rows, _, merged in _scanned(batches, shared):
            at = pa.array([i for i, m in enumerate(merged) if m[1]], pa.int64())
            yield pa.RecordBatch.from_arrays([
                rows.column(0).take(at), pa.array([m[0] for m in merged if m[1]], pa.list_(pa.string())),
                pa.array([m[1] for m in merged if m[1]], pa.list_(_SPAN))], ["row", "item_ids", "hit_spans"])

    return docs.mapInArrow(scan, "row long, item_ids array<string>, hit_spans array<struct<lo: int, hi: int>>")


def _scan_clean(docs: DataFrame, shared) -> DataFrame:
    """The rows of ``doc_id, text, _rest`` without a hit."""
    def scan(batches: Iterable[pa.RecordBatch]):
        for rows, _, merged in _scanned(batches, shared):
            text = rows.column(1).cast(pa.large_string()).cast(pa.string())
            yield rows.set_column(1, "text", text).filter(pa.array([not m[1] for m in merged], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def _cut(items: DataFrame, n: int, size: int) -> DataFrame:
    """``item_id, text`` (bytes): the items' words in pieces of at most ``size`` windows, each
    window in one piece of its item."""
    def cut(batches: Iterable[pa.RecordBatch]):
        for rows, texts in byte_slices(batches):
            words = Words(texts, ALNUM_LOWER)
            for item, lo, hi in zip(rows.column(0).to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist()):
                last = max(hi - n, lo)  # start of the last window
                pieces = [words.text(a, min(a + size - 1 + n, hi)) for a in range(lo, last + 1, size) if hi > lo]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(pieces), pa.string()), pa.array(pieces, pa.binary())], ["item_id", "text"])

    return items.mapInArrow(cut, "item_id string, text binary").distinct()


def _blocks(spark: SparkSession, benchmark: DataFrame, n: int, max_windows: int) -> list:
    """The benchmark as functions that each broadcast one block of its windows."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    # a word has at least one byte and a separator, so this bounds the windows from above
    total = items.agg(F.sum(F.floor(F.octet_length("text") / 2) + 1)).first()[0] or 0
    blocks = max(1, -(-int(total) // (3 * max_windows)))  # texts have more than 3 bytes a word, mostly
    pieces = items.withColumn("text", F.col("text").cast("binary"))
    if blocks > 1:
        path = shared_dir(spark, "benchmark")
        number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")
        cut = _cut(items, n, max(1, max_windows // 8)).withColumn("block", number)
        cut.repartition("block").write.partitionBy("block").parquet(path)
        pieces = spark.read.schema("item_id string, text binary, block int").parquet(path)

    def block(b: int):
        part = pieces.where(F.col("block") == b) if blocks > 1 else pieces
        return spark.sparkContext.broadcast(WindowSet([(r[0], bytes(r[1])) for r in part.collect()], n))

    return [partial(block, b) for b in range(blocks)]


def _save(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession, "contamination")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows, written once with a number ``row``, so that every block's scan sees the same ones."""
    return _save(docs.withColumn("row", F.monotonically_increasing_id()))


def _all_hits(numbered: DataFrame, blocks: list) -> DataFrame:
    """``row, item_ids, hit_spans`` of every block's scan of ``numbered``."""
    docs = numbered.select("row", "text")
    return reduce(DataFrame.unionAll, [_save(_scan_hits(docs, block())) for block in blocks])


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10,
                       max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_words, n_hit, item_ids, hit_spans``.

    ``item_ids`` are sorted as strings (a NULL item_id is the empty string); ``hit_spans``
    are ranges of word numbers.  A NULL or empty text has no words and no hit; an empty
    benchmark hits nothing; repeated items count once; repeated documents each give a row.
    Columns other than ``doc_id, text`` and ``item_id, text`` are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(spark, benchmark, n, max_windows)
    if len(blocks) == 1:
        return _scan(docs, blocks[0]())

    numbered = _numbered(docs)
    hit = _all_hits(numbered, blocks).groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.flatten(F.collect_list("hit_spans")).alias("_spans"))
    # union of the word ranges of the blocks
    hit = hit.withColumn("hit_spans", F.expr(
        "aggregate(array_sort(_spans), cast(array() as array<struct<lo: int, hi: int>>), (acc, s) -> "
        "case when size(acc) > 0 and s.lo <= element_at(acc, -1).hi then concat(slice(acc, 1, size(acc) - 1), "
        "array(named_struct('lo', element_at(acc, -1).lo, 'hi', greatest(element_at(acc, -1).hi, s.hi)))) "
        "else concat(acc, array(s)) end)")).drop("_spans")
    base = _save(numbered.select("row", "doc_id", "text").mapInArrow(_count, "row long, doc_id long, n_words long"))
    out = base.join(hit, "row", "left")
    spans = F.coalesce("hit_spans", F.expr("cast(array() as array<struct<lo: int, hi: int>>)"))
    return out.select("doc_id", "n_words",
                      F.aggregate(spans, F.lit(0).cast("long"),
                                  lambda a, s: a + (s["hi"] - s["lo"]).cast("long")).alias("n_hit"),
                      F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"),
                      spans.alias("hit_spans"))


def _count(batches: Iterable[pa.RecordBatch]):
    for rows, texts in byte_slices(batches):
        n = Words(texts, ALNUM_LOWER).count
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n, pa.int64())],
                                         ["row", "doc_id", "n_words"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10,
                        max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text holds no window of the benchmark.

    Every row is judged by its own text.  The scan and the filter are one pass when the set is
    broadcast whole; otherwise the rows are numbered and those with a hit in any block go by number.
    """
    blocks = _blocks(docs.sparkSession, benchmark, n, max_windows)
    rows = boxed(docs).withColumn("text", F.col("text").cast("string"))
    if len(blocks) == 1:
        return unboxed(_scan_clean(rows, blocks[0]()), docs.columns)
    numbered = _numbered(rows)
    clean = numbered.join(_all_hits(numbered, blocks).select("row"), "row", "left_anti")
    return unboxed(clean, docs.columns)
