"""Best-fit packing with large-item matching.

Documents become pieces of at most ``capacity`` tokens.  Packing needs their
lengths only, and lengths are small integers, so the whole corpus is one
histogram (at most ``capacity`` counts).  ``plan_bins`` packs the histogram
exactly as best-fit would pack the items one by one, with all items and bins of
one size handled together:

1. *Large items* (over a third of the capacity): at most two fit a bin.  From
   the longest down, each takes the longest partner that still fits (which
   yields the fewest bins for such items).
2. *Small items*, from the longest down, go to the bin with the smallest gap
   that holds them; where none does, to a new bin.

The plan is a list of slots: "of length L, the items ranked r0 .. r0+n-1 go to
bins b0, b0+d, ... at offset o".  Its size depends on the capacity, not on the
number of documents.  Ranks come from per-(length, salt) counts and a row
number within the salted group, so one very common length is spread over tasks; the salt is of a
row's number in the written table, so rows that are equal in everything are spread as well.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineup.llm.common import slices
from lineup.llm.tokens import WORD_BPE, encoder
from lineup.session import shared_dir

#: Rows of one length that share a salt, on average; a length gets as many salts as it needs.
RANK_GROUP = 200


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots ``(length, first rank, items, first bin, items per bin, offset)`` for a
    histogram of lengths.  Item ``first rank + i`` goes to bin ``first bin + i // per``
    at ``offset + (i % per) * length``."""
    left = {n: c for n, c in counts.items() if c > 0 and n > 0}
    if any(n > capacity for n in left):
        raise ValueError("a piece is longer than the capacity")
    rank = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first bin, bins)]
    bins = 0

    def place(length: int, items: int, first: int, per: int, offset: int) -> None:
        slots.append((length, rank[length], items, first, per, offset))
        rank[length] += items
        left[length] -= items

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            gaps.setdefault(gap, []).append((first, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    at = 0
    while at < len(large):
        a = large[at]
        if not left[a]:
            at += 1
            continue
        b = next((x for x in large[at:] if left[x] and a + x <= capacity and (x != a or left[a] > 1)), None)
        if b is None:
            n = left[a]
            place(a, n, bins, 1, 0)
        elif a == b:
            n = left[a] // 2
            place(a, 2 * n, bins, 2, 0)
        else:
            n = min(left[a], left[b])
            place(a, n, bins, 1, 0)
            place(b, n, bins, 1, a)
        leave(capacity - a - (b or 0), bins, n)
        bins += n

    for length in sorted((n for n in left if left[n]), reverse=True):
        heap = [g for g in gaps if g >= length]
        heapq.heapify(heap)
        while left[length]:
            if heap:
                gap = heap[0]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    heapq.heappop(heap)
            else:
                gap, first = capacity, bins
                n = -(-left[length] // (capacity // length))
                bins += n
            per = gap // length
            full = min(n, left[length] // per)
            if full:
                place(length, full * per, first, per, capacity - gap)
                leave(gap - per * length, first, full)
            rest = left[length] if full < n else 0
            if rest:
                place(length, rest, first + full, rest, capacity - gap)
                leave(gap - rest * length, first + full, 1)
                full += 1
            leave(gap, first + full, n - full)
    return slots


def cut_pieces(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int | None = 1, capacity: int = 4096,
               with_tokens: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: ``doc_id, piece, start, length, ids_crc32`` and, if asked
    for, ``tokens``.  Only documents over the capacity are cut; a NULL text is the empty text;
    a document without any token (``end_id=None``) has no piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", tokens array<long>" if with_tokens else ""

    def cut(batches: Iterable[pa.RecordBatch]):
        enc = encoder(tokenizer)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for rows, texts in slices(batches):
            cols = ([], [], [], [], [], [])
            for doc_id, ids in zip(rows.column(0).to_pylist(), enc.encode(texts)):
                ids = np.concatenate([ids, tail]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    for col, v in zip(cols, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()))):
                        col.append(v)
                    if with_tokens:
                        cols[5].append(part.tolist())
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "tokens"][:5 + with_tokens]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)][:len(names)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    ``pieces`` hold at least a ``length``; with a column ``_row`` that numbers the rows they must be a
    written table (it is read twice), else they are numbered and written here.  Rows with a NULL
    length or one below 1 hold nothing and are left out.  Equal rows are packed as often as they
    occur; other columns stay.  The driver holds the histogram and the plan, whose sizes depend on
    the capacity only.
    """
    spark = pieces.sparkSession
    if "_row" not in pieces.columns:
        path = shared_dir(spark, "numbered-pieces")
        pieces.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
        pieces = spark.read.parquet(path)
    pieces = pieces.where("length > 0")
    salted = pieces.withColumn("_h", F.pmod(F.xxhash64("_row"), F.lit(1 << 20)))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan_bins(counts, capacity)
    salts = spark.createDataFrame([(n, -(-c // RANK_GROUP)) for n, c in counts.items()], "length long, _salts long")
    salted = (salted.join(F.broadcast(salts), "length")  # one row per length, at most ``capacity`` rows
              .withColumn("_salt", F.pmod("_h", "_salts")).drop("_h", "_salts"))
    # ranks: rows of one (length, salt) follow those of the smaller salts of that length
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    first = sizes.withColumn("_block", F.floor(F.col("_salt") / RANK_GROUP))
    block = first.groupBy("length", "_block").agg(F.sum("_n").alias("_bn"))
    block = block.withColumn("_b0", F.sum("_bn").over(W.partitionBy("length").orderBy("_block")) - F.col("_bn"))
    first = (first.withColumn("_in", F.sum("_n").over(W.partitionBy("length", "_block").orderBy("_salt")) - F.col("_n"))
             .join(block.select("length", "_block", "_b0"), ["length", "_block"])
             .select("length", "_salt", (F.col("_b0") + F.col("_in")).alias("_first")))
    w = W.partitionBy("length", "_salt").orderBy("_row")
    ranked = (salted.withColumn("_row", F.row_number().over(w) - 1).join(first, ["length", "_salt"])
              .withColumn("_rank", F.col("_first") + F.col("_row")).drop("_first", "_row", "_salt"))

    table = np.array(sorted(slots), np.int64).reshape(-1, 6)
    plan = spark.sparkContext.broadcast(table)  # size bounded by the capacity

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def slot_of(length, rank):
        import pandas as pd
        t = plan.value
        # slots of one length are in rank order and without gaps, lengths ascend
        span = int(t[:, 1].max()) + int(t[:, 2].max()) + 1
        keys = t[:, 0].astype(object) * span + t[:, 1] if span > 1 << 49 else t[:, 0] * span + t[:, 1]
        want = length.to_numpy() * span + rank.to_numpy()
        k = np.searchsorted(keys, want, side="right") - 1
        i = rank.to_numpy() - t[k, 1]
        return pd.DataFrame({"sequence_id": t[k, 3] + i // t[k, 4],
                             "offset": t[k, 5] + (i % t[k, 4]) * t[k, 0]})

    return (ranked.withColumn("_s", slot_of("length", "_rank"))
            .withColumns({"sequence_id": F.col("_s.sequence_id"), "offset": F.col("_s.offset")})
            .drop("_s", "_rank", "_row"))


def pack_documents(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int | None = 1, capacity: int = 4096,
                   with_tokens: bool = False) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and offset.

    The pieces are written once to the shared folder, so that texts are encoded once.
    A NULL text is the empty text (its end token alone); a very long text gives as many pieces as it
    needs; NULL or equal doc_ids and equal rows keep their own pieces; an empty table gives an empty
    result; columns other than ``doc_id, text`` are not read.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "pieces")
    pieces = cut_pieces(docs, tokenizer, end_id, capacity, with_tokens)
    pieces.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    return pack(spark.read.parquet(path), capacity)
