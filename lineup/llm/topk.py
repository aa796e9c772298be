"""Exact top-k by integer inner product with a pivot table.

Vectors become integers, floor(scale * x).  The pivot table holds, for every row, its
distances to ``N_PIVOTS`` pivots, its norm and the vector.  For a query q and a row x

    d(q, x) >= max over pivots p of |d(q, p) - d(x, p)|,
    <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2,

so the table bounds every score from above.  Per task the rows are taken in
order of their bound and scored until the k-th best score beats every bound left: no
row that could enter the result is skipped, whatever the data.  Each task gives at
most k rows per query; the best k of those are the result.

Queries are broadcast in blocks of ``QUERY_BLOCK`` rows.  Every block is one pass over the pivot table, whose
result is written before the next block is broadcast and its own broadcast released, so neither
the plan nor what is broadcast grows with the number of queries.  Pivots are chosen from at
most ``PIVOT_SAMPLE`` rows, which changes the work only.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineup.session import shared_dir

N_PIVOTS = 24
PIVOT_SAMPLE = 512
QUERY_BLOCK = 4096
#: Scores of fewer rows than this are computed at once between two looks at the bounds.
STEP = 256
_EXACT = float(1 << 53)


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, vec`` (array of double holding whole numbers) of the rows that take part: id and
    vector not NULL, all components finite.  Vectors of unequal length count as padded with zeros."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), bad.alias("bad"))
            .where("id is not null and vec is not null and not bad")
            .select("id", F.transform("vec", lambda x: F.floor(x * float(scale)).cast("double")).alias("vec")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    offsets = np.diff(column.offsets.to_numpy())
    if (offsets == dim).all():
        return np.ascontiguousarray(flat.reshape(-1, dim), np.float64)
    out = np.zeros((len(offsets), dim))
    at = 0
    for i, n in enumerate(offsets.tolist()):
        out[i, :n] = flat[at:at + n]
        at += n
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the row furthest from those already chosen."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample ** 2).sum(1)))]
    gap = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products: in doubles where all sums stay below 2**53, else in 64-bit integers."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * len(q) < _EXACT:
        return (x @ q).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def pivot_table(vectors: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """``id, vec, dist``: the distances to all pivots of every row."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # N_PIVOTS rows

    def distances(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            d = _distances(_matrix(b.column(1), dim), shared.value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(list(d), pa.list_(pa.float64()))], ["id", "vec", "dist"])

    return vectors.mapInArrow(distances, "id long, vec array<double>, dist array<double>")


def _search(table: DataFrame, shared, k: int, dim: int) -> DataFrame:
    """``query_id, id, score``: the best ``k`` of every task for the broadcast block of queries."""
    def search(batches: Iterable[pa.RecordBatch]):
        ids, queries, dists = shared.value
        norm = (queries ** 2).sum(1)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        for b in batches:
            rid = b.column(0).to_numpy()
            x = _matrix(b.column(1), dim)
            d = np.ascontiguousarray(_matrix(b.column(2), dists.shape[1]).T)
            half = (x ** 2).sum(1) / 2
            for i in range(len(ids)):
                lower = np.zeros(len(rid))
                for p in range(len(d)):
                    np.maximum(lower, np.abs(d[p] - dists[i, p]), out=lower)
                # the slack covers the rounding of roots and squares
                upper = norm[i] / 2 + half - lower * lower / 2
                upper += 1e-6 * (norm[i] + 2 * half) + 1e-3
                s, r = best[i]
                least = s[-1] if len(s) >= k else -np.inf
                maybe = np.flatnonzero(upper >= least)
                maybe = maybe[np.argsort(-upper[maybe], kind="stable")]
                at, step = 0, max(STEP, 2 * k)
                while at < len(maybe):
                    if len(s) >= k and upper[maybe[at]] < s[-1]:
                        break
                    part = maybe[at:at + step]
                    part = part[rid[part] != ids[i]]
                    s = np.concatenate([s, _scores(queries[i], x[part])])
                    r = np.concatenate([r, rid[part]])
                    order = np.lexsort((r, -s))[:k]
                    s, r = s[order], r[order]
                    at += step
                    step *= 2
                best[i] = (s, r)
        n = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_pydict({
            "query_id": pa.array(np.repeat(ids, n), pa.int64()),
            "id": pa.array(np.concatenate([r for _, r in best]), pa.int64()),
            "score": pa.array(np.concatenate([s for s, _ in best]), pa.int64())})

    return table.mapInArrow(search, "query_id long, id long, score long")


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 1024) -> DataFrame:
    """``query_id, rank, id, score``: the k highest integer inner products of every query
    (rows for which ``is_query``, a condition on ``id``, holds) against all rows of another id,
    ties to the smaller id.

    NULL ids and vectors, and vectors with NULL or non-finite components, take no part; an
    empty vector scores 0; scores must fit a long.  Rows that repeat an id are candidates each; a repeated query id is
    asked once, with its smallest vector.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows, id_col, vec_col, scale)
    schema = "query_id long, rank int, id long, score long"
    dim = vectors.agg(F.max(F.size("vec"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], schema)
    dim = max(1, dim)
    pick = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).toArrow()
    pivots = choose_pivots(_matrix(pick.column(1).combine_chunks(), dim), N_PIVOTS)
    path = shared_dir(spark, "pivot-table")
    pivot_table(vectors, pivots, dim).write.parquet(path)
    stored = spark.read.parquet(path)

    asked = stored.where(is_query).select("id", "vec", "dist").groupBy("id").agg(F.min(F.struct("vec", "dist")).alias("v"))
    asked = asked.select("id", "v.vec", "v.dist")
    n = asked.count()
    blocks = -(-n // QUERY_BLOCK)
    path = shared_dir(spark, "top-k")
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else asked
        t = part.toArrow()
        if t.num_rows:
            shared = spark.sparkContext.broadcast((
                t.column(0).to_numpy(), _matrix(t.column(1).combine_chunks(), dim),
                _matrix(t.column(2).combine_chunks(), len(pivots))))  # one block of queries
            _best(_search(stored, shared, k, dim), k).write.parquet(f"{path}/block={b}")
            shared.destroy()
    if not n:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).select("query_id", "rank", "id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))
