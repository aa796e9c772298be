"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers, floor(scale * c) + shift; their sums are exact.  X holds the n
rows less their mean.  Starting from a unit vector v, alternating products

    a_k u_k = X v_k - b_(k-1) u_(k-1),      b_k v_(k+1) = X' u_k - a_k v_k

turn X into U B V' with B upper bidiagonal.  The singular values of the small B are those of
X (deviations times sqrt(n)), its right singular vectors, turned by V, are the components.

* One step is one pass over the rows.  No u (one entry a row) is ever stored: each is X y for a
  vector y of the row's width, so a task that is repeated elsewhere needs the rows and the
  small matrices only.  A pass returns |Xy|^2, X'Xy and the products of Xy with all former u.
* Both sides are fully reorthogonalised: the u by the products just named, the v on the driver.
* A step that finds nothing new (b = 0) starts again from a fresh direction, so equal
  deviations are all found.  With at most ``FULL_STEPS`` dimensions all of them are taken; beyond
  that the steps end when all wanted components have converged and a fresh direction, followed for
  ``RECHECK`` steps, changes none of them.

The driver holds matrices of (dimensions x steps); rows stay in tasks.  Rows are kept as small
integers in a written table, one byte an entry where that is enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineup.session import shared_dir

SHIFT = 1_000_000
FULL_STEPS = 192
RECHECK = 8
#: Components whose deviation is less than this part of the largest are rounding, not data.
RANK_TOLERANCE = 1e-10
_LIMIT = float(1 << 62)
_HALF = 31


def integer_rows(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, size, data``: floor(scale * c) of each entry as little-endian integers of ``size``
    bytes.  Rows whose vector is NULL or holds NULL or non-finite entries are left out; integers beyond
    2**62 are taken as that."""
    def convert(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column(1).combine_chunks() if isinstance(batch.column(1), pa.ChunkedArray) else batch.column(1)
            flat = lists.flatten()
            values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            end = np.cumsum(length)
            broken = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            keep = lists.is_valid().to_numpy(zero_copy_only=False) & (broken[end] == broken[end - length])
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.nan_to_num(np.floor(values * scale), posinf=_LIMIT, neginf=-_LIMIT),
                                -_LIMIT, _LIMIT).astype(np.int64)
            sizes, data = [], []
            for i in np.flatnonzero(keep).tolist():
                x = whole[end[i] - length[i]:end[i]]
                most = max(int(x.max()), -int(x.min()) - 1) if len(x) else 0
                size = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                sizes.append(size)
                data.append(x.astype(f"<i{size}").tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).filter(pa.array(keep)), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())],
                ["id", "size", "data"])

    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>")
                       .alias("vec")).mapInArrow(convert, "id long, size int, data binary")


def matrix(size: pa.Array, data: pa.Array, dim: int) -> np.ndarray:
    """The integers of a batch as int64, shorter rows filled up with zeros."""
    data = data.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    sizes, lengths = size.to_numpy(), np.diff(offsets)
    out = np.zeros((len(data), dim), np.int64)
    for s, n in set(zip(sizes.tolist(), lengths.tolist())):
        if n:
            rows = np.flatnonzero((sizes == s) & (lengths == n))
            part = raw[offsets[rows][:, None] + np.arange(n)] if len(rows) < len(data) else \
                raw[offsets[0]:offsets[-1]].reshape(-1, n)
            out[rows, :n // s] = np.ascontiguousarray(part).view(f"<i{s}")
    return out


@dataclass
class Centre:
    """Number of rows and exact sums per dimension (without the shift)."""
    n: int
    sums: list[int]

    def scaled(self, x: np.ndarray) -> np.ndarray | None:
        """n * x - sum as int64, or None where that may not fit."""
        most = max(map(abs, self.sums), default=0) + self.n * (int(np.abs(x).max()) if x.size else 0)
        return x * self.n - np.array(self.sums, np.int64) if most < 1 << 62 else None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, rounded once wherever n * x fits 62 bits."""
        exact = self.scaled(x)
        if exact is not None:
            return exact / self.n
        return x - np.array([float(Fraction(s, self.n)) for s in self.sums])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - sum)^2 per row, exact; None where it exceeds a long."""
        exact = self.scaled(x)
        if exact is not None and float(np.abs(exact).max(initial=0)) ** 2 * x.shape[1] < _LIMIT:
            return (exact * exact).sum(1).tolist()
        whole = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in whole]


def _totals(table: DataFrame, width: int, dim: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``of(integer rows)`` (``width`` doubles) over all batches: added up per task, then by
    place; ``width`` rows come back."""
    def partial(batches: Iterable[pa.RecordBatch]):
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += of(matrix(b.column(0), b.column(1), dim))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["i", "v"])

    rows = table.select("size", "data").mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(width)
    for r in rows.collect():
        out[r["i"]] = r["v"]
    return out


def centre_of(table: DataFrame, dim: int, n: int) -> Centre:
    """Exact sums: high and low halves are added apart."""
    def partial(batches: Iterable[pa.RecordBatch]):
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            x = matrix(b.column(0), b.column(1), dim)
            high += (x >> _HALF).sum(0)
            low += (x & ((1 << _HALF) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(high), pa.array(low)], ["i", "high", "low"])

    parts = table.select("size", "data").mapInArrow(partial, "i long, high long, low long")
    got = parts.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]).collect()
    sums = {r["i"]: (int(r["high"]) << _HALF) + int(r["low"]) for r in got}
    return Centre(n, [sums[i] for i in range(dim)])


def bidiagonalise(product: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]], dim: int,
                  wanted: int, scale: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors in columns) of X, largest first.

    ``product(y, Y)`` returns |Xy|^2, (XY)'Xy and X'Xy; ``scale`` is the Frobenius norm of X."""
    rng = np.random.default_rng(seed)
    tiny = 1e-14 * scale
    V, Y, Z = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    alpha, beta = [], []

    def orthogonal(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - V @ (V.T @ w)
        return w

    def fresh() -> np.ndarray:
        w = orthogonal(rng.standard_normal(dim))
        w = orthogonal(w / np.linalg.norm(w))
        return w / np.linalg.norm(w)

    def small_svd():
        B = np.diag(alpha) + np.diag(beta[:len(alpha) - 1], 1)
        return np.linalg.svd(B)

    v, settled, again = fresh(), None, 0
    while True:
        y = v - (beta[-1] * Y[:, -1] if beta else 0)
        square, along, z = product(y, Y)
        y, z = y - Y @ along, z - Z @ along
        a = float(np.sqrt(max(square - along @ along, 0.0)))
        y, z, a = (y / a, z / a, a) if a > tiny else (y * 0, z * 0, 0.0)
        V, Y, Z = np.column_stack([V, v]), np.column_stack([Y, y]), np.column_stack([Z, z])
        alpha.append(a)
        k = len(alpha)
        if k == dim:
            break
        w = orthogonal(z - a * v)
        b = float(np.linalg.norm(w))
        new = b <= tiny
        if k >= FULL_STEPS:
            P, s, _ = small_svd()
            top = s[:wanted]
            if settled is None and (np.abs(b * P[-1, :wanted]) <= 1e-13 * s[0]).all():
                settled, again, new = top, RECHECK, True
            elif settled is not None:
                again -= 1
                if (np.abs(top - settled) > 1e-10 * s[0]).any():
                    settled = None
                elif again == 0:
                    break
        beta.append(0.0 if new else b)
        v = fresh() if new else w / b
    _, s, Qt = small_svd()
    return s, V @ Qt.T


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32,
           scale: int = 64) -> DataFrame:
    """One row per remaining row and component: ``vec_id, component, n, deviation, whitened,
    explained, identity_error``.

    Defined cases.  A row whose vector is NULL or holds a NULL or non-finite entry is left out; a NULL
    identifier stays and is returned; repeated rows count and are returned as often as they occur; a shorter
    vector is filled up with entries c = 0; other columns are not read.  A component without deviation
    (below ``RANK_TOLERANCE`` of the largest) cannot be scaled and is left out, so equal rows, one row or
    an empty table give an empty result.  A ``deviation`` beyond a long is NULL.  Equal deviations
    leave the choice of their components open; any orthonormal one may come back.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, "integer-vectors")
    integer_rows(rows, id_col, vec_col, scale).write.parquet(path)
    table = spark.read.parquet(path)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    n, dim = table.agg(F.count(F.lit(1)), F.max(F.expr("int(length(data) / size)"))).first()
    if not n or not dim:
        return spark.createDataFrame([], schema)
    centre = centre_of(table, dim, n)
    squares = float(_totals(table, 1, dim, lambda x: np.array([(centre.centred(x) ** 2).sum()]))[0])
    if squares <= 0:
        return spark.createDataFrame([], schema)

    def product(y: np.ndarray, Y: np.ndarray):
        shared = spark.sparkContext.broadcast((centre, y, Y))  # dimensions x steps at most

        def of(x: np.ndarray) -> np.ndarray:
            centre, y, Y = shared.value
            X = centre.centred(x)
            u = X @ y
            return np.concatenate([[u @ u], X.T @ u, (X @ Y).T @ u])

        out = _totals(table, 1 + dim + Y.shape[1], dim, of)
        shared.unpersist()
        return out[0], out[1 + dim:], out[1:1 + dim]

    values, vectors = bidiagonalise(product, dim, components, float(np.sqrt(squares)))
    keep = np.flatnonzero(values[:components] > RANK_TOLERANCE * values[0])
    deviations = values[keep] / np.sqrt(n)
    turn = spark.sparkContext.broadcast((centre, vectors[:, keep] / deviations))
    m = len(keep)

    def scores(x: np.ndarray) -> np.ndarray:
        centre, axes = turn.value
        return centre.centred(x) @ axes

    mean = _totals(table, m, dim, lambda x: scores(x).sum(0)) / n

    def products(batches: Iterable[pa.RecordBatch]):
        total = np.zeros((m, m))
        for b in batches:
            w = scores(matrix(b.column(0), b.column(1), dim)) - mean
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * m)), pa.array(total.ravel())], ["i", "v"])

    error = float(table.select("size", "data").mapInArrow(products, "i long, v double").groupBy("i")
                  .agg(F.sum("v").alias("v"))
                  .agg(F.max(F.abs(F.col("v") / n - F.when(F.col("i") % (m + 1) == 0, 1.0).otherwise(0.0)))).first()[0])
    explained = (values[keep] ** 2 / squares).tolist()

    def emit(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                k = part.num_rows
                x = matrix(part.column(1), part.column(2), dim)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(k), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, n, np.int64)),
                    pa.array(turn.value[0].deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(k), m))),
                    pa.array(scores(x).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.select("id", "size", "data").mapInArrow(emit, schema)
