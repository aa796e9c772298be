"""Quality classifier: ordinal cumulative-link regression on graded ratings.

    P(grade <= j | text) = sigmoid(threshold[j] - w . x(text)),   threshold ascending

One weight vector is shared by all grades.  ``x`` marks which hashed features a
whole text has: its words (runs of letters and digits, A-Z lower-cased), their beginnings,
the endings of tokens that end in a symbol and, in steps, its
share of symbols, of words equal to the word before, of distinct words, of lines with
a bar, and its mean word length.

The fit uses at most ``MAX_FIT_ROWS`` rated documents and ``MAX_FIT_FEATURES`` features of
those (rows in order of a hash of doc_id, so the choice does not depend on the
partitioning); this bounds the driver's memory.  Every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineup.llm.common import byte_slices
from lineup.llm.words import ALNUM_LOWER, SPACED, Words, mix

HASH_BITS = 18
MAX_FIT_ROWS = 12_000
MAX_FIT_FEATURES = 12_000_000
STEPS = 16
SHAPE_VALUE = 4.0
#: Bytes of text whose features are made at once: the arrays take some 35 times that.
SLICE = 1_000_000
#: Besides whole words, word beginnings of so many bytes are features (inflected forms share them).
PREFIXES = (4, 6)

GRADES = ["harmful", "poor", "good"]


_PLAIN = np.array([chr(b).isalnum() or b > 127 for b in range(256)])


def _shape(data: bytes, words: Words) -> np.ndarray:
    """Shape features [texts, 5] as steps from 0 to STEPS."""
    n = np.maximum(words.count, 1)
    buf = np.frombuffer(data, np.uint8)
    begin = np.concatenate([[0], np.flatnonzero(buf == 0)[:len(words.count) - 1] + 1]) if len(buf) else np.zeros(1, int)
    symbol = np.zeros(256, np.int64)
    symbol[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = 1
    symbols = np.add.reduceat(symbol[buf], begin) if len(buf) else np.zeros(len(n))
    owner = np.repeat(np.arange(len(n)), words.count)
    same = np.zeros(len(words), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[same], minlength=len(n))
    length = np.bincount(owner, weights=words.end - words.start, minlength=len(n))
    pairs = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (words.hash >> np.uint64(32)))
    distinct = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(n))
    shares = np.stack([symbols / n, repeats / n, distinct / n, length / n / 12, np.log2(n) / 16], axis=1)
    return np.clip(np.floor(shares * STEPS), 0, STEPS).astype(np.int64)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, first feature of each text, words of each text): distinct features per text."""
    parts = [(t or b"").replace(b"\0", b" ") for t in texts]
    words = Words(parts, ALNUM_LOWER)
    owner = np.repeat(np.arange(len(texts)), words.count).astype(np.uint64)
    size = words.end - words.start
    hashes, owners = [words.hash], [owner]
    for n in PREFIXES:
        hashes.append(mix(words.prefixes(n)[size > n] + np.uint64(n)))
        owners.append(owner[size > n])
    # endings of space-separated tokens that end in neither letter nor digit
    tokens = Words(parts, SPACED)
    token_owner = np.repeat(np.arange(len(texts)), tokens.count).astype(np.uint64)
    odd = ~_PLAIN[np.frombuffer(tokens.data, np.uint8)[tokens.end - 1]]
    hashes.append(mix(tokens.suffixes(3)[odd] + np.uint64(99)))
    owners.append(token_owner[odd])
    owner = np.concatenate(owners)
    buckets = np.concatenate(hashes) >> np.uint64(64 - HASH_BITS)
    shape = _shape(b"\0".join(parts), words)
    extra = (np.arange(shape.shape[1])[None] * (STEPS + 1) + shape).astype(np.uint64)
    own = np.repeat(np.arange(len(texts), dtype=np.uint64), shape.shape[1])
    every = np.concatenate([(owner << np.uint64(32)) | buckets,
                            (own << np.uint64(32)) | (extra.ravel() + np.uint64(1 << HASH_BITS))])
    every = np.unique(every)
    first = np.searchsorted(every >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))
    return (every & np.uint64(0xFFFFFFFF)).astype(np.int64), first, words.count


N_FEATURES = (1 << HASH_BITS) + 5 * (STEPS + 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. grades - 1."""
        return _sigmoid(score[:, None] - self.thresholds[None])

    def score(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[index])])
        return total[first[1:]] - total[first[:-1]]


def fit_ordinal(index: np.ndarray, first: np.ndarray, grade: np.ndarray, n_grades: int, rounds: int = 200,
                ridge: float = 2e-4, rate: float = 0.05) -> OrdinalModel:
    """Full-batch Adam on the mean negative log-likelihood with a ridge on the weights.

    Thresholds stay ordered: the first is free, the gaps are exponentials.
    """
    n = len(grade)
    used, inner = np.unique(index, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(first))
    share = np.bincount(grade, minlength=n_grades) / n
    below = np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    x = np.concatenate([np.zeros(len(used)), start[:1], gaps])
    m, v = np.zeros_like(x), np.zeros_like(x)
    k = len(used)
    # few shape features stand against many words: each counts more
    value = np.where(used >= 1 << HASH_BITS, SHAPE_VALUE, 1.0)
    for t in range(1, rounds + 1):
        w = x[:k]
        theta = np.concatenate([x[k:k + 1], x[k] + np.cumsum(np.exp(x[k + 1:]))])
        score = np.bincount(row, weights=(w * value)[inner], minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        up = _sigmoid(np.where(np.isinf(edges[grade + 1]), 40, edges[grade + 1] - score))
        down = np.where(grade == 0, 0, _sigmoid(np.where(np.isinf(edges[grade]), -40, edges[grade] - score)))
        up = np.where(grade == n_grades - 1, 1.0, up)
        p = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up), down * (1 - down)
        g_score = (du - dd) / p / n
        g_theta = np.zeros(len(theta))
        np.add.at(g_theta, np.minimum(grade, len(theta) - 1), np.where(grade < len(theta), -du / p / n, 0))
        np.add.at(g_theta, np.maximum(grade - 1, 0), np.where(grade > 0, dd / p / n, 0))
        g = np.empty_like(x)
        g[:k] = np.bincount(inner, weights=g_score[row], minlength=k) * value + ridge * w
        g[k] = g_theta.sum()
        for j in range(1, len(theta)):
            g[k + j] = g_theta[j:].sum() * np.exp(x[k + j])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    weights = np.zeros(N_FEATURES)
    weights[used] = x[:k] * value
    return OrdinalModel(weights, np.concatenate([x[k:k + 1], x[k] + np.cumsum(np.exp(x[k + 1:]))]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 harmful, 1 poor, 2 good; NULL without both ratings."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic > 0, 0).when(quality <= 0, 1).otherwise(2)


def fit(docs: DataFrame, ratings: DataFrame, max_rows: int = MAX_FIT_ROWS,
        max_features: int = MAX_FIT_FEATURES) -> OrdinalModel | None:
    """Fit on ``docs(doc_id, text)`` rated by ``ratings(doc_id, grade)``.

    Of several ratings of a document the lowest counts; rows with a NULL doc_id, text or
    grade are not used.  None if fewer than two grades are left.
    """
    rated = (ratings.where("doc_id is not null and grade is not null").groupBy("doc_id")
             .agg(F.min("grade").cast("int").alias("grade")))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounds the broadcast
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def describe(batches: Iterable[pa.RecordBatch]):
        for b, texts in byte_slices(batches, "text", SLICE):
            index, first, _ = features(texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "grade": b.column(2),
                "index": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(index, pa.int32()))})

    described = rows.select("doc_id", "text", "grade").mapInArrow(describe, "doc_id long, grade int, index array<int>")
    described = described.withColumn("_n", F.size("index"))
    index, grade, total = [], [], 0
    for r in described.orderBy(F.xxhash64("doc_id"), "doc_id", "_n").toLocalIterator():
        total += len(r["index"])
        if total > max_features:
            break
        index.append(np.asarray(r["index"], np.int64))
        grade.append(r["grade"])
    if len(set(grade)) < 2:
        return None
    names, at = np.unique(grade, return_inverse=True)
    n_grades = max(len(GRADES), int(names.max()) + 1)
    first = np.concatenate([[0], np.cumsum([len(i) for i in index])])
    return fit_ordinal(np.concatenate(index), first, np.asarray(grade), n_grades)


def classify(docs: DataFrame, model: OrdinalModel | None, least: float = 0.5) -> DataFrame:
    """``docs`` (all columns) with ``expected_grade``, ``p_good`` (probability of the
    highest grade) and ``kept`` (``p_good >= least``).

    A NULL text or one without a word has grade 0 and is not kept.  Without a model every
    text with a word is kept with NULL grades.  Repeated rows each give a row.
    """
    taken = ("expected_grade", "p_good", "kept")
    docs = docs.select(*[c for c in docs.columns if c not in taken]).withColumn("text", F.col("text").cast("string"))
    fields = docs.schema.fields
    schema = T.StructType(fields + [T.StructField(taken[0], T.DoubleType()), T.StructField(taken[1], T.DoubleType()),
                                    T.StructField(taken[2], T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**HASH_BITS weights

    def rate(batches: Iterable[pa.RecordBatch]):
        m = shared.value
        for b, texts in byte_slices(batches, "text", SLICE):
            index, first, n_words = features(texts)
            some = n_words > 0
            if m is None:
                grade = good = [None] * len(texts)
                kept = some
            else:
                tails = m.tails(m.score(index, first)) * some[:, None]
                grade, good = tails.sum(1), tails[:, -1]
                kept = good >= least
            at = b.schema.get_field_index("text")
            b = b.set_column(at, "text", b.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(grade, pa.float64()), pa.array(good, pa.float64()), pa.array(kept, pa.bool_())],
                [*b.schema.names, *taken])

    return docs.mapInArrow(rate, schema)
