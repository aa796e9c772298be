"""Language identification by interpolated Kneser-Ney character models.

Each language has an order-``ORDER`` model over the letters of its words: a word is
padded with ``ORDER - 1`` start marks and one end mark, everything else in a text is ignored
and letters are lower-cased.  Counts cover all training documents: tasks count n-grams of
the highest order and Spark adds them up; lower orders follow from the distinct n-grams above
them (continuation counts).  The model is kept as sorted hash arrays, one row per
n-gram met in any language with the finished log-probability in every language, and one row per
context with its back-off weight.  A text's language is the one with the lowest cross-entropy per
letter; the words of many texts are scored together, each distinct word once.

Every n-gram of every language is kept.  Up to ``MAX_CELLS`` highest-order n-grams x languages the tables
are made on the driver and broadcast.  Larger models never leave Spark: ``score_rows`` derives the
same probabilities by groupBys, as rows ``key, lang, value`` whose sum over an event's n-grams and
contexts is its log-probability; distinct words are joined with them, then the texts with the words.

Every language of a training row with a letter is learned.

*Calibration.*  One training document in 16 is set aside and a first model made without it.  Over
all of those the share of right answers is taken per bin of the log-likelihood margin between the best two
languages, made monotone; that share is the score.  For each language the cross-entropy that
all but 0.1 % of its documents set aside stay below is the limit for rejection.  Then their counts are
added, and the model that is returned is made from all training documents.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineup.llm.common import slices
from lineup.llm.words import mix, range_hash
from lineup.session import shared_dir

ORDER = 5
#: Highest-order n-grams x languages of a model that is broadcast; larger ones are joined.
MAX_CELLS = 4_000_000
#: Distinct n-grams that a task adds up before it hands them on.
FLUSH = 400_000
START, END = "\x02", "\x03"
UNDETERMINED = "und"
#: Upper ends of the margin bins, in nats.
MARGINS = [0.5, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]

_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLES: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and its lower case (where that is one letter)."""
    if not _TABLES:
        alpha, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                alpha[c] = True
                low = s.lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        _TABLES.extend((alpha, lower))
    return _TABLES[0], _TABLES[1]


class LetterWords:
    """Distinct letter words of some texts: ``padded`` symbols, and for each text its words."""

    def __init__(self, texts: list[str | None], group: list[int] | None = None):
        alpha, lower = _letters()
        parts = [t or "" for t in texts]
        code = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(code):
            code = np.array([10], np.uint32)
        is_letter = alpha[code]
        code = lower[code]
        change = np.flatnonzero(is_letter[1:] != is_letter[:-1]) + 1
        if is_letter[0]:
            change = np.concatenate([[0], change])
        if len(change) % 2:
            change = np.concatenate([change, [len(code)]])
        start, end = change[0::2], change[1::2]
        begin = np.cumsum([0] + [len(p) + 1 for p in parts])
        first = np.searchsorted(start, begin)
        self.count = np.diff(first)
        n = end - start
        h = mix(range_hash(code, start, end))
        owner = np.repeat(np.arange(len(texts)), self.count)
        if group is not None:
            h = mix(h + np.asarray(group, np.uint64)[owner])
        _, at, self.inverse = np.unique(h, return_index=True, return_inverse=True)
        self.first = first
        self.owner = owner[at]
        # all distinct words with their marks, one after another
        n = n[at]
        wide = n + ORDER
        ends = np.cumsum(wide)
        self.padded = np.full(int(ends[-1]) if len(ends) else 0, ord(START), np.uint32)
        into = np.arange(n.sum()) + np.repeat(ends - 1 - n - (np.cumsum(n) - n), n)
        take = np.arange(n.sum()) + np.repeat(start[at] - (np.cumsum(n) - n), n)
        self.padded[into] = code[take]
        if len(ends):
            self.padded[ends - 1] = ord(END)
        # events: every position but the start marks
        self.events = np.concatenate([into, ends - 1]) if len(ends) else np.zeros(0, np.int64)
        self.events.sort()
        self.event_word = np.repeat(np.arange(len(n)), n + 1)
        self.n_events = n + 1


def gram_hash(symbols: np.ndarray, events: np.ndarray, order: int, skip: int = 0) -> np.ndarray:
    """Hash of the ``order`` symbols that end ``skip`` symbols before and at each event."""
    h = np.zeros(len(events), np.uint64)
    for j in range(order - 1 + skip, skip - 1, -1):
        h = h * _BASE + symbols[events - j].astype(np.uint64) + np.uint64(1)
    return mix(h + np.uint64(order))


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over ``docs(text, lang)``: how often each ORDER symbols occur."""
    def count(batches: Iterable[pa.RecordBatch]):
        found: dict[tuple[str, str], int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "lang": pa.array([k[0] for k in found], pa.string()),
                "gram": pa.array([k[1] for k in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        for batch, texts in slices(batches, max_chars=3_000_000):
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            group = [names.index(x) for x in langs]
            words = LetterWords(texts, group)
            if not len(words.events):
                continue
            weight = np.bincount(words.inverse, minlength=len(words.n_events))[words.event_word]
            lang = np.asarray(group)[words.owner][words.event_word]
            h = gram_hash(words.padded, words.events, ORDER)
            _, at, back = np.unique(mix(h + lang.astype(np.uint64)), return_index=True, return_inverse=True)
            n = np.bincount(back, weights=weight).astype(np.int64)
            symbols = words.padded[words.events[at][:, None] + np.arange(1 - ORDER, 1)]
            text = symbols.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            for i, (k, c) in enumerate(zip(lang[at].tolist(), n.tolist())):
                key = (names[k], text[i * ORDER:(i + 1) * ORDER])
                found[key] = found.get(key, 0) + c
            if len(found) > FLUSH:
                yield rows()
                found.clear()
        yield rows()

    parts = docs.mapInArrow(count, "lang string, gram string, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # per order: hashes, log p [n, L]
    backoff: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # per order: hashes, log weight
    unseen: np.ndarray | None = None
    limits: np.ndarray | None = None
    right: list[float] = field(default_factory=lambda: [0.5] * (len(MARGINS) + 1))
    path: str | None = None  # of the written score rows, where the model is too large to be broadcast

    def event_scores(self, symbols: np.ndarray, events: np.ndarray) -> np.ndarray:
        """Log-probabilities [events, languages]: the longest n-gram met, with back-off weights."""
        out = np.zeros((len(events), len(self.languages)), np.float32)
        rest = np.arange(len(events))
        for order in range(ORDER, 0, -1):
            if not len(rest):
                break
            known, value = self.grams[order - 1]
            h = gram_hash(symbols, events[rest], order)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            out[rest[hit]] += value[at[hit]]
            rest = rest[~hit]
            if len(rest) and order > 1:
                known, value = self.backoff[order - 1]
                h = gram_hash(symbols, events[rest], order - 1, skip=1)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                out[rest[hit]] += value[at[hit]]
        out[rest] += self.unseen
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per event [texts, languages], events per text)."""
        words = LetterWords(texts)
        n_lang = len(self.languages)
        if not len(words.events):
            return np.zeros((len(texts), n_lang)), np.zeros(len(texts), np.int64)
        scores = self.event_scores(words.padded, words.events)
        first = np.cumsum(words.n_events) - words.n_events
        per_word = np.add.reduceat(scores, first, axis=0).astype(np.float64)
        total = np.vstack([np.zeros((1, n_lang)), np.cumsum(per_word[words.inverse], axis=0)])
        events = np.concatenate([[0], np.cumsum(words.n_events[words.inverse])])
        n = events[words.first[1:]] - events[words.first[:-1]]
        return -(total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(n, 1)[:, None], n


def _levels(langs: np.ndarray, grams: list[str], counts: np.ndarray, languages: list[str]) -> Model:
    """Interpolated Kneser-Ney from the highest-order counts, all languages side by side."""
    n_lang = len(languages)
    symbols = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
    tables = []  # per order: (symbols of distinct grams, counts [n, L])
    rows, lang, c = symbols, langs, counts.astype(np.float64)
    for order in range(ORDER, 0, -1):
        key, at, back = np.unique(gram_hash(rows.reshape(-1), np.arange(len(rows)) * order + order - 1, order),
                                  return_index=True, return_inverse=True)
        table = np.zeros((len(key), n_lang))
        np.add.at(table, (back, lang), c)
        tables.append((rows[at], table))
        # the distinct grams of a language each count once for their last order-1 symbols
        g, lang = np.nonzero(table)
        rows, c = tables[-1][0][g][:, 1:], np.ones(len(g))
    tables.reverse()
    alphabet = len(tables[0][0]) + 1
    model = Model(languages)
    lower = None
    for order in range(1, ORDER + 1):
        rows, table = tables[order - 1]
        n1, n2 = (table == 1).sum(0), (table == 2).sum(0)
        d = np.where(n1 + n2 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5)
        d = np.clip(d, 0.1, 0.95)
        ends = np.arange(len(rows)) * order + order - 1
        context = gram_hash(rows.reshape(-1), ends, order - 1, skip=1) if order > 1 else np.zeros(len(rows), np.uint64)
        known, back = np.unique(context, return_inverse=True)
        total = np.zeros((len(known), n_lang))
        types = np.zeros((len(known), n_lang))
        np.add.at(total, back, table)
        np.add.at(types, back, table > 0)
        weight = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
        own = np.maximum(table - d, 0) / np.maximum(total[back], 1)
        if order == 1:
            below = np.full((len(rows), n_lang), 1 / alphabet)
            model.unseen = np.log(weight[0] / alphabet).astype(np.float32)
        else:
            h = gram_hash(rows.reshape(-1), ends, order - 1)
            keys, values = lower
            below = np.exp(values[np.searchsorted(keys, h)].astype(np.float64))
        p = own + weight[back] * below
        h = gram_hash(rows.reshape(-1), ends, order)
        sort = np.argsort(h)
        lower = (h[sort], np.log(p[sort]).astype(np.float32))
        model.grams.append(lower)
        model.backoff.append((known, np.log(weight).astype(np.float32)))
    return model


def score_rows(counted: DataFrame) -> DataFrame:
    """``key, lang, value`` from ``counted(lang, gram, n)``: the model of ``_levels``, one language a row.

    An event's log-probability in a language is the sum of the values of the empty key (the unseen
    symbol), of its n-grams of every order (``g`` and the symbols) and of their contexts (``c`` and
    the symbols), as far as the language has them: a context gives its back-off weight, an
    n-gram what it is likelier than by backing off.
    """
    tables = {ORDER: counted.select("lang", "gram", F.col("n").cast("double").alias("c"))}
    for order in range(ORDER, 1, -1):
        tables[order - 1] = _save(tables[order].groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(
            F.count("*").cast("double").alias("c")), "continuations")
    alphabet = tables[1].select("gram").distinct().count() + 1
    out, below = [], None
    for order in range(1, ORDER + 1):
        n1, n2 = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        discount = F.when(n1 + n2 > 0, n1 / (n1 + 2 * n2)).otherwise(0.5)
        discounts = tables[order].groupBy("lang").agg(
            F.greatest(F.lit(0.1), F.least(F.lit(0.95), discount)).alias("d"))  # one row a language
        rows = tables[order].withColumn("context", F.substring("gram", 1, order - 1))
        contexts = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        contexts = contexts.join(F.broadcast(discounts), "lang").select(
            "lang", "context", "total", "d", (F.col("d") * F.col("types") / F.col("total")).alias("weight"))
        contexts = _save(contexts, "contexts")
        rows = rows.join(contexts, ["lang", "context"])
        if order == 1:
            rows = rows.withColumn("low", F.lit(1 / alphabet))
            backoff = contexts.select(F.lit("").alias("key"), "lang", F.log(F.col("weight") / alphabet).alias("value"))
        else:
            lower = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
            rows = rows.withColumn("suffix", F.substring("gram", 2, order)).join(lower, ["lang", "suffix"])
            backoff = contexts.select(F.concat(F.lit("c"), "context").alias("key"), "lang", F.log("weight").alias("value"))
        own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        backed = F.col("weight") * F.col("low")
        below = _save(rows.select("lang", "gram", (own + backed).alias("p"), F.log((own + backed) / backed).alias("value")),
                      "levels")
        out += [backoff, below.select(F.concat(F.lit("g"), "gram").alias("key"), "lang", "value")]
    return reduce(DataFrame.unionAll, out)


def _save(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _spell(docs: DataFrame) -> DataFrame:
    """``docs`` (its ``text`` left out) with ``n_events`` and its distinct ``words`` with their numbers."""
    at = docs.columns.index("text")
    keep = [f for f in docs.schema.fields if f.name != "text"]
    word = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    schema = T.StructType(keep + [T.StructField("n_events", T.LongType()), T.StructField("words", T.ArrayType(word))])
    arrow = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))

    def spell(batches: Iterable[pa.RecordBatch]):
        for rows, texts in slices(batches, max_chars=3_000_000):
            words = LetterWords(texts)
            ends = np.cumsum(words.n_events + ORDER - 1)
            begin = ends - words.n_events
            found, events = [], []
            for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                own, n = np.unique(words.inverse[lo:hi], return_counts=True)
                events.append(int((words.n_events[own] * n).sum()))
                found.append([{"word": words.padded[begin[i]:ends[i] - 1].astype("<u4").tobytes().decode("utf-32-le"),
                               "n": c} for i, c in zip(own.tolist(), n.tolist())])
            cols = [c for i, c in enumerate(rows.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(events, pa.int64()), pa.array(found, arrow)], schema.names)

    return docs.mapInArrow(spell, schema)


def _word_keys(batches: Iterable[pa.RecordBatch]):
    """Rows ``w, key, n`` of words ``w, word``: the keys of ``score_rows`` that a word's events look up."""
    def rows(out: list[tuple]) -> pa.RecordBatch:
        w, key, n = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(key, pa.string()), pa.array(n, pa.int64())],
                                          ["w", "key", "n"])

    out: list[tuple] = []
    for batch in batches:
        for w, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            padded = START * (ORDER - 1) + word + END
            found: dict[str, int] = {}
            for end in range(ORDER, len(padded) + 1):
                for m in range(1, ORDER + 1):
                    keys = ("g" + padded[end - m:end], "c" + padded[end - m:end - 1]) if m > 1 else ("g" + padded[end - 1], "")
                    for key in keys:
                        found[key] = found.get(key, 0) + 1
            out += [(w, key, n) for key, n in found.items()]
            if len(out) > 50_000:
                yield rows(out)
                out = []
    if out:
        yield rows(out)


def _predict_joined(docs: DataFrame, model: Model) -> DataFrame:
    """``_predict`` with a model of any size: words are joined with its rows, texts with the words.
    The texts' words are written once, with the row number that the last join is on."""
    keep = [c for c in docs.columns if c != "text"]
    spelled = _save(_spell(docs).withColumn("_row", F.monotonically_increasing_id()), "spelled")
    pairs = spelled.select("_row", F.inline("words")).withColumn("w", F.xxhash64("word"))
    keys = pairs.select("w", "word").dropDuplicates(["w"]).mapInArrow(_word_keys, "w long, key string, n long")
    scores = keys.join(docs.sparkSession.read.parquet(model.path), "key").groupBy("w", "lang").agg(
        F.sum(F.col("n") * F.col("value")).alias("value"))
    total = pairs.select("_row", "w", "n").join(_save(scores, "words"), "w").groupBy("_row", "lang").agg(
        F.sum(F.col("n") * F.col("value")).alias("total"))
    # every language has the context of a word's first letter, and so a row for each text with a word
    best = total.groupBy("_row").agg(F.slice(F.array_sort(F.collect_list(F.struct(
        (-F.col("total")).alias("loss"), "lang"))), 1, 2).alias("best"))
    out = spelled.drop("words").join(best, "_row", "left")
    low, second = F.get("best", F.lit(0))["loss"], F.get("best", F.lit(1))["loss"]
    n = F.greatest("n_events", F.lit(1))
    margin = F.coalesce(second - low, F.log(F.lit(2.0)) * n)
    # rounded, as Spark adds in any order
    return out.select(*keep, F.get("best", F.lit(0))["lang"].alias("best"), F.round(low / n, 9).alias("entropy"),
                      F.round(margin, 6).alias("margin"), "n_events")


def _predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (its ``text`` left out) with ``best, entropy, margin, n_events``."""
    if model.path is not None:
        return _predict_joined(docs, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_CELLS
    keep = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType(keep + [T.StructField("best", T.StringType()), T.StructField("entropy", T.DoubleType()),
                                  T.StructField("margin", T.DoubleType()), T.StructField("n_events", T.LongType())])

    def predict(batches: Iterable[pa.RecordBatch]):
        m = shared.value
        for rows, texts in slices(batches, max_chars=3_000_000):
            h, n = m.entropies(texts)
            order = np.argsort(h, axis=1, kind="stable")
            at = np.arange(len(texts))
            low = h[at, order[:, 0]]
            second = h[at, order[:, 1]] if h.shape[1] > 1 else low + np.log(2)
            cols = {f.name: rows.column(rows.schema.get_field_index(f.name)) for f in keep}
            yield pa.RecordBatch.from_pydict({
                **cols, "best": pa.array([m.languages[i] for i in order[:, 0]], pa.string()),
                "entropy": pa.array(low, pa.float64()), "margin": pa.array((second - low) * n, pa.float64()),
                "n_events": pa.array(n, pa.int64())})

    return docs.mapInArrow(predict, schema)


def _bin(margin) -> F.Column:
    out = F.lit(len(MARGINS))
    for i in range(len(MARGINS) - 1, -1, -1):
        out = F.when(margin < MARGINS[i], F.lit(i)).otherwise(out)
    return out


def _build(counted: DataFrame, max_cells: int) -> Model | None:
    """The model of written counts ``lang, gram, n``, every n-gram in it."""
    sizes = counted.groupBy("lang").agg(F.count("*").alias("grams")).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return None
    if sum(r["grams"] for r in sizes) * len(languages) > max_cells:
        path = shared_dir(counted.sparkSession, "model")
        score_rows(counted).write.parquet(path)
        return Model(languages, path=path)
    table = counted.select("lang", "gram", "n").toArrow()
    index = {x: i for i, x in enumerate(languages)}
    return _levels(np.array([index[x] for x in table.column("lang").to_pylist()]), table.column("gram").to_pylist(),
                   table.column("n").to_numpy(), languages)


def train(docs: DataFrame, max_cells: int = MAX_CELLS) -> Model | None:
    """A model from ``docs(doc_id, text, lang)``; rows with a NULL text or language teach nothing.
    None if nothing can be learned.  The driver holds the tables up to ``max_cells`` only."""
    docs = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    calibrating = F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0
    parts = [_save(count_grams(docs.where(c).select("text", "lang")), "grams") for c in (~calibrating, calibrating)]
    counted = _save(parts[0].unionAll(parts[1]).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    model = _build(counted, max_cells)
    if model is None:
        return None
    languages = model.languages
    first = _build(parts[0], max_cells)
    index = {x: i for i, x in enumerate(languages)}
    good, n, limits = np.ones(len(MARGINS) + 1), np.full(len(MARGINS) + 1, 2.0), np.full(len(languages), np.inf)
    for r in _calibrate(docs.where(calibrating), first).collect() if first is not None else []:
        good[r["bin"]] += r["good"]
        n[r["bin"]] += r["n"]
        i = index[r["lang"]]
        limits[i] = max(r["limit"], limits[i] if np.isfinite(limits[i]) else 0.0)
    model.right = np.maximum.accumulate(good / n).tolist()
    model.limits = limits
    return model


def _calibrate(docs: DataFrame, model: Model) -> DataFrame:
    """``lang, bin, n, good, limit``: what the model says of documents that it has not counted."""
    aside = _predict(_learned(docs, model).select("text", "lang"), model)
    aside = aside.where("n_events > 0").withColumn("bin", _bin(F.col("margin")))
    right = F.col("best") == F.col("lang")
    return aside.groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum(right.cast("int")).alias("good"),
                                            F.percentile_approx("entropy", 0.999, 10000).alias("limit"))


def _learned(docs: DataFrame, model: Model) -> DataFrame:
    """The rows in a language of the model."""
    known = docs.sparkSession.createDataFrame([(x,) for x in model.languages], "_lang string")
    return docs.join(F.broadcast(known), F.col("lang") == F.col("_lang"), "left_semi")


def identify(docs: DataFrame, model: Model | None, reject: bool = True) -> DataFrame:
    """``docs`` (its ``text`` left out) with ``lang_pred, score`` and ``rejected``.

    A NULL text, or one without a letter, is ``und`` with score 0, as is everything
    without a model.  ``rejected`` marks texts less like their best language than nearly all
    known ones, or more likely wrong than right; with ``reject`` these are ``und`` too.
    Repeated rows each give a row; other columns pass through (but for those of the result's names).
    """
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "rejected")]
    if model is None:
        return docs.select(*rest, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(True).alias("rejected"))
    boxed = docs.select(F.struct(*rest, F.lit(1).alias("_")).alias("_rest"), F.col("text").cast("string").alias("text"))
    found = _predict(boxed, model)
    right = F.element_at(F.array(*[F.lit(float(x)) for x in model.right]), _bin(F.col("margin")) + 1)
    limits = docs.sparkSession.createDataFrame(
        [(x, float(model.limits[i])) for i, x in enumerate(model.languages)], "_best string, _limit double")
    found = found.join(F.broadcast(limits), F.col("best") == F.col("_best"), "left")  # one row a language
    some = F.col("n_events") > 0
    rejected = ~some | (F.col("entropy") > F.col("_limit")) | (right < 0.5)
    pred = F.when(some & (~rejected if reject else F.lit(True)), F.col("best")).otherwise(F.lit(UNDETERMINED))
    return found.select(*[F.col("_rest").getField(c).alias(c) for c in rest], pred.alias("lang_pred"),
                        F.when(some, right).otherwise(F.lit(0.0)).alias("score"),
                        F.coalesce(rejected, F.lit(True)).alias("rejected"))
