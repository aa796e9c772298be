"""b-bit MinHash near-duplicate detection with exact confirmation.

1. Every text becomes its set of word shingles (64-bit hashes).  Documents with
   the same set form one class, named by a 128-bit hash of the set, so exact copies
   cost nothing further and only classes are compared.
2. ``PERMS`` minima per set give ``BANDS`` band keys (from the full minima) and a packed
   signature of the low ``BITS`` bits of every minimum.  Classes that share a band key are
   candidates.  A pair at the threshold 0.8 shares no key with probability under 1e-7.
3. Buckets of up to ``SMALL`` classes give all their pairs.  In a larger bucket every
   class is paired with one hub, the class with the most company over all bands (for
   near copies of one text that is the text itself): linear in the bucket.
4. Pairs are estimated from the packed signatures by bit counts, corrected for chance
   collisions; those clearly below the threshold go.  The rest are confirmed on full sets.
5. Links give components.  In large buckets that still hold several components, the
   pairs across components are estimated and confirmed as well, in blocks, so that no
   link between different components is lost, and the components are taken anew.
   A bucket of more than ``WIDE`` blocks is first keyed by a second shared band, which costs
   ``BANDS`` rows a class at most instead of one for every block: a pair at 0.8 has a second band in
   common but for one in a million.  Groups that are still large are cut into blocks like others.

Very long texts are hashed in pieces of bounded size; a set is held whole by one task, two at a time.

Pairs inside one component need no confirmation: the result is the class of each
document, not the list of links.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineup.llm.common import NULL_ID, boxed, byte_slices, partitions, unboxed
from lineup.llm.words import SPACED_LOWER, Words, mix
from lineup.session import shared_dir

PERMS, BANDS, BITS = 128, 32, 8
SMALL = 12
#: Most classes and shingles in a block of a large bucket; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
#: Most blocks of a bucket before it is keyed by a second band.
WIDE = 8
#: Estimates have a deviation of 0.035 at 0.8; pairs this far below the threshold are not confirmed.
SLACK = 0.15

_MULTIPLIERS = mix(np.arange(1, PERMS + 1, dtype=np.uint64)) | np.uint64(1)
_OFFSETS = mix(np.arange(1001, PERMS + 1001, dtype=np.uint64))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the shingle hashes of all texts one after another, with
    repeats; a text of fewer than ``k`` words, but not none, is one shingle."""
    short = (words.count > 0) & (words.count < k)
    n = np.where(short, 1, np.maximum(words.count - k + 1, 0))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(first[-1], np.uint64)
    full = words.windows(k)[words.whole(k)] if len(words) else out[:0]
    long_slots = np.repeat(~short, n)
    out[long_slots] = full
    for m in range(1, k):
        at = np.flatnonzero(words.count == m)
        if len(at):
            out[first[at]] = words.windows(m)[words.first[at]]
    return out, first


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, cls, sig, bands`` and the columns after ``doc_id, text`` per row;
    ``cls`` is NULL for an empty set."""
    more = docs.schema.fields[2:]

    def sign(batches: Iterable[pa.RecordBatch]):
        import xxhash
        for rows, texts in byte_slices(batches):
            shingles, first = shingle_sets(Words(texts, SPACED_LOWER), k)
            n, cls = [], []
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
                own = np.unique(shingles[lo:hi])
                n.append(len(own))
                cls.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            filled = np.flatnonzero(np.diff(first) > 0)
            minima = np.zeros((PERMS, len(filled)), np.uint64)
            for p in range(PERMS if len(filled) else 0):
                minima[p] = np.minimum.reduceat(shingles * _MULTIPLIERS[p] + _OFFSETS[p], first[filled])
            low = (mix(minima) & np.uint64((1 << BITS) - 1)).astype(np.uint8).T
            per = PERMS // BANDS
            keys = np.zeros((len(filled), BANDS), np.uint64)
            for j in range(per):
                keys = keys * np.uint64(0x9E3779B97F4A7C15) + minima[j::per].T
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)
            sig: list = [None] * len(texts)
            bands: list = [None] * len(texts)
            for row, i in enumerate(filled.tolist()):
                sig[i], bands[i] = low[row].tobytes(), keys[row]
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column(0), "n_shingles": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.binary()),
                "sig": pa.array(sig, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())),
                **{f.name: rows.column(2 + i) for i, f in enumerate(more)}})

    schema = T.StructType.fromDDL("doc_id long, n_shingles long, cls binary, sig binary, bands array<long>")
    return docs.mapInArrow(sign, T.StructType(schema.fields + more))


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from the shares of equal low parts of the minima, less what chance makes equal."""
    same = np.count_nonzero(a == b, axis=-1) / PERMS
    chance = 1 / (1 << BITS)
    return (same - chance) / (1 - chance)


def _save(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity.  ``b`` may be a hub of very
    many pairs: that join comes last and is on the key alone, so that it can be split."""
    percent = round(similarity * 100)

    def exact(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    one = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "hb")
    return joined.mapInArrow(exact, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``cls, root`` for every class in a link; ``root`` is the smallest class reachable.

    Each round a class takes the smallest label among its neighbours, then the
    label of its label; the rounds grow with the logarithm of the longest chain.  Labels
    are written to the shared folder every round, which also cuts the lineage.
    """
    both = _save(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")), "links")
    labels = _save(both.groupBy("x").agg(F.min("y").alias("m")).select(
        F.col("x").alias("cls"), F.least("x", "m").alias("root")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("cls", "y"), "y").groupBy("x").agg(F.min("root").alias("m")))
        step = (labels.join(near.withColumnRenamed("x", "cls"), "cls")
                .select("cls", "root", F.least("root", "m").alias("new")))
        jump = labels.select(F.col("cls").alias("new"), F.col("root").alias("far"))
        step = step.join(jump, "new", "left").select(
            "cls", F.least("new", F.coalesce("far", "new")).alias("root"), F.col("root").alias("old"))
        step = _save(step, "labels")
        labels = step.select("cls", "root")
        if step.where("root <> old").isEmpty():
            return labels


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``a, b``: all of a small bucket, member and hub of a large one."""
    small = members.where(F.col("n") <= SMALL).select("key", "cls")
    pairs = small.alias("s").join(small.alias("t"), F.expr("s.key = t.key and s.cls < t.cls")).select(
        F.col("s.cls").alias("a"), F.col("t.cls").alias("b"))
    large = members.where(F.col("n") > SMALL)
    company = large.groupBy("cls").agg(F.sum("n").alias("company"))
    ranked = large.join(company, "cls")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("company", "cls"))["cls"].alias("hub"))
    star = large.join(hubs, "key").where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    return pairs.unionByName(star).distinct()


def _open(rows: DataFrame) -> DataFrame:
    """The ``rows`` of keys that hold several components, with the ``blocks`` to cut each key into."""
    blocks = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                   F.ceil(blocks).cast("int").alias("blocks")).where("lo <> hi")
    return rows.join(keys.select("key", "blocks"), "key")


def _cross_links(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame,
                 similarity: float) -> DataFrame:
    """Confirmed links ``a, b`` across components of the large buckets.

    A bucket is cut into blocks of bounded size and every pair of blocks is one group of rows; a
    wide bucket is first keyed by each second band of its classes (the two keys' exclusive or).
    In a group a pair is looked at only under the first key that its classes share, so once
    in all; pairs of one component are skipped, also when a link of this group has just joined
    them, and bit counts leave the likely pairs to be confirmed.  The result has fewer links than classes.
    """
    known = members.where(F.col("n") > SMALL).select("key", "cls", "n_shingles").join(
        labels, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    opened = _save(_open(known), "open")
    wide = opened.where(F.col("blocks") > WIDE).groupBy("cls").agg(
        F.collect_list("key").alias("wide"), F.first("root").alias("root"), F.first("n_shingles").alias("n_shingles"))
    twice = (wide.join(classes.select("cls", "bands"), "cls").withColumn("one", F.explode("wide"))
             .withColumn("two", F.explode("bands"))
             .where("one <> two and (one < two or not array_contains(wide, two))")
             .select(F.col("one").bitwiseXOR(F.col("two")).alias("key"), "cls", "n_shingles", "root"))
    rows = opened.where(F.col("blocks") <= WIDE).unionByName(_open(twice))
    blocks = F.col("blocks")
    rows = rows.withColumn("i", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key", F.least("i", "other").alias("p"), F.greatest("i", "other").alias("q"), "i", "cls", "root")
    marked = classes.select("cls", "sig", "bands").join(wide.select("cls", "wide"), "cls", "left").select(
        "cls", "sig", "bands", F.transform("bands", lambda b: F.coalesce(
            F.array_contains("wide", b), F.lit(False))).alias("wide"))
    rows = rows.join(marked, "cls").join(sets, "cls")
    percent, floor = round(similarity * 100), similarity - SLACK

    def compare(batches: Iterable[pa.RecordBatch]):
        def links(group: list[tuple], key: int) -> list[tuple[bytes, bytes]]:
            side, cls, root, sig, bands, wide, hashes = zip(*group)
            sig = np.frombuffer(b"".join(sig), np.uint8).reshape(len(group), -1)
            bands, wide, side = np.array(bands, np.int64), np.array(wide, bool), np.array(side)
            comp = np.unique(np.array(root, object), return_inverse=True)[1]
            sets_ = [np.frombuffer(h, np.uint64) for h in hashes]
            size = np.array([len(x) for x in sets_])
            mixed = side.min() != side.max()
            out = []
            for x in range(len(group) - 1):
                y = x + 1 + np.flatnonzero(comp[x + 1:] != comp[x])
                if mixed:
                    y = y[side[y] != side[x]]
                y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
                same = bands[y] == bands[x]
                first = same.argmax(1)
                same[np.arange(len(y)), first] = False
                second = np.where(wide[x][first], bands[x][same.argmax(1)], 0)
                y = y[bands[x][first] ^ second == key]
                alike = _estimate(sig[x], sig[y])
                for v in y[np.argsort(-alike, kind="stable")][:np.count_nonzero(alike >= floor)].tolist():
                    if comp[v] != comp[x]:
                        both = len(np.intersect1d(sets_[x], sets_[v], assume_unique=True))
                        if 100 * both >= percent * (size[x] + size[v] - both):
                            out.append((cls[x], cls[v]))
                            comp[comp == comp[v]] = comp[x]
            return out

        def rows_of(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        group, at, found = [], None, []
        for batch in batches:
            for key, p, q, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (key, p, q) != at:
                    found += links(group, at[0]) if len(group) > 1 else []
                    group, at = [], (key, p, q)
                group.append(row)
        found += links(group, at[0]) if len(group) > 1 else []
        yield rows_of(found)

    spark = members.sparkSession
    rows = rows.select("key", "p", "q", "i", "cls", "root", "sig", "bands", "wide", "hashes")
    rows = rows.repartition(partitions(spark), "key", "p", "q").sortWithinPartitions("key", "p", "q", "cls")
    return rows.mapInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, row: str | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, cls, component_id, kept``.

    ``component_id`` is the smallest doc_id of the documents that links reach (``similarity`` or
    more on sets of ``k``-word shingles), ``kept`` marks the documents that have it.
    A NULL doc_id counts as smaller than any other; NULL, empty and blank texts have an
    empty set and stand alone; repeated rows are copies of each other; rows with one
    doc_id and different texts are compared like others.  An empty table gives an empty result.

    With ``row``, a column of ``docs`` that tells rows apart, the result also has ``row``, ``root`` (the
    same for the rows that links reach, NULL for an empty set) and ``t``, a hash of the text.
    """
    carried = [] if row is None else [F.col(row).alias("row"), F.xxhash64("text").alias("t")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    signed = _save(signatures(docs, k), "signatures")
    own = F.coalesce("doc_id", F.lit(NULL_ID))
    classes = signed.where("cls is not null").groupBy("cls").agg(
        F.min(own).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
        F.first("bands").alias("bands"))
    classes = _save(classes, "classes")
    keyed = classes.select("cls", "n_shingles", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = _save(keyed.join(buckets, "key"), "members")

    # full sets of the classes that share any bucket
    wanted = classes.join(members.select("cls").distinct(), "cls", "left_semi").select(F.col("rep").alias("_rep"))

    def hashes(batches: Iterable[pa.RecordBatch]):
        import xxhash
        for _, texts in byte_slices(batches, max_bytes=1_000_000):
            shingles, first = shingle_sets(Words(texts, SPACED_LOWER), k)
            sets = [np.unique(shingles[lo:hi]).tobytes() for lo, hi in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_pydict({"cls": pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                                              "hashes": pa.array(sets, pa.binary())})

    texts = docs.select("doc_id", "text").withColumn("_rep", own).join(wanted.distinct(), "_rep", "left_semi").select("text")
    sets = _save(texts.mapInArrow(hashes, "cls binary, hashes binary").dropDuplicates(["cls"]), "sets")

    floor = similarity - SLACK

    def estimated(pairs: DataFrame) -> DataFrame:
        def near(batches: Iterable[pa.RecordBatch]):
            for b in batches:
                x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                y = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                yield b.select([0, 1]).filter(pa.array(_estimate(x, y) >= floor))

        one = classes.select(F.col("cls").alias("a"), F.col("sig").alias("sa"))
        two = classes.select(F.col("cls").alias("b"), F.col("sig").alias("sb"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(
            near, "a binary, b binary")

    links = _save(confirm(estimated(_hub_pairs(members)), sets, similarity), "confirmed")
    labels = components(links)
    more = _save(_cross_links(members, labels, classes, sets, similarity), "confirmed")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = classes.select("cls", "rep").join(labels, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(smallest, "root").select("cls", "component", "root")
    more = [] if row is None else ["row", "t"]
    out = signed.select("doc_id", "n_shingles", "cls", *more).join(named, "cls", "left")
    component = F.coalesce("component", own)
    component = F.when(component != NULL_ID, component)
    return out.select("doc_id", "n_shingles", "cls", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), *(["root", *more] if more else []))


def one_per_group(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (all columns) without near copies: of the rows that links reach only the
    first stays, by doc_id (NULL first), then hash of the text, then row.  Rows with an empty set stay.
    The rows are written once with a number, so that no decision is made by doc_id."""
    keyed = _save(boxed(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = _save(near_duplicates(keyed, k, similarity, row="_row").select("root", "doc_id", "t", "row"), "found")
    first = F.min(F.struct("doc_id", "t", "row"))["row"].alias("_row")
    kept = found.where("root is not null").groupBy("root").agg(first).select("_row").unionAll(
        found.where("root is null").select("row"))
    return unboxed(keyed.join(kept, "_row", "left_semi"), docs.columns)
