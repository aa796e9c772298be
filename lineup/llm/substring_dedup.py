"""Removal of repeated word sequences by prefix-partitioned suffix trees.

A window is ``length`` consecutive words of a document.  Every word inside a window
whose words also start earlier (smaller doc_id, or the same document further
left) is removed; windows are judged on the input.

The suffixes of all documents would make one suffix tree; what matters are its nodes at
a depth of ``length`` words or more.  It is split into subtrees that fit a task:

0. The rows are written once with a number.  Of the rows with one text (told by a 128-bit hash) the
   first takes part in what follows; those with its doc_id share its result, the others are
   later copies, which repeat all their windows.  So equal rows, however many, are searched once.
1. *Short prefixes.*  A suffix is routed by its anchor: of the ``ANCHOR``-word sequences in its
   first ``length`` words the one with the least hash (the leftmost of equals).  Equal windows
   have equal anchors, so each deep node lies in one group whole.  Neighbouring suffixes
   mostly share their anchor and travel as one segment of text.
2. Anchors (a hash and a place, no text) are sorted by hash, document and position over range
   partitions, so even one anchor of a third of all documents spans many.  Those met
   once hold no repeat; the text of the others is cut from the documents.
3. In a group the suffixes are sorted and compared by their first ``length`` words only; neighbours
   that share them are the leaves below one node of that depth.  All but its first occurrence
   are repeats.  Common-prefix lengths, deeper nodes and maximal repeats are not made.
4. *Long prefixes.*  An anchor with more than ``GROUP`` segments, or one at the border of a
   range, is split.  Each part resolves its own repeats and sends on the first occurrence of each
   deep prefix only; those meet by the hash of all ``length`` words.  A passage in a third of all
   documents shrinks by a factor of ``GROUP`` before its occurrences meet.

Both joins by document read one exchange of the texts.

Defined cases.  A NULL, empty or blank text has no words; very long texts are searched whole; a NULL
doc_id is smaller than any other; rows with equal doc_id and text are one document, and each gets its
result; rows with one doc_id and different texts are documents in the order in which they were
written; an empty table gives an empty result; columns other than ``doc_id, text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineup.llm.common import NULL_ID, byte_slices, partitions
from lineup.llm.words import SPACED, Words
from lineup.session import shared_dir

ANCHOR = 6
GROUP = 500
#: End of the range that stands for a whole document.
WHOLE = (1 << 31) - 1


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _numbered(docs: DataFrame) -> DataFrame:
    """``row, k, t, u, text``: the rows with a number, the doc_id without NULL and two hashes of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return _written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k"),
        F.xxhash64(text).alias("t"), F.xxhash64(F.lit("second"), text).alias("u"), text.cast("binary").alias("text")),
        "substring-rows")


def anchors(keyed: DataFrame, length: int) -> DataFrame:
    """``h, k, row, s, m``: the anchor hash of ``m`` windows starting at words ``s, s+1, ...`` of a document."""
    def find(batches: Iterable[pa.RecordBatch]):
        for rows, texts in byte_slices(batches, max_bytes=2_000_000):
            words = Words(texts, SPACED)
            n = len(words) - length + 1
            if n <= 0:
                continue
            grams = words.windows(ANCHOR)
            least, at = grams[:n].copy(), np.zeros(n, np.int64)
            for j in range(1, length - ANCHOR + 1):
                g = grams[j:j + n]
                less = g < least
                np.copyto(least, g, where=less)
                at[less] = j
            start = np.flatnonzero(words.whole(length)[:n])
            if not len(start):
                continue
            at = at[start] + start
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1])]))
            first = start[new]
            doc = np.searchsorted(words.first, first, side="right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(least[first].view(np.int64)), rows.column(1).take(pa.array(doc)),
                rows.column(0).take(pa.array(doc)), pa.array((first - words.first[doc]).astype(np.int32)),
                pa.array(np.diff(np.concatenate([new, [len(start)]])).astype(np.int32))], ["h", "k", "row", "s", "m"])

    return keyed.select("row", "k", "text").mapInArrow(find, "h long, k long, row long, s int, m int")


def _repeated(rows: DataFrame) -> DataFrame:
    """Of anchors sorted by ``h, k, row, s`` over range partitions those that may be repeated:
    ``row, s, m, h, salt``.  Anchors of one partition share a ``salt`` of 0; those that are split
    (very many, or perhaps continued in the next range) get one salt per part, above 0."""
    def pick(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext
        part = (TaskContext.get().partitionId() + 1) << 32
        held: list[np.ndarray] | None = None  # the last run so far
        chunk, first = 0, True

        def out(cols: list[np.ndarray], salt: np.ndarray | int) -> pa.RecordBatch:
            h, _, row, s, m = cols
            salt = np.full(len(h), salt, np.int64) if np.isscalar(salt) else salt
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (row, s, m, h, salt)], ["row", "s", "m", "h", "salt"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
            h = cols[0]
            if not len(h):
                continue
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            if len(start) > 1:
                # the first run ends here: it may continue a former partition, or chunks already sent
                if first or chunk:
                    yield out([c[:start[1]] for c in cols], part + chunk)
                    chunk, first = 0, False
                    cols, start = [c[start[1]:] for c in cols], start[1:] - start[1]
                last = start[-1]
                size = np.diff(start)
                row_size = np.repeat(size, size)
                keep = np.flatnonzero(row_size > 1)
                if len(keep):
                    place = np.arange(last) - np.repeat(start[:-1], size)
                    salt = np.where(row_size > GROUP, part + place // GROUP, 0)
                    yield out([c[keep] for c in cols], salt[keep])
                cols = [c[last:] for c in cols]
            while len(cols[0]) > GROUP:
                yield out([c[:GROUP] for c in cols], part + chunk)
                cols = [c[GROUP:] for c in cols]
                chunk += 1
            held = cols
        if held is not None:
            yield out(held, part + chunk)

    return rows.mapInArrow(pick, "row long, s int, m int, h long, salt long")


def _segments(docs_and_anchors: DataFrame, length: int) -> DataFrame:
    """Text of each repeated anchor's windows: words joined and ended by newlines."""
    def cut(batches: Iterable[pa.RecordBatch]):
        for rows, texts in byte_slices(batches, max_bytes=2_000_000):
            words = Words(texts, SPACED)
            number, k, found = (rows.column(i).to_pylist() for i in (0, 1, 3))
            out: list[tuple] = []
            for d, own in enumerate(found):
                at = int(words.first[d])
                for a in own:
                    lo = at + a["s"]
                    out.append((a["h"], a["salt"], k[d], number[d], a["s"], a["m"],
                                b"\n".join(words.list(lo, lo + a["m"] + length - 1)) + b"\n"))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, q) for c, q in zip(zip(*out) if out else [[]] * 7, kinds)],
                                             ["h", "salt", "k", "row", "s", "m", "segment"])

    return docs_and_anchors.select("row", "k", "text", "found").mapInArrow(
        cut, "h long, salt long, k long, row long, s int, m int, segment binary")


def deep_nodes(suffixes: list[tuple[bytes, int]], depth: list[int]) -> Iterator[list[int]]:
    """Leaves below each topmost deep node of the suffix tree of ``suffixes`` (text, number).

    ``depth[number]`` is the length in bytes of the prefix that makes a node deep.  In the
    sorted suffixes those below one node are neighbours that share that prefix.
    """
    order = sorted(suffixes)
    at = 0
    while at < len(order):
        text, number = order[at]
        prefix = text[:depth[number]]
        end = at + 1
        while end < len(order) and order[end][0].startswith(prefix):
            end += 1
        if end - at > 1:
            yield [n for _, n in order[at:end]]
        at = end


def _resolve(group: list[tuple], length: int) -> tuple[list[tuple], list[tuple]]:
    """(repeats, survivors) of the segments of one group: ``(k, row, lo, hi)`` word ranges, and
    ``(k, row, start, prefix)`` of the windows that are first in the group."""
    suffixes, depth, place = [], [], []
    for k, row, s, m, text in group:
        cuts, at = [0], text.find(b"\n")
        while at >= 0:
            cuts.append(at + 1)
            at = text.find(b"\n", at + 1)
        for j in range(m):
            suffixes.append((text[cuts[j]:], len(place)))
            depth.append(cuts[j + length] - cuts[j])
            place.append((k, row, s + j))
    later = set()
    for leaves in deep_nodes(suffixes, depth):
        first = min(place[n] for n in leaves)
        later.update(n for n in leaves if place[n] != first)
    repeats: list[list] = []
    for n in sorted(later, key=place.__getitem__):
        k, row, s = place[n]
        if repeats and repeats[-1][:2] == [k, row] and s <= repeats[-1][3]:
            repeats[-1][3] = max(repeats[-1][3], s + length)
        else:
            repeats.append([k, row, s, s + length])
    survivors = [(*place[n], suffixes[n][0][:depth[n]]) for n in range(len(place)) if n not in later]
    return repeats, survivors


def _subtrees(segments: DataFrame, length: int) -> DataFrame:
    """``k, row, lo, hi, prefix``: repeats (NULL prefix) and, for split anchors, the windows
    that are first in their part, with a 128-bit hash of their words."""
    def walk(batches: Iterable[pa.RecordBatch]):
        import xxhash

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, q) for c, q in zip(zip(*found) if found else [[]] * 5, kinds)],
                ["k", "row", "lo", "hi", "prefix"])

        def finish(group: list[tuple], split: bool) -> list[tuple]:
            if len(group) < 2 and not split:
                return [] if group[0][3] < 2 else [(*r, None) for r in _resolve(group, length)[0]]
            repeats, survivors = _resolve(group, length)
            found = [(*r, None) for r in repeats]
            if split:
                found += [(k, row, s, s + length, xxhash.xxh3_128_digest(p)) for k, row, s, p in survivors]
            return found

        found: list[tuple] = []
        group: list[tuple] = []
        at, split = None, False
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for h, salt, k, row, s, m, text in zip(*cols):
                if (h, salt) != at:
                    if group:
                        found += finish(group, split)
                    group, at, split = [], (h, salt), salt > 0
                group.append((k, row, s, m, text))
                if len(found) > 20_000:
                    yield rows(found)
                    found = []
        if group:
            found += finish(group, split)
        yield rows(found)

    keyed = segments.select("h", "salt", "k", "row", "s", "m", "segment").repartition("h", "salt")
    return keyed.sortWithinPartitions("h", "salt").mapInArrow(walk, "k long, row long, lo int, hi int, prefix binary")


def _same_text(rows: DataFrame) -> DataFrame:
    """``row, first, same``: the rows whose text an earlier row has, that row, and whether it has their doc_id."""
    names = rows.select("row", "k", "t", "u")
    # one row a text, reduced before the shuffle; only texts of several rows meet their rows again
    first = names.groupBy("t", "u").agg(F.min(F.struct("k", "row")).alias("_f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return names.join(first.drop("n"), ["t", "u"]).where("row <> _f.row").select(
        "row", F.col("_f.row").alias("first"), (F.col("k") == F.col("_f.k")).alias("same"))


def _ranges(rows: DataFrame, length: int) -> DataFrame:
    """``row, ranges``: for each row with repeats, the word ranges ``lo, hi`` to remove."""
    if length < ANCHOR + 1:
        raise ValueError(f"windows need more than {ANCHOR} words")
    order = ["h", "k", "row", "s"]
    copies = _written(_same_text(rows), "substring-copies")
    keyed = rows.select("row", "k", "text")
    firsts = keyed.join(copies.select("row"), "row", "left_anti")
    sorted_ = anchors(firsts, length).repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    found = _repeated(sorted_).groupBy("row").agg(F.collect_list(F.struct("s", "m", "h", "salt")).alias("found"))
    walked = _written(_subtrees(_segments(keyed.join(found, "row"), length), length), "substring-repeats")
    # the first occurrences of split anchors meet by all their words: reduced to the very first, joined again
    parts = walked.where("prefix is not null")
    least = parts.groupBy("prefix").agg(F.min(F.struct("k", "row", "lo")).alias("_f"), F.count(F.lit(1)).alias("n"))
    later = parts.join(least.where("n > 1").drop("n"), "prefix").where(F.struct("k", "row", "lo") != F.col("_f"))
    own = walked.where("prefix is null").unionByName(later.drop("_f")).select("row", "lo", "hi")
    own = own.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    shared = copies.where("same").join(own.withColumnRenamed("row", "first"), "first").select("row", "ranges")
    whole = copies.where("not same").select("row", F.array(F.struct(F.lit(0).alias("lo"), F.lit(WHOLE).alias("hi"))).alias("ranges"))
    return own.unionByName(shared).unionByName(whole)


def remove_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """``doc_id, text, n_words, n_removed`` per row: the kept words joined by one space."""
    rows = _numbered(docs)
    joined = rows.select("row", "k", "text").join(_ranges(rows, length), "row", "left")

    def apply(batches: Iterable[pa.RecordBatch]):
        for rows, texts in byte_slices(batches):
            words = Words(texts, SPACED)
            kept, removed = [], []
            for d, ranges in enumerate(rows.column(3).to_pylist()):
                lo, hi = int(words.first[d]), int(words.first[d + 1])
                own = words.list(lo, hi)
                gone = np.zeros(hi - lo, bool)
                for r in ranges or ():
                    if r["hi"] < WHOLE or hi - lo >= length:  # a copy without a window repeats none
                        gone[r["lo"]:r["hi"]] = True
                kept.append(b" ".join([w for w, g in zip(own, gone.tolist()) if not g] if gone.any() else own))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([None if k == NULL_ID else k for k in rows.column(1).to_pylist()], pa.int64()),
                "text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(words.count, pa.int64()),
                "n_removed": pa.array(removed, pa.int64())})

    return joined.select("row", "k", "text", "ranges").mapInArrow(
        apply, "doc_id long, text string, n_words long, n_removed long")
