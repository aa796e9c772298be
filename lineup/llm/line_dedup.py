"""Line de-duplication in DataFrame operations only.

Lines leave the documents as (key hash, document, position) rows, never as
text.  The rows are range-partitioned by hash with document and position as
secondary sort, so one very common line spans many partitions; each partition
reduces its run of a hash to one row (document count and first occurrence)
before anything meets by hash.  What goes back to the documents is a compressed
bitmap of the lines to keep: per document the runs of dropped lines.

A line's key is the line with ASCII white space stripped at both ends and A-Z
lower-cased.  Keys are told apart by a 64-bit hash, a checksum and the length.

Defined cases.  A NULL or empty text is one empty line; empty keys
are never dropped; a NULL doc_id is a document like any other.  Rows with the
same doc_id and text are one document to ``keep_first`` (all of them keep a first
occurrence) and separate documents to the document count.  Rows with the same
doc_id and different texts are separate documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineup.llm.common import NULL_ID, partitions
from lineup.session import shared_dir

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["_k", "_t"]


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _identified(docs: DataFrame) -> DataFrame:
    """``_k`` (doc_id, never NULL) and ``_t`` (text hash) name a document."""
    return docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)),
                             "_t": F.xxhash64(_text())})


def line_rows(docs: DataFrame) -> DataFrame:
    """``_k, _t, pos, h, c, first_here`` per line with a non-empty key; ``first_here`` marks
    the first line of a key inside its document."""
    lines = F.split(_text(), "\n", -1)
    rows = _identified(docs).select(*_KEY, F.posexplode(lines).alias("pos", "line"))
    key = F.translate(F.trim(F.col("line"), F.lit(_SPACE)), _UPPER, _LOWER)
    rows = rows.select(*_KEY, "pos", key.alias("key")).where("key <> ''")
    return rows.select(*_KEY, "pos", F.xxhash64("key").alias("h"),
                       (F.crc32("key") * F.lit(1 << 31) + F.char_length("key")).alias("c"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_runs(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Compressed keep bitmaps: ``_k, _t, drop_runs`` (array of ``lo, n``) for each
    document that loses lines.

    A line is dropped where its key has at least ``min_chars`` code points and occurs in at least
    ``min_docs`` documents; with ``keep_first`` the first such line (smallest document, then
    position) stays.
    """
    rows = line_rows(docs)
    if min_chars > 1:
        rows = rows.where(F.pmod("c", F.lit(1 << 31)) >= min_chars)
    rows = (rows.repartitionByRange(partitions(docs.sparkSession), "h", "c", "_k", "_t", "pos")
            .sortWithinPartitions("h", "c", "_k", "_t", "pos"))
    # written once: the keys and the marks both read them, and two plain scans can be joined
    # with one very common key dealt to many tasks (an aggregate below the join could not)
    rows = _written(rows, "lines")
    # one row per (key, document) first, then per key: both reduce inside a partition before the shuffle
    where = F.struct("_k", "_t", "pos")
    per_doc = rows.groupBy("h", "c", *_KEY).agg(F.min("pos").alias("pos"), F.count("*").alias("n_lines"))
    copies = (_identified(docs).groupBy(*_KEY).agg(F.count("*").alias("copies")).where("copies > 1"))
    per_doc = per_doc.join(copies, _KEY, "left")
    keys = (per_doc.groupBy("h", "c").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("n_docs"),
                                          F.min(where).alias("first")).where(F.col("n_docs") >= min_docs))
    marked = rows.join(_written(keys, "line-keys"), ["h", "c"])
    if keep_first:
        marked = marked.where(where != F.col("first"))
    marked = marked.select(*_KEY, "pos").distinct()  # copies of a document give the same rows
    own = W.partitionBy(*_KEY).orderBy("pos")
    islands = marked.withColumn("_g", F.col("pos") - F.row_number().over(own))
    runs = islands.groupBy(*_KEY, "_g").agg(F.min("pos").alias("lo"), F.count("*").cast("int").alias("n"))
    return runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("lo", "n"))).alias("drop_runs"))


def apply_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with ``text`` reduced to its kept lines, and ``n_lines``, ``n_dropped``."""
    marked = _identified(docs).withColumn("_text", _text()).join(runs, _KEY, "left")
    none = F.expr("cast(array() as array<struct<lo: int, n: int>>)")
    marked = marked.withColumn("drop_runs", F.coalesce("drop_runs", none))
    # the lines between the dropped runs, each run cut out once
    kept = F.expr("""transform(array(split(_text, '\\n', -1)), lines -> array_join(flatten(zip_with(
        concat(array(0), transform(drop_runs, r -> r.lo + r.n)),
        concat(transform(drop_runs, r -> r.lo), array(size(lines))),
        (s, e) -> slice(lines, s + 1, e - s))), '\\n'))[0]""")
    n_lines = F.char_length("_text") - F.char_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    dropped = F.aggregate("drop_runs", F.lit(0).cast("long"), lambda a, r: a + r["n"].cast("long"))
    return (marked.withColumns({"text": F.when(F.size("drop_runs") > 0, kept).otherwise(F.col("_text")),
                                "n_lines": n_lines.cast("long"), "n_dropped": dropped})
            .drop("_k", "_t", "_text", "drop_runs"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` without the lines that ``drop_runs`` names; a NULL text becomes the empty text."""
    return apply_runs(docs, drop_runs(docs, min_docs, min_chars, keep_first))
