"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a NULL identifier inside joins and orders; real identifiers sort after it.
NULL_ID = -(1 << 63)


def importable(spark: SparkSession) -> None:
    """Let the workers of a local session import this library from where the driver did.
    On a cluster the library is installed or shipped with ``--py-files``."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if sc.master.startswith("local") and root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: what explicit repartitioning uses."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_of(name: str):
    """``name`` as a long that is never NULL, so that plain equi-joins keep NULL identifiers."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_chars: int = 8_000_000,
           max_rows: int = 2048) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut Arrow batches into pieces of bounded text size (at least one row each)
    and give each with its texts, so that a task holds few long texts at once."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        lo, n = 0, batch.num_rows
        sizes = col.cast(pa.large_string()).fill_null("")
        size = pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False)
        while lo < n:
            hi, chars = lo, 0
            while hi < n and hi - lo < max_rows and (hi == lo or chars + size[hi] <= max_chars):
                chars += int(size[hi])
                hi += 1
            yield batch.slice(lo, hi - lo), col.slice(lo, hi - lo).to_pylist()
            lo = hi


def filesystem(uri: str):
    """(pyarrow file system, path) of a Hadoop-style URI, ``file:/x`` included."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 4_000_000,
                max_rows: int = 2048) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Like ``slices`` with the texts as UTF-8 bytes."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        batch = batch.set_column(at, column, batch.column(at).cast(pa.large_binary()))
        col = batch.column(at)
        size = pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        lo, n = 0, batch.num_rows
        while lo < n:
            hi, total = lo, 0
            while hi < n and hi - lo < max_rows and (hi == lo or total + size[hi] <= max_bytes):
                total += int(size[hi])
                hi += 1
            yield batch.slice(lo, hi - lo), col.slice(lo, hi - lo).to_pylist()
            lo = hi


def boxed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _rest``: the other columns in one struct, so that no name can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(1).alias("_")).alias("_rest"))


def unboxed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse: ``columns`` in their order, whatever else there is left out."""
    return docs.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c)
                         for c in columns])
