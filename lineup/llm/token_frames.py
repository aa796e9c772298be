"""Token-id files: one zstandard frame per document and a trailing seek table.

File layout (all integers little-endian)::

    frame of document 0 | frame of document 1 | ... | directory | seek table

* A document frame is an independent zstandard frame whose content is the
  document's token ids, 2 bytes each if the vocabulary allows it, else 4.
* The directory is a skippable frame: item size, then per document its
  identifier, a flag for a NULL identifier.
* The seek table is the last skippable frame, in the public seekable format: per
  frame its compressed size, decompressed size and checksum (low 32 bits of
  XXH64 of the content), then the number of frames, a flag byte and a magic
  number.  A reader needs the last bytes of a file to find any document, and
  decompresses the frames of the documents it is asked for only.

Files are written by tasks into a folder that all executors share (a URI that
pyarrow's file systems open), under a temporary name first, so that a repeated
task replaces its file by the same content.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineup.llm.common import filesystem, partitions, slices
from lineup.llm.tokens import BYTE_BPE, encoder

SKIPPABLE_DIRECTORY = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


class CorruptFile(ValueError):
    """A file, seek table or frame that does not hold what its checksums say."""


class FrameWriter:
    """Appends document frames to an open binary stream; ``close`` adds directory and seek table."""

    def __init__(self, out, item_size: int, level: int = 3):
        import zstandard
        self.out, self.item_size = out, item_size
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        import xxhash
        raw = tokens.astype(f"<u{self.item_size}").tobytes()
        frame = self.pack.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        import xxhash
        ids = np.array([0 if i is None else i for i in self.ids], "<i8").tobytes()
        none = np.array([i is None for i in self.ids], np.uint8).tobytes()
        body = struct.pack("<B", self.item_size) + ids + none
        self.out.write(struct.pack("<II", SKIPPABLE_DIRECTORY, len(body)) + body)
        self.entries.append((len(body) + 8, 0, xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        table = np.array(self.entries, "<u4").tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG,
                                                                      SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)


class FrameReader:
    """Random access to one file: reads the seek table and the directory, then frames on demand."""

    def __init__(self, source):
        import xxhash
        self.src = source
        size = source.size()
        if size < 17:
            raise CorruptFile("no seek table")
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        length = 12 * n + 9
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG or length + 8 > size or n < 1:
            raise CorruptFile("no seek table")
        source.seek(size - length - 8)
        head = struct.unpack("<II", source.read(8))
        if head != (SKIPPABLE_SEEK_TABLE, length):
            raise CorruptFile("no seek table")
        entries = np.frombuffer(source.read(length - 9), "<u4").reshape(n, 3).astype(np.int64)
        ends = np.cumsum(entries[:, 0])
        if ends[-1] + 8 + length != size:
            raise CorruptFile("the seek table does not cover the file")
        self.begin, self.size, self.raw, self.check = ends - entries[:, 0], entries[:, 0], entries[:, 1], entries[:, 2]
        body = self._at(n - 1)[8:]
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != self.check[n - 1]:
            raise CorruptFile("directory checksum")
        self.item_size, docs = body[0], n - 1
        ids = np.frombuffer(body, "<i8", docs, 1).tolist()
        none = np.frombuffer(body, np.uint8, docs, 1 + 8 * docs)
        self.ids = [None if x else i for i, x in zip(ids, none)]
        self.n_tokens = self.raw[:docs] // self.item_size

    def _at(self, k: int) -> bytes:
        self.src.seek(int(self.begin[k]))
        return self.src.read(int(self.size[k]))

    def __len__(self) -> int:
        return len(self.ids)

    def tokens(self, k: int) -> np.ndarray:
        """Ids of the k-th document as uint32; the frame's checksum is verified."""
        import xxhash
        import zstandard
        try:
            raw = zstandard.ZstdDecompressor().decompress(self._at(k), max_output_size=max(1, int(self.raw[k])))
        except zstandard.ZstdError as e:
            raise CorruptFile(str(e)) from e
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.check[k]:
            raise CorruptFile(f"frame {k} checksum")
        return np.frombuffer(raw, f"<u{self.item_size}").astype(np.uint32)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = BYTE_BPE, end_id: int | None = 0,
                      n_files: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the ids in ascending doc_id order
    to at most ``n_files`` files under ``folder``; ``end_id`` ends every document.

    Returns one row per file: ``shard, file, n_docs, n_tokens, has_null, least, greatest`` (a written
    table; files in ascending doc_id order; the last two are the file's doc_ids).  A NULL text is the
    empty text; a very long text is one frame of any length; a NULL doc_id sorts first; rows of one
    doc_id are ordered by text and stay separate, equal rows are dealt over files by a row
    number; an empty table writes no file.  Other columns are not read.
    """
    spark = docs.sparkSession
    n_files = n_files or partitions(spark)

    def encode(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext
        enc = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        name = f"tokens-{shard:06d}.zst"
        temp = f"{root}/.{name}.{uuid.uuid4().hex}"
        out, total = None, 0
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        size = 2 if max(enc.vocab_size, (end_id or 0) + 1) <= 1 << 16 else 4
        for rows, texts in slices(batches):
            if out is None:
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(temp)
                out = FrameWriter(stream, size)
            for doc_id, ids in zip(rows.column(0).to_pylist(), enc.encode(texts)):
                out.add(doc_id, np.concatenate([ids, tail]))
                total += len(ids) + len(tail)
        if out is not None:
            out.close()
            stream.close()
            fs.move(temp, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": pa.array([len(out.ids)], pa.int64()),
                 "n_tokens": pa.array([total], pa.int64()), "has_null": [out.ids[0] is None],
                 "least": pa.array([next((i for i in out.ids if i is not None), None)], pa.int64()),
                 "greatest": pa.array([out.ids[-1]], pa.int64())})

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .repartitionByRange(n_files, F.col("doc_id").asc_nulls_first(), F.hash("text"),
                                F.monotonically_increasing_id())
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.hash("text"), "text"))
    manifest = f"{folder}/manifest"
    rows.mapInArrow(encode, "shard int, file string, n_docs long, n_tokens long, has_null boolean, least long, "
                            "greatest long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, doc_ids: Iterable[int] | None = None,
                     with_tokens: bool = True) -> DataFrame:
    """Documents back from the files: ``doc_id, start, n_tokens, ids_crc32, file``
    and ``tokens`` (array) if asked for.  ``start`` counts the ids of all documents before
    it.  With ``doc_ids`` only files that can hold one are opened, and only their frames are read
    and decompressed.

    The driver holds one row per file; every frame read is checked against the seek table.
    """
    files = sorted(tuple(r) for r in manifest.select("shard", "file", "n_tokens", "has_null", "least", "greatest").collect())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"
    schema += ", tokens array<long>" if with_tokens else ""
    if not files:
        return spark.createDataFrame([], schema)
    wanted = None if doc_ids is None else set(doc_ids)
    known = sorted(i for i in wanted or () if i is not None)
    bases, at = [], 0
    for _, file, n, has_null, least, greatest in files:
        k = 0 if least is None else bisect_left(known, least)
        if wanted is None or has_null and None in wanted or least is not None and k < len(known) and known[k] <= greatest:
            bases.append((file, at))
        at += n
    if not bases:
        return spark.createDataFrame([], schema)

    def read(batches: Iterable[pa.RecordBatch]):
        fs, root = filesystem(folder)
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{file}") as source:
                    reader = FrameReader(source)
                    starts = base + np.cumsum(reader.n_tokens) - reader.n_tokens
                    chosen = [k for k in range(len(reader)) if wanted is None or reader.ids[k] in wanted]
                    for lo in range(0, len(chosen), 512):
                        part = chosen[lo:lo + 512]
                        ids = [reader.tokens(k) for k in part]
                        cols = {"doc_id": pa.array([reader.ids[k] for k in part], pa.int64()),
                                "start": pa.array([int(starts[k]) for k in part], pa.int64()),
                                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                                "file": pa.array([file] * len(part), pa.string())}
                        if with_tokens:
                            cols["tokens"] = pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(cols)

    names = spark.createDataFrame(bases, "file string, base long").repartition(len(bases))
    return names.mapInArrow(read, schema)
