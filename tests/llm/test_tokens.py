"""Token files (exact round trip) and packing (brute-force best fit, exact tiling)."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import frame, rows
from tokenizers import Tokenizer

from lineup.llm import tokens as T
from lineup.llm.common import filesystem
from lineup.llm.packing import pack, pack_documents, plan_bins
from lineup.llm.token_frames import CorruptFile, FrameReader, read_token_files, write_token_files
from lineup.session import shared_dir

ODD = ["", None, " ", "a", " a", "a ", "a  b", "a\n\nb", "a\tb c", "don't 's x\n'll", "\x01 a b", "a \x01", "x\x00y z",
       "é é b", "a b c", "a\nb", "a\n b", "a \nb", "<|endoftext|> x", "\n", "İ ΑΣ b", "a ́b",
       "ﬁ 漢字 𝒳 y", "x\x1cy z", "A" * 5000]


@pytest.mark.parametrize("name", [T.BYTE_BPE, T.WORD_BPE])
def test_pieces_give_the_ids_of_whole_texts(name):
    tok = Tokenizer.from_file(T.tokenizer_path(name))
    tok.encode_special_tokens = True
    every = ODD + [t for _, t in rows()]
    rng = random.Random(3)
    every += ["".join(rng.choice(["a", "Bc", " ", "\n", "'s", ".", "é", "12"]) for _ in range(40)) for _ in range(200)]
    for text, ids in zip(every, T.encoder(name).encode(every)):
        assert ids.tolist() == tok.encode(text or "", add_special_tokens=False).ids, text


def test_forgetting_rare_pieces_keeps_ids(monkeypatch):
    monkeypatch.setattr(T, "MAX_PIECES", 50)
    enc = T.PieceEncoder(T.BYTE_BPE)
    for _, text in rows() * 2:
        assert enc.encode([text])[0].tolist() == enc._ids(text or "")


def test_files_round_trip(spark):
    data = rows()
    folder = shared_dir(spark, "tokens-test")
    manifest = write_token_files(frame(spark, data), folder, n_files=4)
    got = read_token_files(spark, folder, manifest).collect()
    tok = Tokenizer.from_file(T.tokenizer_path(T.BYTE_BPE))
    assert len(got) == len(data)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and len(r.tokens) == r.n_tokens and r.tokens[-1] == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes())
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted((i for i, _ in data), key=lambda i: (i is not None, i or 0))
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r.tokens)
    for i, text in data:
        assert tok.encode(text or "", add_special_tokens=False).ids + [0] in by_id[i]
    some = read_token_files(spark, folder, manifest, doc_ids=[3, 6]).collect()
    assert {r.doc_id for r in some} == {3, 6}
    starts = {(r.doc_id, r.start) for r in got}
    assert all((r.doc_id, r.start) in starts for r in some)


def test_a_damaged_frame_is_found_and_others_still_read(spark):
    folder = shared_dir(spark, "tokens-test")
    manifest = write_token_files(frame(spark, rows()), folder, n_files=1)
    fs, root = filesystem(folder)
    path = f"{root}/{manifest.first().file}"
    data = bytearray(open(path, "rb").read())
    with fs.open_input_file(path) as f:
        reader = FrameReader(f)
        victim = int(np.argmax(reader.raw[:-1]))
        data[int(reader.begin[victim]) + int(reader.size[victim]) // 2] ^= 0xFF
    open(path, "wb").write(bytes(data))
    with fs.open_input_file(path) as f:
        reader = FrameReader(f)
        reader.tokens((victim + 1) % len(reader))
        with pytest.raises(CorruptFile):
            reader.tokens(victim)
    open(path, "wb").write(bytes(data[:-4]))
    with fs.open_input_file(path) as f, pytest.raises(CorruptFile):
        FrameReader(f)


def test_empty_table(spark):
    empty = frame(spark, [])
    folder = shared_dir(spark, "tokens-test")
    manifest = write_token_files(empty, folder)
    assert read_token_files(spark, folder, manifest).count() == 0
    assert pack_documents(empty).count() == 0


def _fill(counts, capacity):
    """Bins of a plan, after checking that it places every item once and overlaps nothing."""
    bins, seen = defaultdict(list), defaultdict(set)
    for length, rank, items, first, per, offset in plan_bins(counts, capacity):
        for i in range(items):
            assert rank + i not in seen[length]
            seen[length].add(rank + i)
            bins[first + i // per].append((offset + i % per * length, length))
    assert {n: len(s) for n, s in seen.items()} == {n: c for n, c in counts.items() if c}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    return bins


def _best_fit_decreasing(counts, capacity):
    gaps = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(capacity - length)
        else:
            gaps[gaps.index(fit)] = fit - length
    return len(gaps)


@pytest.mark.parametrize("seed", range(25))
def test_plan_needs_no_more_bins_than_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100, 257])
    counts = defaultdict(int)
    for _ in range(rng.randint(0, 120)):
        counts[rng.choice([rng.randint(1, capacity), rng.randint(capacity // 3, capacity // 2 + 1) or 1])] += 1
    bins = _fill(dict(counts), capacity)
    assert len(bins) <= _best_fit_decreasing(counts, capacity)
    large = [sum(3 * n > capacity for _, n in b) for b in bins.values()]
    assert max(large, default=0) <= 2


def test_packing_of_documents(spark):
    data = rows()
    got = pack_documents(frame(spark, data), capacity=64, with_tokens=True).collect()
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.tokens) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= 1.02 * total / 64 + 1
    for i, text in data:
        n = len(T.encoder(T.WORD_BPE).encode([text])[0]) + 1
        assert sum(p[2] for p in docs[i]) == n * sum(j == i for j, _ in data)


def test_one_very_common_length_is_split(spark, monkeypatch):
    import lineup.llm.packing as P
    monkeypatch.setattr(P, "RANK_GROUP", 10)
    df = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start",
                                      "case when id % 3 = 0 then 5L else 1 + id % 11 end as length", "id as ids_crc32")
    got = pack(df, 16).collect()
    slots = {(r.sequence_id, r.offset + j) for r in got for j in range(r.length)}
    assert len(slots) == sum(r.length for r in got) and max(o for _, o in slots) < 16


def test_equal_rows_are_dealt_over_files_and_files_are_skipped(spark):
    """A third of the table as one repeated row fills several files; a reader opens those that can hold its ids."""
    from lineup.llm.token_frames import read_token_files, write_token_files
    from lineup.session import shared_dir
    data = [(5, "one two three")] * 3000 + [(i, f"text {i}") for i in range(100, 3100)] + [(None, "none")] * 10
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    folder = shared_dir(spark, "t-equal")
    manifest = write_token_files(df, folder, n_files=8)
    files = {r["file"]: r for r in manifest.collect()}
    assert sum(r["n_docs"] for r in files.values()) == len(data) and max(r["n_docs"] for r in files.values()) < 2000
    assert sum(r["least"] == 5 == r["greatest"] for r in files.values()) >= 2
    got = read_token_files(spark, folder, manifest, [2000, None]).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted([("2000", len(got[0].tokens))] + [("None", 2)] * 10) or len(got) == 11
    opened = read_token_files(spark, folder, manifest, [2000]).rdd.getNumPartitions()
    assert opened < len(files) and read_token_files(spark, folder, manifest, [-1]).count() == 0


def test_equal_rows_are_packed_in_many_tasks(spark):
    """20,000 empty documents without an id share everything but the salt."""
    from pyspark.sql import functions as F
    from lineup.llm import packing as PK
    rows_ = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                       F.lit(1).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    got = PK.pack(rows_, 64)
    places = got.select("sequence_id", "offset").distinct().count()
    assert places == 20_000 and got.agg(F.max("sequence_id")).first()[0] == 20_000 // 64
    assert "_row" not in got.columns
    salt = F.pmod(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)), F.lit(100))
    assert rows_.groupBy(salt).count().agg(F.max("count")).first()[0] < 3 * PK.RANK_GROUP
