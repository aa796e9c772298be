"""Whitening, resampling and licence scan, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import frame, rows, words
from pyspark.sql import functions as F

from lineup.llm import licenses as LI
from lineup.llm import resampling as RS
from lineup.llm import whitening as WH

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _vectors(seed=3, n=300, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) @ rng.standard_normal((dim, dim)) * 0.3
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def _frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, n int, component string, data string")


def _whitened(data, wanted=32):
    kept = [(i, v) for i, v in data if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(v) for _, v in kept)
    x = [[math.floor(64 * c) + 1000000 for c in v] + [1000000] * (dim - len(v)) for _, v in kept]
    n = len(x)
    sums = [sum(r[d] for r in x) for d in range(dim)]
    dev = [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x]
    a = np.array([[(n * v - s) / n for v, s in zip(r, sums)] for r in x])
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    return kept, n, dev, a @ q / np.sqrt(e), e / np.trace(a.T @ a / n)


def test_whitening_equals_eigenvectors(spark):
    data = _vectors()
    data += [(5000, None), (5001, [1.0, None, 2.0]), (5002, [float("nan")] * 12), (5003, [float("inf")]), (None, [0.5] * 12),
             (5004, []), (5005, [0.25] * 7), data[3], (3, [9.0] * 12)]
    kept, n, dev, want, explained = _whitened(data)
    got = WH.whiten(_frame(spark, [(i, v, 1, "x", "y") for i, v in data])).collect()
    assert len(got) == n * 12 and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter(
        (i, d) for (i, _), d in zip(kept, dev))
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    for k in range(12):
        rows_ = sorted((r.deviation, abs(r.whitened)) for r in got if r.component == k + 1)
        assert np.allclose([w for _, w in rows_], [w for _, w in sorted(zip(dev, np.abs(want[:, k])))], atol=1e-8)
        assert np.isclose(next(r.explained for r in got if r.component == k + 1), explained[k], rtol=1e-10)
        # one sign for all rows
        mine = {(r.vec_id, r.deviation): r.whitened for r in got if r.component == k + 1}
        turn = {np.sign(mine[i, d] * w) for (i, _), d, w in zip(kept, dev, want[:, k]) if abs(w) > 1e-6}
        assert len(turn) == 1


def test_whitening_equal_deviations_and_low_rank(spark):
    # the corners of a cross: equal eigenvalues in six dimensions, none in the other two
    data = [(2 * d + (s > 0), [s * 1.0 if j == d else 0.0 for j in range(8)]) for d in range(6) for s in (-1, 1)] * 3
    got = WH.whiten(_frame(spark, [(i, v, 1, "x", "y") for i, v in data])).collect()
    assert {r.component for r in got} == set(range(1, 7)) and max(r.identity_error for r in got) < 1e-9
    assert all(abs(r.explained - 1 / 6) < 1e-9 for r in got)


def test_whitening_degenerate_tables(spark):
    for data in ([], [(1, None)], [(1, [0.5, 0.25])], [(i, [1.0, 2.0]) for i in range(5)], [(1, []), (2, [])]):
        assert WH.whiten(_frame(spark, [(i, v, 1, "x", "y") for i, v in data])).count() == 0


def test_whitening_of_wide_range(spark):
    data = [(i, [1e12 * (i % 5), 0.1 * (i % 3), 300.0 * (i % 7)]) for i in range(60)] + [(99, [3e30, 0.0, 0.0])]
    got = WH.whiten(_frame(spark, [(i, v, 1, "x", "y") for i, v in data])).collect()
    assert all(r.deviation is None for r in got) and got[0].component == 1


def test_bidiagonalisation_beyond_the_full_steps(monkeypatch):
    monkeypatch.setattr(WH, "FULL_STEPS", 40)
    rng = np.random.default_rng(1)
    spread = np.concatenate([[9.0, 9.0, 5.0], np.linspace(1, 0.01, 97)])
    x = np.linalg.qr(rng.standard_normal((400, 100)))[0] * spread @ np.linalg.qr(rng.standard_normal((100, 100)))[0].T
    steps = []

    def product(y, Y):
        steps.append(1)
        u = x @ y
        return u @ u, (x @ Y).T @ u, x.T @ u

    s, v = WH.bidiagonalise(product, 100, 3, float(np.linalg.norm(x)))
    assert np.allclose(s[:3], [9, 9, 5], atol=1e-9) and len(steps) < 100
    assert np.allclose(np.linalg.norm(x @ v[:, :3], axis=0), [9, 9, 5], atol=1e-9)
    assert np.allclose(v[:, :3].T @ v[:, :3], np.eye(3), atol=1e-12)


def test_whitening_rows_are_small():
    x = WH.matrix(__import__("pyarrow").array([1, 2, 1]), __import__("pyarrow").array([b"\xff\x02", b"\x00\x01", b"\x07"]), 2)
    assert x.tolist() == [[-1, 2], [256, 0], [7, 0]]


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_grams_by_prefix_crcs(n, monkeypatch):
    monkeypatch.setattr(RS, "CHUNK", 50)
    rng = random.Random(n)
    for _ in range(30):
        text = "".join(rng.choice(["a", "Bc", "Éñ", "漢", " ", ". ", "-", "\x00", "9", "z" * 300]) for _ in range(rng.randint(0, 80)))
        w = words(text, ALNUM, lower=True)
        ends, lengths = RS.prefix_crcs(text.encode())
        assert lengths.tolist() == [len(x.encode()) for x in w]
        assert ends.tolist() == [zlib.crc32(" ".join(w[:i + 1]).encode()) for i in range(len(w))]
        assert RS.gram_crcs(ends, lengths, n).tolist() == [
            zlib.crc32(" ".join(w[i:i + n]).encode()) for i in range(len(w) - n + 1)]


def _resampled(data, target, max_n, buckets, min_words, percent):
    def feats(text):
        w = words(text, ALNUM, lower=True)
        return w, [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_n + 1)
                   for i in range(len(w) - n + 1)]
    s, t = Counter(), Counter()
    for _, text in data:
        s.update(feats(text)[1])
    for text in target:
        t.update(feats(text)[1])
    sa, ta = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (sa + buckets) / ((s[k] + 1) * (ta + buckets)))) for k in s}
    out = []
    for i, text in data:
        w, f = feats(text)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))])
    can = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], -(1 << 63) if r[0] is None else r[0]))
    most = percent * len(can) // 100
    return out, can[:most]


@pytest.mark.parametrize("max_n,buckets,percent", [(1, 10_000, 10), (2, 500, 40), (3, 70_000, 100)])
def test_resampling(spark, max_n, buckets, percent):
    data = rows()
    target = ["w1 w2 w3 foo bar", None, "", "the the p1 p2"]
    want, drawn = _resampled(data, target, max_n, buckets, 20, percent)
    tgt = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = RS.resample(frame(spark, data), tgt, max_n, buckets, percent=percent).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(map(tuple, want))
    assert sorted((r.rank, r.doc_id, r.score) for r in got if r.rank) == [
        (k, r[0], r[4]) for k, r in enumerate(drawn, 1)]


def test_resampling_of_many_equal_rows(spark):
    """One row given 3,000 times: every copy has a rank of its own, and no task holds all of them."""
    data = [(7, "a b c " * 10)] * 3000 + [(i, f"w{i} " * 30) for i in range(50)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = RS.resample(df, df.limit(0), percent=100).collect()
    assert sorted(r.rank for r in got) == list(range(1, 3051))
    by = sorted(got, key=lambda r: r.rank)
    assert [(-r.score, r.doc_id) for r in by] == sorted((-r.score, r.doc_id) for r in got)


def test_resampling_empty(spark):
    df = frame(spark, [], False)
    assert RS.resample(df, df).count() == 0
    got = RS.resample(frame(spark, [(1, None), (2, "a b")], False), df).collect()
    assert {(r.doc_id, r.weight, r.rank) for r in got} == {(1, 0, None), (2, got[1].weight if got[1].doc_id == 2 else got[0].weight, None)}


def _pattern(template):
    """The template as a regular expression over words that each end with a space."""
    out = []
    for mark, region, text in re.findall(r"(\[\[|\]\])|\{\{(.*?)\}\}|((?:(?!\[\[|\]\]|\{\{).)+)", template, re.S):
        if mark:
            out.append("(?:" if mark == "[[" else ")?")
        elif text:
            out += [re.escape(w) + " " for w in words(text, ALNUM, lower=True)]
        elif region[0] == "*":
            out.append("(?:[^ ]+ ){%s,%s}" % tuple(region[1:].split("-")))
        else:
            out.append("(?:" + "|".join("".join(re.escape(w) + " " for w in words(x, ALNUM, lower=True))
                                        for x in region.split("|")) + ")")
    return "".join(out)


def _sample(template, rng):
    """A text that the template accepts."""
    out, skip = [], []
    for mark, region, text in re.findall(r"(\[\[|\]\])|\{\{(.*?)\}\}|((?:(?!\[\[|\]\]|\{\{).)+)", template, re.S):
        if mark == "[[":
            skip.append(rng.random() < 0.5)
        elif mark:
            skip.pop()
        elif any(skip):
            continue
        elif text:
            out.append(text)
        elif region[0] == "*":
            lo, hi = map(int, region[1:].split("-"))
            out.append(" ".join(rng.choice(["Jane", "doe", "2020", "the", "inc"]) for _ in range(rng.randint(lo, hi))))
        else:
            out.append(rng.choice(region.split("|")))
    return " ".join(out)


def _licence_texts():
    rng = random.Random(4)
    out = []
    for label, t in LI.BASE + LI.TEMPLATES:
        for _ in range(4):
            s = _sample(t, rng)
            w = s.split()
            out.append("Intro. " + s.upper().replace(" ", "\n", 3) + ", end")
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w) + " " + s.replace(" ", " - "))
    out += ["Released under the MIT License. Licensed under CC BY-NC 4.0.\nApache License, Version 2.0, cc by nc cc by nc",
            "under the mit under the mit license", "permission is hereby granted " * 50, "cc by", ""]
    return out


def test_licences_against_regular_expressions(spark):
    texts = _licence_texts() + [None, rows()[-5][1]]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "cc by nc"), (0, texts[0])]
    got = defaultdict(list)
    for r in LI.scan_licenses(frame(spark, data)).collect():
        got[r.doc_id].append((r.n_words, [(s.label, s.base, s.start, s.end) for s in r.spans], r.covered))
    patterns = [(label, True, re.compile(_pattern(t))) for label, t in LI.BASE] + [
        (label, False, re.compile(_pattern(t))) for label, t in LI.TEMPLATES]
    for i, text in data:
        w = words(text, ALNUM, lower=True)
        joined = "".join(x + " " for x in w)
        at = np.cumsum([0] + [len(x) + 1 for x in w]).tolist()
        spans = []
        for k in range(len(w) if len(w) < 2000 else 0):
            for label, base, p in patterns:
                # the longest: the search is greedy, so ends are tried from the furthest one
                m = p.match(joined, at[k])
                if m:
                    ends = [j for j in range(k, min(len(w), k + 400)) if p.fullmatch(joined, at[k], at[j + 1])]
                    spans.append((label, base, k, ends[-1] + 1))
        spans.sort(key=lambda s: (s[2], s[3], s[0], not s[1]))
        covered = len({j for s in spans for j in range(s[2], s[3])})
        assert (len(w), spans, covered) in got[i]
    assert {s[0] for rs in got.values() for r in rs for s in r[1]} == {label for label, _ in LI.BASE + LI.TEMPLATES}


def test_licence_templates_that_cannot_be_entered():
    for broken in ("{{*0-3}} is free software", "a b", "[[a b c", "a b c ]] d", "a [[b]] {{*1-2}} c"):
        with pytest.raises(ValueError):
            LI.Scanner([], [("x", broken)])


def test_licences_of_an_empty_table(spark):
    assert LI.scan_licenses(frame(spark, [])).count() == 0
