"""Line, substring and near-duplicate removal, and decontamination, against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest
from cases import frame, rows, words
from pyspark.sql import functions as F

from lineup.llm import near_dedup as ND
from lineup.llm import substring_dedup as SD
from lineup.llm.decontamination import find_contamination, remove_contaminated
from lineup.llm.line_dedup import dedup_lines, drop_runs
from lineup.llm.near_dedup import near_duplicates, one_per_group
from lineup.llm.substring_dedup import remove_repeats

NULL = -(1 << 63)


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize("min_docs", [2, 5])
def test_lines(spark, min_docs):
    data = rows()
    found = defaultdict(int)
    for _, text in data:
        for key in {_key(x) for x in (text or "").split("\n")} - {""}:
            found[key] += 1
    want = []
    for i, text in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if found[_key(x)] < min_docs or not _key(x)]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = dedup_lines(frame(spark, data, False), min_docs).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got)


def test_lines_keep_first(spark):
    data = [(2, "x\nsame\ny\nSAME "), (1, "same"), (3, "same\nsame"), (None, None), (4, "\n\n")]
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, data, False), 2, keep_first=True).collect()}
    assert got == {2: "x\ny", 1: "same", 3: "", None: "", 4: "\n\n"}
    runs = {r._k: [tuple(x) for x in r.drop_runs] for r in drop_runs(frame(spark, data, False), 2, keep_first=True).collect()}
    assert runs == {2: [(1, 1), (3, 1)], 3: [(0, 2)]}
    assert dedup_lines(frame(spark, [], False)).count() == 0


def test_lines_plan_is_native(spark):
    plan = dedup_lines(frame(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def _without_repeats(data, length):
    order = sorted(set(data), key=lambda r: (NULL if r[0] is None else r[0]))
    seen, gone = set(), defaultdict(set)
    for i, text in order:
        w = words(text)
        for s in range(len(w) - length + 1):
            window = tuple(w[s:s + length])
            if window in seen:
                gone[i, text].update(range(s, s + length))
            seen.add(window)
    return {(i, t): " ".join(x for p, x in enumerate(words(t)) if p not in gone[i, t]) for i, t in data}


@pytest.mark.parametrize("length,group", [(20, 500), (8, 500), (8, 3)])
def test_substrings(spark, monkeypatch, length, group):
    monkeypatch.setattr(SD, "GROUP", group)  # 3: most anchors are split and meet by long prefixes
    data = rows() + [(1000 + i, " ".join(f"p{j}" for j in range(i, i + 30))) for i in range(12)]
    want = _without_repeats(data, length)
    got = remove_repeats(frame(spark, data), length).collect()
    assert sorted(str((i, want[i, t], len(words(t)))) for i, t in data) == sorted(
        str((r.doc_id, r.text, r.n_words)) for r in got)
    assert all(r.n_removed == r.n_words - len(words(r.text)) for r in got)


def test_substrings_of_repetitive_and_empty_input(spark):
    data = [(1, "a " * 200), (2, "a " * 19), (3, "b a " * 50), (4, None)]
    want = _without_repeats(data, 20)
    got = {r.doc_id: r.text for r in remove_repeats(frame(spark, data), 20).collect()}
    assert got == {i: want[i, t] for i, t in data}
    assert remove_repeats(frame(spark, []), 20).count() == 0


def test_substrings_of_rows_that_share_a_doc_id(spark):
    """Texts are told apart by 128 bits: under one doc_id (or none) the clean ones keep all their words."""
    shared = " ".join(f"s{i}" for i in range(30))
    data = [(i, f"a{n} " * 5 + " ".join(f"x{n}y{j}" for j in range(25))) for i in (7, None) for n in range(600)]
    data += [(9, shared)] * 3 + [(9, shared + " z")] + [(10, shared), (None, shared)]
    got = Counter((r.doc_id, r.n_removed) for r in remove_repeats(frame(spark, data, False), 20).collect())
    assert got == {(7, 30): 600, (None, 0): 601, (9, 30): 4, (10, 30): 1}


def test_substrings_of_many_equal_rows(spark):
    """10,000 equal rows are searched once; all get the result of the first."""
    text = " ".join(f"w{i}" for i in range(60))
    data = [(5, text)] * 10_000 + [(6, text + " more"), (4, "w3 " + text[text.index("w30"):])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(df, 20).collect())
    assert got == {(5, 60, 30): 10_000, (6, 61, 60): 1, (4, 31, 0): 1}


def _classes(data, k, percent=80):
    sets = []
    for i, text in data:
        w = words(text, lower=True)
        sets.append({tuple(w[s:s + k]) for s in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(data)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(data):
        r = find(x)
        least[r] = min(least.get(r, 1 << 62), NULL if i is None else i)
    out = []
    for x, (i, _) in enumerate(data):
        c = least[find(x)]
        out.append((i, len(sets[x]), None if c == NULL else c))
    return out


@pytest.mark.parametrize("k,small,wide", [(4, 12, 8), (5, 12, 8), (4, 2, 8), (4, 2, 0), (4, 2, 1)])
def test_near_duplicates(spark, monkeypatch, k, small, wide):
    monkeypatch.setattr(ND, "SMALL", small)  # 2: hubs and the pass across components are used
    monkeypatch.setattr(ND, "BLOCK", 4)
    monkeypatch.setattr(ND, "WIDE", wide)  # 0, 1: buckets are keyed by a second band
    data = rows()
    base = [f"n{i}" for i in range(150)]
    for c in range(14):  # a chain of copies: neighbours are alike, the ends are not
        data.append((2000 + c, " ".join(base[:4 * c] + [f"m{i}" for i in range(4 * c)][::-1] + base[4 * c:])))
    want = _classes(data, k)
    got = near_duplicates(frame(spark, data), k).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_bucket_of_very_many_unlinked_classes(spark):
    """50,000 classes share one band and nothing else; only planted twins share a second one and are alike."""
    n = 50_000
    own = "cast(case when id % 1000 = 1 then id - 1 else id end as bigint)"  # 0 and 1, 1000 and 1001, ... are twins
    classes = spark.range(n).selectExpr(
        "unhex(md5(cast(id as string))) as cls", "5L as n_shingles",
        f"array_repeat(unhex(md5(cast({own} as string))), 8) as parts",
        f"concat(array(17L), transform(sequence(1, 31), j -> xxhash64({own}, j))) as bands", f"{own} as own", "id")
    classes = classes.selectExpr("cls", "n_shingles", "concat(parts[0], parts[1], parts[2], parts[3], parts[4], parts[5], "
                                 "parts[6], parts[7]) as sig", "bands", "own", "id").cache()
    sets = spark.createDataFrame(classes.select("cls", "own").toPandas().apply(
        lambda r: (bytes(r.cls), b"".join(int(r.own * 5 + j).to_bytes(8, "little") for j in range(5))), axis=1).tolist(),
        "cls binary, hashes binary")
    members = classes.selectExpr("17L as key", "cls", "n_shingles", f"{n}L as n")
    labels = spark.createDataFrame([], "cls binary, root binary")
    found = ND._cross_links(members, labels, classes.drop("own", "id"), sets, 0.8).collect()
    ids = {bytes(r.cls): r.id for r in classes.select("cls", "id").collect()}
    got = sorted(tuple(sorted((ids[bytes(r.a)], ids[bytes(r.b)]))) for r in found)
    assert got == [(i, i + 1) for i in range(0, n, 1000)]


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    got = near_duplicates(frame(spark, [(1, None), (2, ""), (3, "only one")])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 0, 1), (2, 0, 2), (3, 1, 3)}


def test_one_row_of_each_group_stays(spark):
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    data = [(1, long[0])] * 3 + [(None, long[1])] * 3 + [(2, long[0] + " x"), (2, long[2]), (None, long[3]), (7, ""), (7, "")]
    got = one_per_group(frame(spark, data))
    assert got.columns == frame(spark, data).columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(str, [
        (1, long[0]), (None, long[1]), (2, long[2]), (None, long[3]), (7, ""), (7, "")]))
    assert one_per_group(frame(spark, [])).count() == 0


def _contamination(data, items, n=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for item, text in items:
        w = words(text, pattern, True)
        m = min(n, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[s:s + m])].add("" if item is None else str(item))
    out = []
    for i, text in data:
        w = words(text, pattern, True)
        hit, ids = set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                if tuple(w[s:s + m]) in windows:
                    hit.update(range(s, s + m))
                    ids |= windows[tuple(w[s:s + m])]
        out.append((i, len(w), len(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("max_windows", [200_000, 3])
def test_contamination(spark, max_windows):
    data = rows()
    passage = " ".join(f"P{i}" for i in range(40))
    items = [(1, passage), (2, passage), (2, passage), (10, "Common line"), (3, None), (4, ""), (None, "one two THREE"),
             (5, " ".join(f"p{i}" for i in range(7, 30))), (6, "漢字 l'eau")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("lo", F.lit(1))
    want = _contamination(data, items)
    got = find_contamination(frame(spark, data), bench, max_windows=max_windows).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_hit, r.item_ids)) for r in got)
    for r in got:
        assert r.n_hit == sum(s.hi - s.lo for s in r.hit_spans)
    clean = remove_contaminated(frame(spark, data), bench, max_windows=max_windows)
    assert clean.columns == frame(spark, data).columns
    bad = {w[0] for w in want if w[2]}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in data if i not in bad)


@pytest.mark.parametrize("max_windows", [200_000, 3])
def test_contamination_is_of_the_row_not_the_doc_id(spark, max_windows):
    items = [(i, " ".join(f"q{i}x{j}" for j in range(12))) for i in range(4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    data = [(i, t) for i in (5, None) for t in (items[1][1], "a b c d e f g h i j k l", items[2][1], None)]
    want = _contamination(data, items)
    got = find_contamination(frame(spark, data), bench, max_windows=max_windows).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_hit, r.item_ids)) for r in got)
    clean = remove_contaminated(frame(spark, data), bench, max_windows=max_windows)
    assert clean.dtypes == frame(spark, data).dtypes
    assert sorted(str((r.doc_id, r.text)) for r in clean.collect()) == sorted(
        str(d) for d, w in zip(data, want) if not w[2])


def test_one_very_long_benchmark_item_is_cut(spark):
    """A block holds about ``max_windows`` windows, also where the benchmark is one item, and no window is lost."""
    from lineup.llm import decontamination as DC
    long = [f"L{i}" for i in range(3000)]
    items = [(1, " ".join(long)), (2, "a b " * 4000), (3, "few words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sizes = [sum(len(h) for h in block().value.hashes.values()) for block in DC._blocks(spark, bench, 10, 400)]
    assert sum(sizes) >= 2991 + 2 + 1 and len(sizes) > 10 and max(sizes) < 4 * 400
    data = [(i, " ".join(["x"] * 3 + long[7 * i:7 * i + 12] + ["y"])) for i in range(425)]
    data += [(900, "b a " * 6), (901, "FEW words"), (902, "a b c"), (903, " ".join(long)), (904, None)]
    want = _contamination(data, items)
    got = find_contamination(frame(spark, data), bench, max_windows=400).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_hit, r.item_ids)) for r in got)
    blank = spark.createDataFrame([(1, "... " * 20)], "item_id long, text string")
    assert {r.n_hit for r in find_contamination(frame(spark, data), blank, max_windows=3).collect()} == {0}


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in find_contamination(frame(spark, rows()), none).collect()} == {0}
    assert find_contamination(frame(spark, []), none).count() == 0


def test_hashes_are_the_same_everywhere():
    from lineup.llm.words import SPACED, Words
    w = Words([b"a bc a", None, b"", b"bc"], SPACED)
    assert w.count.tolist() == [3, 0, 0, 1] and w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] != w.hash[0]
    assert hashlib.sha256(w.hash.tobytes()).hexdigest()[:8] == hashlib.sha256(
        Words([b"a bc a bc"], SPACED).hash.tobytes()).hexdigest()[:8]
