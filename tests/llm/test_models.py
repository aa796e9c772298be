"""Top-k, language identification, quality classifier, secret scan and the pipeline."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from cases import EXTRA, frame, rows
from pyspark.sql import functions as F

from lineup.llm import language_id as LI
from lineup.llm import topk as TK
from lineup.llm.quality import classify, features, fit, fit_ordinal, grade_of
from lineup.llm.secrets import BASE, KINDS, find_parts, link_parts, scan_secrets, span_text
from lineup.llm.topk import top_k


def _vectors(seed=1, n=400, dim=12):
    rng = np.random.default_rng(seed)
    data = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(n, dim)), 2))]
    data += [(n + j, list(data[0][1])) for j in range(30)]  # ties
    data += [(1000, None), (1100, [1.0, None] + [0.0] * (dim - 2)), (1200, [math.nan] * dim), (1300, [math.inf] * dim),
             (None, data[3][1]), (1400, []), (1500, [2.5] * 3), (-100, data[5][1]), (7, data[8][1])]
    return data


def _brute(data, k, asked):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in data
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if asked(i)}):
        v = min([float(x) for x in w] + [0.0] * 0 for i, w in ok if i == q)
        scores = sorted((-sum(int(a) * b for a, b in zip(v, w)), i) for i, w in ok if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(TK, "QUERY_BLOCK", block)
    data = _vectors()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("x") for c in ("id", "vec", "dist", "score")})
    got = [tuple(r) for r in top_k(df, F.col("id") % 100 == 0, 10).collect()]
    assert sorted(got) == sorted(_brute(data, 10, lambda i: i % 100 == 0))
    few = spark.createDataFrame(data[:4], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(few, F.lit(True), 10).collect())) == sorted(_brute(data[:4], 10, lambda i: True))
    assert top_k(df.limit(0), F.lit(True)).count() == 0 and top_k(df, F.lit(False)).count() == 0


def test_topk_with_large_whole_numbers(spark):
    data = [(i, [float((i * 37 + j * 11) % 101) * 2.0 ** 12 for j in range(6)]) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, F.col("id") % 10 == 0, 5).collect())) == sorted(
        _brute(data, 5, lambda i: i % 10 == 0))


LANGS = {"aa": ["ka", "to", "mi", "ra", "né"], "bb": ["schu", "ber", "wen", "ich", "öf"], "cc": ["ing", "the", "ou", "tha"]}


def _language_rows(n=300, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(LANGS)[i % 3]
        words = ["".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40))]
        out.append((i, " ".join(words).capitalize() + " 12!", lang))
    return out


def test_languages(spark):
    data = _language_rows()
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = LI.train(df.where("doc_id % 4 <> 2"))
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 %% \n", None), (903, "KaToMi", None), (903, "KaToMi", None),
           (None, "schuber wenich", None), (904, "ich " * 50_000, "aa"), (905, "漢字漢字 漢字", None)]
    every = df.unionByName(spark.createDataFrame(odd, df.schema)).withColumns(
        {c: F.lit("x") for c in ("best", "entropy", "margin", "bin", "n")})
    got = LI.identify(every, model, reject=False).collect()
    assert len(got) == len(data) + len(odd)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by_id[900].score == 0.0
    assert by_id[903].lang_pred == "aa" and by_id[None].lang_pred == "bb" and by_id[904].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got) and by_id[905].lang_pred in LANGS and by_id[905].rejected
    strict = {r.doc_id: r.lang_pred for r in LI.identify(every, model).collect()}
    assert strict[905] == "und"


def test_kneser_ney_sums_to_one_and_equals_the_definition():
    grams = {"\x02\x02\x02\x02a": 5, "\x02\x02\x02ab": 3, "\x02\x02\x02a\x03": 2, "\x02\x02ab\x03": 3, "\x02\x02\x02\x02b": 1,
             "\x02\x02\x02b\x03": 1}
    m = LI._levels(np.zeros(len(grams), int), list(grams), np.array(list(grams.values())), ["x"])
    symbols = sorted({g[-1] for g in grams})
    for context in ("\x02\x02\x02\x02", "\x02\x02\x02a", "\x02\x02ab", "zzzz"):
        total = 0.0
        for c in [*symbols, "q"]:
            text = np.array([ord(x) for x in context + c], np.uint32)
            total += math.exp(m.event_scores(text, np.array([4]))[0, 0])
        assert total == pytest.approx(1.0, abs=1e-5)


def test_language_model_keeps_every_gram(spark):
    rng = random.Random(6)  # nearly all words differ, so that rare n-grams are most of the table
    data = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(60)), "aa") for i in range(900)]
    data += [(900 + i, "the other tongue", "bb") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    counted = LI.count_grams(df.where("pmod(xxhash64(doc_id), 16) <> 0").select("text", "lang"))
    model = LI._build(LI._save(counted, "t-grams"), LI.MAX_CELLS)
    assert len(model.grams[LI.ORDER - 1][0]) == counted.select("gram").distinct().count()


def test_joined_language_model_equals_the_broadcast_one(spark):
    data = _language_rows(120)
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 %% ", None), (903, "KaToMi", None), (903, "KaToMi", None),
           (None, "schuber wenich", None), (904, "ich " * 500, "aa"), (905, "漢字漢字 漢字", None)]
    df = spark.createDataFrame(data + odd, "doc_id long, text string, lang string")
    small, large = LI.train(df), LI.train(df, max_cells=0)
    assert small.path is None and large.path is not None and large.languages == small.languages
    assert large.right == small.right and large.limits == pytest.approx(small.limits, abs=1e-4)
    a, b = [sorted(LI._predict(df, m).collect(), key=lambda r: (str(r.doc_id), r.n_events)) for m in (small, large)]
    assert len(a) == len(b) == len(data) + len(odd)
    for x, y in zip(a, b):
        assert (x.doc_id, x.n_events) == (y.doc_id, y.n_events)
        if x.n_events:
            assert x.best == y.best and y.entropy == pytest.approx(x.entropy, abs=1e-4)
            assert y.margin == pytest.approx(x.margin, rel=1e-4, abs=1e-3)
    got = [sorted(map(str, LI.identify(df, m).collect())) for m in (small, large)]
    assert got[0] == got[1]


def test_more_than_64_languages(spark):
    def word(i):
        return "".join(chr(0x4E00 + 90 * i + j) for j in range(5))

    df = spark.createDataFrame([(40 * i + j, f"{word(i)} {word(i)}", f"l{i:02}") for i in range(70) for j in range(6)],
                               "doc_id long, text string, lang string")
    for max_cells in (LI.MAX_CELLS, 0):
        model = LI.train(df, max_cells=max_cells)
        assert len(model.languages) == 70
        got = LI.identify(df, model, reject=False).collect()
        assert len(got) == 420 and all(r.lang_pred == r.lang for r in got)


def test_documents_set_aside_are_counted_in_the_end(spark):
    data = [(i, t, x) for i, t, x in _language_rows(120)]
    aside = spark.range(1000, 1200).where("pmod(xxhash64(id), 16) = 0").limit(3).collect()
    df = spark.createDataFrame(data + [(r.id, "漢字 漢語 字語", "zz") for r in aside], "doc_id long, text string, lang string")
    for max_cells in (LI.MAX_CELLS, 0):
        model = LI.train(df, max_cells=max_cells)
        assert model.languages == ["aa", "bb", "cc", "zz"]
        got = LI.identify(df.where("lang = 'zz'"), model, reject=False).collect()
        assert len(got) == 3 and {r.lang_pred for r in got} == {"zz"}


def test_languages_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert LI.train(empty) is None
    assert LI.identify(empty, None).count() == 0
    one = spark.createDataFrame([(1, "abc def", "aa"), (2, "abc fed", "aa"), (3, "abd", "aa")] * 3, empty.schema)
    r = LI.identify(one, LI.train(one), reject=False).collect()
    assert {x.lang_pred for x in r} <= {"aa", "und"}


def _rated(n=600, seed=4):
    rng = random.Random(seed)
    good = [f"word{i}" for i in range(80)]
    docs, ratings = [], []
    for i in range(n):
        w = [rng.choice(good) for _ in range(rng.randint(10, 80))]
        grade = i % 3
        if grade == 0:
            w.insert(rng.randrange(len(w)), "vile" + rng.choice(["", "ly", "ness"]))
        if grade == 1:
            w = [x + "%%%" for x in w]
        docs.append((i, " ".join(w)))
        ratings.append((i, grade))
    return docs, ratings


def test_quality(spark):
    docs, ratings = _rated()
    train = spark.createDataFrame([r for r in ratings if r[0] % 5], "doc_id long, grade int")
    odd = [(9000, None), (9001, ""), (9002, " \n"), (None, "word1 word2 word3"), (9003, "word4 " * 60_000), (9003, "word4")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string").withColumns({c: F.lit("x") for c in EXTRA})
    model = fit(df, train.union(train).union(spark.createDataFrame([(None, 2), (3, None), (77777, 1)], train.schema)))
    got = classify(df, model).collect()
    assert len(got) == len(docs) + len(odd) and set(EXTRA) - {"kept"} <= set(got[0].asDict())
    by_id = {r.doc_id: r for r in got}
    held = [r for r in by_id.values() if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 5 == 0]
    assert sum(r.kept == (r.doc_id % 3 == 2) for r in held) >= 0.95 * len(held)
    assert not any(by_id[i].kept for i in (9000, 9001, 9002)) and by_id[9001].expected_grade == 0
    assert all(0 <= r.p_good <= 1 and r.p_good <= r.expected_grade <= 2 for r in got)
    bounded = fit(df, train, max_rows=50, max_features=2000)
    assert bounded is not None and bounded.thresholds[0] <= bounded.thresholds[1]
    none = fit(df, train.limit(0))
    assert none is None and [r.kept for r in classify(df, none).collect()].count(True) == len(docs) + 3


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [t.encode() if t is not None else None for _, t in rows()]
    index, first, n_words = features(texts)
    for i, text in enumerate(texts):
        alone, _, own = features([text])
        assert index[first[i]:first[i + 1]].tolist() == alone.tolist() and n_words[i] == own[0]


def test_ordinal_fit_recovers_the_order():
    rng = np.random.default_rng(0)
    texts, grade = [], []
    for _ in range(500):
        k = rng.integers(0, 7)
        texts.append(" ".join(["up"] * int(k > 0) + [f"u{j}" for j in range(k)] + ["base"]).encode())
        grade.append(int(k > 2) + int(k > 4))
    index, first, _ = features(texts)
    m = fit_ordinal(index, first, np.array(grade), 3)
    tails = m.tails(m.score(index, first))
    assert m.thresholds[0] < m.thresholds[1] and (tails[:, 0] >= tails[:, 1]).all()
    assert np.mean((tails > 0.5).sum(1) == np.array(grade)) > 0.95


def test_grades(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (0, 0), (0, 1), (None, 0), (1, None)], "q int, t int")
    assert [r[0] for r in df.select(grade_of(F.col("q"), F.col("t"))).collect()] == [2, 0, 1, 0, None, None]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WEAK = re.compile(r"(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}")


def _spans(text, scope=200):
    text = text or ""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 12:
            found.append((m.start(), m.end(), "access" if len(m[0]) >= 20 else "weak_access"))
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found += [(m.start(), m.end(), "weak_secret") for m in WEAK.finditer(text) if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    found += [(m.start(), m.end(), "endpoint") for m in re.finditer("https?://[A-Za-z0-9.-]+", text)]

    def near(x, kinds, reach):
        return any(y is not x and y[2] in kinds and y[0] < x[1] + reach and y[1] > x[0] - reach for y in found)

    out = []
    for x in found:
        if x[2] in BASE or (x[2] == "weak_access" and near(x, ("assign", "hex", "weak_secret"), scope + 1)) or (
                x[2] == "weak_secret" and near(x, ("access", "weak_access"), scope + 1) and not near(x, BASE, 0)) or (
                x[2] == "endpoint" and near(x, BASE, scope + 1)):
            out.append((x[0], KINDS.index(x[2]), x[2], x[1]))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def _secret_rows():
    pad = " lorem ipsum " * 30
    texts = [None, "", "no secret here", 'password = "hunter22"', "PASSWD:abc", "token=token=abcdef", "secret:token:abcdefgh",
             "AKIA" + "A1" * 8, "AKIA" + "B" * 8, "AKIA" + "B" * 8 + " key Ab1" + "x" * 20, "AKIA" + "B" * 8 + pad + "Ab1" + "x" * 20,
             "see https://a.example.com/x", "see https://a.example.com/x token: abcdef123", "é漢𝒳 " + "0f" * 12 + " https://h.io",
             "0f" * 11 + "0", "AKIAAKIA" + "Q" * 13, "apikey='x' api_key:'yyyyyyyy'", "Zz9" + "k" * 30,
             "Zz9" + "k" * 30 + " AKIA" + "C" * 16, "ab " * 5000 + "token=" + "q" * 9, "x" * 30_000, "0a" * 20_000,
             "https://e.io " * 200 + "secret = abcdefgh" + " AKIA" + "D" * 9]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[12]), (3, texts[3])]


def test_secrets(spark):
    data = _secret_rows() + rows()
    df = frame(spark, data).withColumns({"_uid": F.lit(1), "kind": F.lit("x"), "start": F.lit(2)})
    got = scan_secrets(df).select("doc_id", span_text(F.col("spans")).alias("s")).collect()
    assert sorted(str((i, _spans(t))) for i, t in data) == sorted(str((r.doc_id, r.s)) for r in got)
    assert scan_secrets(frame(spark, [])).count() == 0


def test_secret_scan_is_native(spark):
    plan = link_parts(find_parts(frame(spark, _secret_rows())))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|Join|Cartesian", plan)


def test_pipeline_stages(spark, small_dir):
    import corpus_pipeline as P
    from lineup.session import shared_dir
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    extra = docs.withColumns({c: F.lit("x") for c in EXTRA})
    odd = spark.createDataFrame([(None, None, "en", "s", 1), (None, "", "en", None, None), (800_000, " \n", None, "s", 0)],
                                docs.schema)
    odd = odd.withColumns({c: F.lit("x") for c in EXTRA})
    now = extra.unionByName(odd).unionByName(extra.limit(3))
    for name, stage in P.STAGES:
        path = shared_dir(spark, f"t-{name}")
        before = now
        stage(spark, now, small_dir).write.parquet(path)
        now = spark.read.parquet(path)
        if name != "packing":
            assert now.columns == before.columns
            assert now.select("doc_id").distinct().count() <= before.select("doc_id").distinct().count()
            assert now.join(before.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(now.columns) and now.count() > 50
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    kept = P.quality(spark, docs, small_dir).join(labels, "doc_id")
    good = labels.where("quality = 1 and toxic = 0").join(docs, "doc_id")
    assert kept.where("toxic = 1").count() == 0 and kept.where("quality = 1 and toxic = 0").count() == good.count()
    for _, stage in P.STAGES:  # empty tables
        assert stage(spark, docs.limit(0), small_dir).count() == 0


def test_queries_have_the_contract_columns(spark, small_dir):
    from lineup.llm.queries import QUERIES
    want = {"op2": "doc_id start n_tokens ids_crc32", "op3": "doc_id piece start length ids_crc32 sequence_id offset",
            "op4": "doc_id n_words n_removed kept_sha256", "op5": "doc_id held_out lang_pred score",
            "op6": "doc_id n_words n_hit n_items items_sha256 contaminated",
            "op7": "doc_id n_assign n_access n_hex base_sha256 spans", "op8": "query_id rank vec_id score",
            "op9": "doc_id n_lines n_dropped kept_sha256", "op10": "doc_id n_shingles component_id kept"}
    kinds = {"piece": "int", "rank": "int", "held_out": "boolean", "contaminated": "boolean", "kept": "boolean",
             "lang_pred": "string", "score": "double"}
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    for op, cols in want.items():
        name = next(q for q in QUERIES if q.startswith(op + "_"))
        types = dict(QUERIES[name](spark, small_dir).dtypes)
        for c in cols.split():
            kind = "long" if op == "op8" and c == "score" else kinds.get(
                c, "string" if c.endswith("sha256") or c == "spans" else "long")
            assert types[c] == {"long": "bigint"}.get(kind, kind), (op, c, types[c])


def test_oracles(spark, small_dir):
    from lineup.llm.queries import ORACLES, QUERIES
    from tools.oracle_check import compare, duck
    con = duck(small_dir)
    for name, sql in ORACLES.items():
        assert compare(QUERIES[name](spark, small_dir).toPandas(), con.execute(sql).df()) is None, name


def test_hidden_hash_of_spans(spark):
    got = scan_secrets(frame(spark, [(1, 'password = "hunter22"')])).select(
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"].isin(BASE))), 256).alias("h")).first().h
    assert got == hashlib.sha256(b"assign:0:20").hexdigest()


def test_secret_scan_of_very_long_texts(spark):
    """Time grows with the text: 5 million letters without a digit, and 200,000 parts in one document."""
    import time
    from pyspark.sql import functions as F
    from lineup.llm.secrets import scan_secrets
    parts = "x = 1 " + " ".join(f"token=abcdef{i:06d} http://h{i}.example" for i in range(100_000))
    data = [(1, "aB" * 2_500_000), (2, parts), (3, "AKIA" + "A" * 12 + " aB3" + "x" * 30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.n for r in scan_secrets(df).select("doc_id", F.size("spans").alias("n")).collect()}
    assert got == {1: 0, 2: 200_000, 3: 2} and time.time() - began < 90


def test_topk_plan_does_not_grow_with_the_queries(spark, monkeypatch):
    from lineup.llm import topk as TK
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "vec_id long, embedding array<double>")
    plans = []
    for block in (60, 7):
        monkeypatch.setattr(TK, "QUERY_BLOCK", block)
        found = top_k(df, F.lit(True), 3)
        plans.append((found._jdf.queryExecution().executedPlan().toString().count("FileScan"), sorted(map(tuple, found.collect()))))
    assert plans[0] == plans[1] and plans[0][0] == 1
