"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineup.llm.common import table
from lineup.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@register("op2_token_frames")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.token_frames import read_token_files, write_token_files
    folder = shared_dir(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, manifest, with_tokens=False).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


@register("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op6_decontamination", f"""
with w as (select doc_id, coalesce(regexp_extract_all({_LOWER.format('text')},
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as ws from documents),
b as (select item_id, regexp_extract_all({_LOWER.format('text')},
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark where text is not null),
bw as (select distinct item_id, least(10, len(ws)) as m,
    ws[i:i + least(10, len(ws)) - 1] as win
    from (select item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0)),
ms as (select distinct m from bw),
dw as (select doc_id, i, m, ws[i:i + m - 1] as win
    from (select doc_id, ws, m, unnest(range(1, cast(len(ws) - m + 2 as bigint))) as i from w, ms
          where len(ws) >= m)),
hits as (select distinct d.doc_id, d.i, d.m, b.item_id from dw d join bw b on d.m = b.m and d.win = b.win),
covered as (select doc_id, count(distinct p) as n_hit from
    (select doc_id, unnest(range(i, cast(i + m as bigint))) as p from (select distinct doc_id, i, m from hits))
    group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from
    (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
    cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 as contaminated
from w left join covered using (doc_id) left join its using (doc_id)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.decontamination import find_contamination
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@register("op9_line_dedup", f"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
x as (select doc_id, i, ls[i] as line,
    {_LOWER.format("trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key
    from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from l)),
f as (select key from x where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, cast(count(*) as bigint) as n_lines,
    cast(count(*) filter (where key in (select key from f)) as bigint) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (where key not in (select key from f)), ''))
        as kept_sha256
from x group by doc_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.line_dedup import dedup_lines
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.secrets import BASE, scan_secrets, span_text
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


@register("op10_minhash_near_dedup", f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
    '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [ws]
    else list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) end) as sh from w),
sh as (select doc_id, hash(sh) as h, sh from s),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as m
    from sh a join sh b on a.h = b.h and a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n na on na.doc_id = x join n nb on nb.doc_id = y
    where 100 * m >= 80 * (na.n + nb.n - m)),
r(doc_id, reach) as (select doc_id, doc_id from w union select r.doc_id, l.y from r join l on l.x = r.reach)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, min(r.reach) as component_id,
    w.doc_id = min(r.reach) as kept
from w join r using (doc_id) left join n using (doc_id) group by w.doc_id, n.n""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.near_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), k=4).drop("cls")


@register("op8_exact_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
    from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[]))
    as bigint) as score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.topk import top_k
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@register("op4_substring_dedup", """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
x as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as win
    from (select doc_id, ws, unnest(range(1, cast(len(ws) - 18 as bigint))) as i from w where len(ws) >= 20)),
f as (select doc_id, i, row_number() over (partition by win order by doc_id, i) as n from x),
c as (select distinct doc_id, unnest(range(i, i + 20)) as p from f where n > 1),
k as (select w.doc_id, p as place, ws[p] as word from
    (select doc_id, ws, unnest(range(1, cast(len(ws) + 1 as bigint))) as p from w) w
    where not exists (select 1 from c where c.doc_id = w.doc_id and c.p = w.p)),
g as (select doc_id, count(*) as n, string_agg(word, ' ' order by place) as kept from k group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed,
    sha256(coalesce(kept, '')) as kept_sha256
from w left join g using (doc_id)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.substring_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.language_id import identify, train
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", (F.pmod(F.crc32(F.coalesce(
        F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model, reject=False)


@register("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.quality import classify, fit, grade_of
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = table(spark, sf_dir, "labels").select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return classify(docs, fit(docs, ratings)).drop("text")


@register("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


# the table of CRC-32 and the CRC of each distinct word, byte by byte, stand in for prefix CRCs
_CRC_STEP = "xor(c >> 1, (c & 1) * 3988292384)"


@register("op12_importance_resampling", f"""
with recursive bits(v, c, k) as (select range, range, 0 from range(256)
    union all select v, {_CRC_STEP}, k + 1 from bits where k < 8),
crcs as (select list(c order by v) as t from bits where k = 8),
d as (select doc_id, coalesce(regexp_extract_all({_LOWER.format('text')},
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as ws from documents),
dw as (select doc_id, unnest(ws) as w from d),
bw as (select unnest(regexp_extract_all({_LOWER.format('text')},
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w from benchmark where text is not null),
words as (select distinct w from (select w from dw union all select w from bw)),
hexed as (select w, lower(hex(encode(w))) as x from words),
bytes as (select w, list_transform(range(1, length(x), 2), lambda i:
    cast(16 * (strpos('0123456789abcdef', x[i]) - 1) + strpos('0123456789abcdef', x[i + 1]) - 1 as bigint)) as b from hexed),
bucket as (select w, xor(list_reduce(list_prepend(cast(4294967295 as bigint), b),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 as k from bytes, crcs),
s as (select k, count(*) as n from dw join bucket using (w) group by k),
t as (select k, count(*) as n from bw join bucket using (w) group by k),
sums as (select (select coalesce(sum(n), 0) from s) as sa, (select coalesce(sum(n), 0) from t) as ta),
gain as (select s.k, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (sa + 10000)::double /
    ((s.n + 1)::double * (ta + 10000)::double))) as bigint) as g from s left join t using (k), sums),
wt as (select doc_id, cast(floor(sum(g)::double / count(*)) as bigint) as weight
    from dw join bucket using (w) join gain using (k) group by doc_id),
h as (select doc_id, len(ws) as n, coalesce(weight, 0) as weight,
    cast('0x' || substr(sha256('2024:' || cast(doc_id as varchar)), 1, 8) as bigint) as h
    from d left join wt using (doc_id)),
sc as (select doc_id, n, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score
    from h),
r as (select doc_id, row_number() over (order by score desc, doc_id) as r from sc where n >= 20),
m as (select 10 * count(*) // 100 as most from sc where n >= 20)
select doc_id, cast(n as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
    cast(case when r <= most then r end as bigint) as rank
from sc left join r using (doc_id), m""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.resampling import resample
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@register("op13_license_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lineup.llm.licenses import label_text, scan_licenses
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), label_text(base).alias("base_labels"), label_text(F.col("spans")).alias("labels"),
        F.when(F.col("n_words") > 0, F.col("covered") / F.col("n_words")).otherwise(0.0).alias("score"))
