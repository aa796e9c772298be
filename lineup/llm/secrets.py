"""Secret scan with multipart credential linking, in DataFrame operations only.

Parts of credentials are found by patterns in whole texts:

===========  =========  =====================================================  ======
kind         class      pattern                                                report
===========  =========  =====================================================  ======
assign       secret     a password/token/key name, ``:`` or ``=``, 6+ characters  always
access       id         ``AKIA`` and upper-case letters or digits, 20+ in all     always
hex          secret     24 or more lower-case hex digits                          always
weak_access  id         the same as access with 12 to 19 characters              linked
weak_secret  secret     20+ key characters with a digit and both letter cases    linked
endpoint     endpoint   ``http(s)://`` and a host                                  linked
===========  =========  =====================================================  ======

A weak part says nothing by itself: it is reported only when a complementary
part (a secret for an identifier, an identifier for a secret, either for an
endpoint, but strong ones only) lies within ``scope`` code points of it in the same
document.  That interval join is a sweep: per document the parts are sorted by
start, and for every part the furthest end of each class before it and, in the same order
reversed, the nearest start after it are running values.  No pairs are built, and the work of a
document grows with its parts (and their sorting), whatever their number.

Positions are code points, ends exclusive.  They follow from the lengths of the
matches and of the text between them (``split`` by the same pattern), so texts never leave
the scan stage: rows of positions are all that is shuffled, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# maximal runs, so the least length can stand in the pattern
HEX = r"[0-9a-f]{24,}"
# whole runs; what they must hold is asked of the match, so no run is read again from each of its places
WEAK_SECRET = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"

#: Kinds in the order of listing.
KINDS = ["assign", "access", "hex", "weak_access", "weak_secret", "endpoint"]
BASE = KINDS[:3]


def _matches(text: Column, pattern: str, kind, ok=None, group: int = 0) -> Column:
    """array<struct<k, n, before, length>>: each match of the pattern, ``before`` being
    the code points since the previous match; ``k`` is NULL where the match does not count."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None

    def rows(m: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        lengths = F.zip_with(m, between, lambda a, b: F.struct(F.char_length(b).alias("before"),
                                                               F.char_length(a).alias("length")))
        kinds = F.transform(value if group else m, lambda v: (kind(v) if callable(kind) else F.when(
            ok(v) if ok else F.lit(True), F.lit(kind))))
        full = F.zip_with(lengths, kinds, lambda s, k: F.struct(
            k.alias("k"), s["before"].alias("before"), s["length"].alias("length")))
        return F.transform(full, lambda s, i: F.struct(
            F.lit(pattern[:8]).alias("p"), s["k"].alias("k"), i.alias("n"), s["before"].alias("before"),
            s["length"].alias("length")))

    empty = F.expr("cast(array() as array<struct<p: string, k: string, n: int, before: int, length: int>>)")
    return F.transform(F.array(found), lambda m: F.when(F.size(m) > 0, rows(m)).otherwise(empty))[0]


def find_parts(docs: DataFrame) -> DataFrame:
    """``_uid, doc_id, kind, start, end`` for every part, strong or weak, of every
    row of ``docs(doc_id, text)``; a row without parts (NULL and empty texts too) gives one
    row with a NULL kind.  ``_uid`` numbers the rows, so equal doc_ids stay apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    needed = [F.lit(p) for p in ("[0-9]", "[a-z]", "[A-Z]")]
    parts = F.concat(
        _matches(text, ASSIGN, "assign", lambda v: F.char_length(v) >= 6, group=2),
        _matches(text, ACCESS, lambda v: F.when(F.char_length(v) >= 20, F.lit("access")).when(
            F.char_length(v) >= 12, F.lit("weak_access"))),
        _matches(text, HEX, "hex"),
        _matches(text, WEAK_SECRET, "weak_secret",
                 lambda v: F.regexp(v, needed[0]) & F.regexp(v, needed[1]) & F.regexp(v, needed[2])),
        _matches(text, ENDPOINT, "endpoint"))
    rows = (docs.select(F.monotonically_increasing_id().alias("_uid"), F.col("doc_id").cast("long").alias("doc_id"),
                        parts.alias("_parts"))
            .select("_uid", "doc_id", F.explode_outer("_parts").alias("_s")).select("_uid", "doc_id", "_s.*"))
    rows = rows.repartition("_uid")
    own = W.partitionBy("_uid", "p").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("before") + F.col("length")).over(own)
    rows = rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("length"))
    # matches that do not count go; a document must keep a row
    return rows.select("_uid", "doc_id", F.col("k").alias("kind"), F.when(F.col("k").isNotNull(), F.col("start"))
                       .alias("start"), F.when(F.col("k").isNotNull(), F.col("end")).alias("end"))


def link_parts(parts: DataFrame, scope: int = 200) -> DataFrame:
    """``parts`` with ``reported``: strong parts always, weak ones when a complementary
    part lies within ``scope`` code points; a weak secret inside a strong part is that part."""
    order = [F.col("start").asc_nulls_first(), F.col("end"), F.col("kind")]
    before = W.partitionBy("_uid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # a frame that ends at the last row is made anew for every row; one of the reversed order runs along
    back = [F.col("start").desc_nulls_last(), F.col("end").desc(), F.col("kind").desc()]
    after = W.partitionBy("_uid").orderBy(*back).rowsBetween(W.unboundedPreceding, -1)
    classes = {"id": ["access", "weak_access"], "secret": ["assign", "hex", "weak_secret"],
               "strong": list(BASE)}

    def near(name: str, reach: int) -> Column:
        inside = F.col("kind").isin(classes[name])
        last = F.max(F.when(inside, F.col("end"))).over(before)
        following = F.min(F.when(inside, F.col("start"))).over(after)
        return F.coalesce(last > F.col("start") - reach, F.lit(False)) | F.coalesce(
            following < F.col("end") + reach, F.lit(False))

    linked = parts.withColumns({f"_{c}": near(c, scope + 1) for c in classes} | {"_covered": near("strong", 0)})
    kind = F.col("kind")
    reported = (kind.isin(BASE) | (kind == "weak_access") & F.col("_secret")
                | (kind == "weak_secret") & F.col("_id") & ~F.col("_covered")
                | (kind == "endpoint") & F.col("_strong"))
    return linked.withColumn("reported", F.coalesce(reported, F.lit(False))).drop(
        *[f"_{c}" for c in classes], "_covered")


def scan_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id`` and ``spans``, an array of
    ``start, rank, kind, end`` sorted by start, then kind as listed.

    Defined cases.  A NULL or empty text has no spans; a very long text is read whole, in time that grows with
    its length; NULL and equal doc_ids and equal rows keep their own results; an empty table gives an
    empty result; other columns are not read."""
    linked = link_parts(find_parts(docs), scope)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.when(F.col("reported"), F.struct("start", rank.alias("rank"), "kind", "end"))
    return linked.groupBy("_uid", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("_uid")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
