"""Year-range filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from lineup.constants import DATE_KEYWORDS

SEASON_TEXT = r"^\d{4}-\d{2}$"


def date_like_columns(df: DataFrame) -> list[str]:
    """P5: columns whose name mentions a date keyword, in column order."""
    return [c for c in df.columns if any(k in c.lower() for k in DATE_KEYWORDS)]


def numeric_year(col: str, a: int, b: int) -> Column:
    """P7."""
    return F.col(col).between(a, b)


def season_text_year(col: str, a: int, b: int) -> Column:
    """year = the part before '-' of a text like '2020-21'; unparsable -> dropped."""
    y = F.split_part(F.col(col).cast("string"), F.lit("-"), F.lit(1)).try_cast("int")
    return F.coalesce(y.between(a, b), F.lit(False))


def date_year(df: DataFrame, col: str, a: int, b: int) -> Column:
    """P9 + X4: year of a date within [a, b].  Date and timestamp columns get a
    range predicate that reaches the Parquet scan; text is parsed (bad text
    dropped)."""
    t = df.schema[col].dataType
    lo, hi = dt.date(a, 1, 1), dt.date(b + 1, 1, 1)
    if isinstance(t, DateType):
        return (F.col(col) >= F.lit(lo)) & (F.col(col) < F.lit(hi))
    if isinstance(t, (TimestampType, TimestampNTZType)):
        lo_ts = F.lit(dt.datetime(a, 1, 1)).cast(t.simpleString())
        hi_ts = F.lit(dt.datetime(b + 1, 1, 1)).cast(t.simpleString())
        return (F.col(col) >= lo_ts) & (F.col(col) < hi_ts)
    d = F.try_to_date(F.col(col).cast("string"))
    return F.coalesce(F.year(d).between(a, b), F.lit(False))


def _kinds(df: DataFrame, cols: list[str], a: int, b: int) -> list[tuple[str, str, int]]:
    """P6 and P10 in one aggregation over the whole table: (column, kind, rows that
    its filter keeps).  Numeric columns hold years and date columns dates; a text column holds
    seasons ('2020-21') or dates, whichever more of its values are (dates on a tie), or neither."""
    aggs, found = [], []
    for i, c in enumerate(cols):
        t = df.schema[c].dataType
        kinds = {"year": isinstance(t, (NumericType, StringType)),
                 "date": isinstance(t, (DateType, TimestampType, TimestampNTZType, StringType))}
        for kind in [k for k, can in kinds.items() if can]:
            if isinstance(t, StringType):
                fits = F.regexp(F.col(c), F.lit(SEASON_TEXT)) if kind == "year" else F.try_to_date(c).isNotNull()
            else:
                fits = F.lit(True)
            aggs += [F.count_if(fits).alias(f"_f{i}{kind}"), F.count_if(predicate(df, c, kind, a, b)).alias(f"_k{i}{kind}")]
            found.append((i, c, kind))
    counts = df.agg(*aggs).first().asDict() if aggs else {}
    out = []
    for i, c in enumerate(cols):
        own = [(counts[f"_f{i}{k}"], k == "date", k) for j, _, k in found if j == i]
        best = max(own, default=(0, False, ""))
        if best[0] > 0:
            out.append((c, best[2], counts[f"_k{i}{best[2]}"]))
    return out


def predicate(df: DataFrame, col: str, kind: str, a: int, b: int) -> Column:
    if kind == "year":
        if isinstance(df.schema[col].dataType, NumericType):
            return numeric_year(col, a, b)
        return season_text_year(col, a, b)
    return date_year(df, col, a, b)


def filter_by_year_range(df: DataFrame, a: int, b: int) -> DataFrame:
    """P10: try the date-like columns in order and keep the first one whose
    filter is non-empty; without any, return everything.  The choice depends on all
    values of a column, never on the order of the rows."""
    for col, kind, kept in _kinds(df, date_like_columns(df), a, b):
        if kept > 0:
            return df.where(predicate(df, col, kind, a, b))
    return df
