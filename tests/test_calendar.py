import datetime as dt

import pytest
from pyspark.sql import functions as F

from lineup.functions import calendar as C
from lineup.functions import text as T


@pytest.mark.parametrize("d,years", [(dt.date(2026, 4, 4), (2025, 2026)), (dt.date(2026, 11, 15), (2026, 2027))])
def test_season_years(spark, d, years):
    r = spark.range(1).select(C.season_years(F.lit(d)).alias("s")).first().s
    assert (r.season_start, r.season_end) == years


def test_calendar_flags(spark):
    r = spark.range(1).select(
        C.in_season(F.lit(dt.date(2024, 8, 1))).alias("a"), C.in_season(F.lit(dt.date(2024, 10, 1))).alias("b"),
        C.is_refresh_day(F.lit(dt.date(2024, 1, 2))).alias("tue"),
        C.estimated_game_number(F.lit(dt.date(2024, 10, 1)), F.lit(dt.date(2024, 10, 15))).alias("pre"),
        C.estimated_game_number(F.lit(dt.date(2025, 6, 30)), F.lit(dt.date(2024, 10, 15))).alias("late"),
        C.local_game_date(F.lit(dt.datetime(2024, 1, 2, 2, 30))).alias("loc"),
        C.date_from_iso_prefix(F.lit("2024-03-05T10:00:00Z")).alias("iso"),
        C.date_from_iso_prefix(F.lit("2024")).alias("short")).first()
    assert (r.a, r.b, r.tue, r.pre, r.late) == (False, True, True, 41, 82)
    assert r.loc == dt.date(2024, 1, 1) and r.iso == dt.date(2024, 3, 5) and r.short is None


def test_formats(spark):
    r = spark.range(1).select(T.currency(F.lit(1234.5)).alias("a"), T.currency(F.lit(-5.0)).alias("b"),
                              T.percentage(F.lit(0.1234)).alias("c")).first()
    assert (r.a, r.b, r.c) == ("$1,234.50", "$-5.00", "12.34%")
