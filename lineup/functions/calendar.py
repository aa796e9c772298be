"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineup.constants import (GAMES_PER_SEASON, MID_SEASON_GAME, REFRESH_WEEKDAYS,
                              SCHEDULE_UTC_OFFSET_HOURS, SEASON_FIRST_MONTH,
                              SEASON_LAST_MONTH, SEASON_LENGTH_DAYS)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def date_from_iso_prefix(text) -> Column:
    """Date from the first 10 characters of an ISO text; short or bad -> NULL."""
    t = _c(text)
    return F.when(F.length(t) >= 10, F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))


def local_game_date(ts_utc, fixed: bool = False, zone: str = "America/New_York") -> Column:
    """Local calendar date of a UTC game time.

    As-run: a fixed -5 hours.  ``fixed=True``: the zone's real offset (DST aware).
    """
    ts = _c(ts_utc).cast("timestamp")
    if fixed:
        return F.to_date(F.from_utc_timestamp(ts, zone))
    return F.to_date(ts + F.expr(f"INTERVAL {SCHEDULE_UTC_OFFSET_HOURS} HOURS"))


def season_start_year(d) -> Column:
    """Jan-Jun belong to the season that started the year before."""
    d = _c(d)
    return F.when(F.month(d) <= SEASON_LAST_MONTH, F.year(d) - 1).otherwise(F.year(d))


def season_years(d) -> Column:
    """(start, end) years of the season containing ``d``."""
    start = season_start_year(d)
    return F.struct(start.alias("season_start"), (start + 1).alias("season_end"))


def in_season(d) -> Column:
    d = _c(d)
    return (F.month(d) >= SEASON_FIRST_MONTH) | (F.month(d) <= SEASON_LAST_MONTH)


def is_refresh_day(d) -> Column:
    """Tuesday or Wednesday (``weekday``: Monday = 0)."""
    return F.weekday(_c(d)).isin(*REFRESH_WEEKDAYS)


def estimated_game_number(d, season_start) -> Column:
    """``clamp(floor(days * 82 / 170), 1, 82)`` from the season start; 41 before it."""
    d, s = _c(d), _c(season_start)
    days = F.datediff(d, s)
    est = F.floor(days * F.lit(GAMES_PER_SEASON) / F.lit(SEASON_LENGTH_DAYS)).cast("int")
    return F.when(d >= s, F.least(F.lit(GAMES_PER_SEASON), F.greatest(F.lit(1), est))) \
        .otherwise(F.lit(MID_SEASON_GAME))
