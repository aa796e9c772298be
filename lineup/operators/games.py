"""Game tables: cleaning (P1, P2) and the wide -> long reshape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType

SIDES = ("home", "away")

# (long column, wide column pattern); {s} is the side, {o} the other side.
LONG_FROM_WIDE = [
    ("team_name", "team_name_{s}"),
    ("team_abbrev", "team_abbreviation_{s}"),
    ("pts_for", "pts_{s}"),
    ("pts_against", "pts_{o}"),
    ("fg_pct", "fg_pct_{s}"),
    ("fg3_pct", "fg3_pct_{s}"),
    ("ft_pct", "ft_pct_{s}"),
    ("rebounds", "reb_{s}"),
    ("assists", "ast_{s}"),
    ("steals", "stl_{s}"),
    ("blocks", "blk_{s}"),
    ("turnovers", "tov_{s}"),
    ("opponent", "team_name_{o}"),
    ("opp_abbrev", "team_abbreviation_{o}"),
]


def clean_games(games: DataFrame, date_format: str = "yyyy-MM-dd",
                id_as_string: bool = True) -> DataFrame:
    """Parse the date (strict), cast the id, trim names, add win flags and the
    point difference.  Ties are a win for neither side (strict ``>``)."""
    cols = {}
    if isinstance(games.schema["game_date"].dataType, StringType):
        cols["game_date"] = F.to_date("game_date", date_format)
    elif not isinstance(games.schema["game_date"].dataType, DateType):
        cols["game_date"] = F.to_date("game_date")
    if id_as_string:
        cols["game_id"] = F.col("game_id").cast("string")
    for s in SIDES:
        if f"team_name_{s}" in games.columns:
            cols[f"team_name_{s}"] = F.trim(f"team_name_{s}")
    home, away = F.col("pts_home").cast("int"), F.col("pts_away").cast("int")
    cols["home_win"] = home > away
    cols["away_win"] = away > home
    cols["point_diff"] = home - away
    return games.withColumns(cols)


def _side(games: DataFrame, side: str) -> Column:
    other = "away" if side == "home" else "home"
    fields = []
    for long_name, pattern in LONG_FROM_WIDE:
        wide = pattern.format(s=side, o=other)
        if wide in games.columns:
            fields.append(F.col(wide).alias(long_name))
    fields.append(F.lit(side).alias("venue"))
    flag = f"{side}_win"
    win = F.col(flag) if flag in games.columns else \
        F.col(f"pts_{side}").cast("int") > F.col(f"pts_{other}").cast("int")
    fields.append(win.alias("win"))
    return F.struct(*fields)


def team_games(games: DataFrame) -> DataFrame:
    """One row per (game, participant): home and away sides with swapped roles.

    Built with a single ``explode`` of a two-element array, so the source is
    scanned once (a union of two selects would scan it twice).
    """
    keys = [c for c in ("game_id", "game_date", "season_id") if c in games.columns]
    long = games.select(*keys, F.explode(F.array(_side(games, "home"), _side(games, "away"))).alias("_t"))
    long = long.select(*keys, "_t.*")
    pf, pa = F.col("pts_for").cast("int"), F.col("pts_against").cast("int")
    return long.withColumns({
        "point_diff": pf - pa,
        "win_numeric": F.col("win").cast("double"),
        "is_home": F.col("venue") == F.lit("home"),
    })
