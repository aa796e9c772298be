"""DuckDB text shared by several oracle queries (derived tables as CTEs)."""

from __future__ import annotations

from lineup.operators.games import LONG_FROM_WIDE
from lineup.plans import derive


def _side_select(side: str) -> str:
    other = "away" if side == "home" else "home"
    cols = ["game_id", "game_date", "season_id"]
    for long_name, pattern in LONG_FROM_WIDE:
        cols.append(f"{pattern.format(s=side, o=other)} as {long_name}")
    cols.append(f"'{side}' as venue")
    cols.append(f"pts_{side} > pts_{other} as win")
    return "select " + ", ".join(cols) + " from games"


def cte_team_games() -> str:
    """``games`` and ``tg`` (one row per game and side) as DuckDB CTEs."""
    return (derive.cte_games() + ", tg0 as (" + _side_select("home") + " union all " +
            _side_select("away") + "), tg as (select *, pts_for - pts_against as point_diff, "
            "cast(win as double) as win_numeric, venue = 'home' as is_home from tg0)")


def rounded(sql: str, cols) -> str:
    """Wrap a query so the listed double columns are rounded to 6 places (and -0.0 becomes 0.0)."""
    if not cols:
        return sql
    rep = ", ".join(f"round({c}, 6) + 0e0 as {c}" for c in cols)
    return f"select * replace ({rep}) from ({sql}) as _q"
