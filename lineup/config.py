"""Operator parameters (driver side only)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureConfig:
    """Parameters of the participant feature table.

    ``lookback``/``short`` are the two rolling lengths; ``min_games`` is the
    history filter; ``as_of`` selects the leak-free variants of the season
    means and the games-played filter (``False`` reproduces the reference's
    behaviour, where both look at the whole group).
    """

    lookback: int = 10
    short: int = 5
    min_games: int = 3
    as_of: bool = False
    rest_default: int = 2
    # Rows of one participant's history that share a window partition (whole days each).
    bucket_rows: int = 100_000
    rolling_measures: tuple = (
        ("pts_for", "avg_pts_last_{n}"),
        ("pts_against", "avg_pts_allowed_last_{n}"),
        ("point_diff", "avg_point_diff_last_{n}"),
        ("win_numeric", "win_pct_last_{n}"),
        ("fg_pct", "avg_fg_pct_last_{n}"),
        ("fg3_pct", "avg_fg3_pct_last_{n}"),
        ("ft_pct", "avg_ft_pct_last_{n}"),
        ("rebounds", "avg_rebounds_last_{n}"),
        ("assists", "avg_assists_last_{n}"),
        ("turnovers", "avg_turnovers_last_{n}"),
    )
    short_measures: tuple = (
        ("win_numeric", "win_pct_last_{n}"),
        ("point_diff", "avg_point_diff_last_{n}"),
    )


@dataclass(frozen=True)
class StakeConfig:
    """Staking parameters; defaults are the reference's configured values."""

    kelly_fraction: float = 0.5
    min_edge: float = 0.02
    max_bet_size: float = 0.1


@dataclass(frozen=True)
class DriftConfig:
    min_accuracy: float = 0.55
    max_drop: float = 0.05
    trailing_days: int = 30


@dataclass(frozen=True)
class ForestConfig:
    num_trees: int = 100
    max_depth: int = 10
    min_instances_per_node: int = 5
    seed: int = 42
    train_fraction: float = 0.8
    exclude: tuple = field(default=("game_id", "target_win", "win", "game_date"))
