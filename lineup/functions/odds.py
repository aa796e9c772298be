"""Odds, probability and staking expressions.

NULL rules are part of each contract and are stated per function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def american_to_prob(odds, fixed: bool = False) -> Column:
    """American odds -> implied probability.

    As-run: ``100 / (o + 100)`` for ``o > 0``; non-numeric, NULL, zero and
    negative prices give NULL.  ``fixed=True`` also converts favourites:
    ``-o / (-o + 100)`` for ``o < 0``.
    """
    o = _c(odds).try_cast("double")
    out = F.when(o > 0, F.lit(100.0) / (o + 100.0))
    if fixed:
        out = out.when(o < 0, -o / (-o + 100.0))
    return out


def american_to_decimal(odds) -> Column:
    """American odds -> decimal odds: ``1 + o / 100`` for ``o > 0``,
    ``1 + 100 / -o`` for ``o < 0``; NULL, zero and non-numeric prices give NULL."""
    o = _c(odds).try_cast("double")
    return F.when(o > 0, 1.0 + o / 100.0).when(o < 0, 1.0 - 100.0 / o)


def decimal_to_prob(odds) -> Column:
    """Decimal odds -> implied probability ``1 / o``; NULL unless ``o > 0``."""
    o = _c(odds)
    return F.when(o > 0, F.lit(1.0) / o)


def normalize_pair(p, other) -> Column:
    """``p / (p + other)`` when the sum is positive, else ``p`` unchanged."""
    s = _c(p) + _c(other)
    return F.when(s > 0, _c(p) / s).otherwise(_c(p))


def edge(prob, implied) -> Column:
    """Model probability minus implied probability; NULL if either is NULL."""
    return _c(prob) - _c(implied)


def both_greatest(a, b) -> Column:
    """Element-wise maximum that is NULL when either side is NULL (Spark's
    ``greatest`` skips NULLs, which would hide a missing price)."""
    return F.when(_c(a).isNotNull() & _c(b).isNotNull(), F.greatest(_c(a), _c(b)))


def kelly_fraction(p, odds) -> Column:
    """Full Kelly ``(b p - q) / b`` with ``b = odds - 1``; 0 when ``p <= 0``,
    ``p >= 1`` or ``odds <= 1``; never negative.  NULL inputs give 0."""
    p, o = _c(p), _c(odds)
    b = o - 1.0
    f = (b * p - (1.0 - p)) / b
    return F.when((p <= 0) | (p >= 1) | (o <= 1), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), f))


def fractional_stake(p, odds, bankroll, fraction: float = 0.5, max_bet: float = 0.1) -> Column:
    """Stake ``min(bankroll * kelly * fraction, bankroll * max_bet)``."""
    br = _c(bankroll) if not isinstance(bankroll, (int, float)) else F.lit(float(bankroll))
    return F.least(br * kelly_fraction(p, odds) * F.lit(fraction), br * F.lit(max_bet))


def expected_value(stake, p, odds) -> Column:
    """``stake * (p (odds - 1) - (1 - p))``."""
    p = _c(p)
    return _c(stake) * (p * (_c(odds) - 1.0) - (1.0 - p))


def bet_return(stake, odds, won) -> Column:
    """Profit of one bet: ``stake (odds - 1)`` on a win, ``-stake`` otherwise."""
    return F.when(_c(won), _c(stake) * (_c(odds) - 1.0)).otherwise(-_c(stake))


def clamp(x, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), _c(x)))
