"""Report text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def currency(x) -> Column:
    """``$1,234.50``; negatives as ``$-5.00``."""
    return F.concat(F.lit("$"), F.format_number(_c(x), 2))


def percentage(x) -> Column:
    """A fraction as ``12.34%`` (no thousands separator)."""
    return F.concat(F.format_string("%.2f", _c(x) * 100), F.lit("%"))
