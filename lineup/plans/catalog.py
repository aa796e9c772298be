"""Registered queries: name -> (Spark callable, DuckDB oracle text).

Each Spark callable takes ``(spark, sf_dir)``, reads the driver tables and
returns a DataFrame; every double column is rounded to 6 places so the
oracle comparison does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from lineup.plans.oracle import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    if not cols:
        return df
    # round(x * 10^p) / 10^p on the binary value (not on its decimal text),
    # which is how the SQL oracle rounds doubles; + 0.0 turns -0.0 into 0.0
    m = float(10 ** places)
    return df.withColumns({c: F.round(F.col(c).cast("double") * m, 0) / m + F.lit(0.0) for c in cols})


def register(name: str, oracle: str | None = None, doubles=()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = rounded(oracle, list(doubles))
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from lineup.plans import (q_features, q_markets, q_staking,  # noqa: F401
                              q_analytics, q_performance, q_ingest, q_model, q_stream)
