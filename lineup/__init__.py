"""lineup: PySpark operators for event-participant analytics.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, windows, joins and aggregates, so Catalyst can prune,
push down and plan the whole chain.  See the README for the map from the
survey inventory to modules.
"""

from lineup.config import FeatureConfig, StakeConfig
from lineup.session import get_spark, shared_dir

__all__ = ["FeatureConfig", "StakeConfig", "get_spark", "shared_dir"]
