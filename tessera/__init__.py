"""tessera: a PySpark-native data preparation, profiling and evaluation engine.

Every operator is a function ``DataFrame -> DataFrame`` built from the
DataFrame / SQL API so Catalyst and AQE plan the physical work.
"""

from tessera.session import get_spark, checkpoint_dir, ship_package

__all__ = ["get_spark", "checkpoint_dir", "ship_package"]
