"""tidewatch: entity change tracking (posting lifecycle, fuzzy linkage, snapshots) on Spark.

Every public function takes and returns DataFrames; clocks (``now``, ``as_of``) are always
parameters. See README.md for the module map.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers (pandas UDFs, grouped
    maps) need no installed copy of it on executors."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
