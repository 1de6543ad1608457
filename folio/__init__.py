"""folio: passage collections and topic-scoped retrieval on Spark.

Modules: ``functions`` (Column expressions), ``operators`` (DataFrame
operators), ``sources`` (table scans), ``plans`` (composed jobs),
``streaming`` (incremental ingest).
"""

__version__ = "0.1.0"

# Python workers receive folio's UDF helpers by value, so executors need no
# installed copy of the package.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
