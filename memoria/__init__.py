"""memoria: agent-memory, table-migration and document-analysis operators on Spark.

Every operator is a function from DataFrames (plus explicit parameters such as
``as_of``) to a DataFrame. Operators never trigger a Spark action themselves,
except where documented (sinks, gates, and the few operators that must ship a
size-bounded broadcast or cut lineage with a checkpoint).
"""
import sys as _sys

try:
    # Python code that runs inside tasks (mapInArrow helpers) is shipped by value,
    # so executors need no installed copy of this package.
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
