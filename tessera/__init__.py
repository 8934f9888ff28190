"""tessera: text and JSON dataset curation on Spark DataFrames.

Every public function maps ``DataFrame -> DataFrame`` or ``Column -> Column``
so that Catalyst plans the whole job; Python runs only where a user supplies
a callable (tokenizer, model hook) or asks for byte-exact JSON re-dumping.
"""

import sys as _sys

from tessera.session import get_session, scratch_dir

# Python functions of this package (pandas UDFs, mapInPandas hooks) are
# shipped to executors by value, so workers need no installed copy.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover
    pass

__all__ = ["get_session", "scratch_dir"]
